"""Packing token sequences by best-fit decreasing.

A document longer than the window is first cut into full windows. All pieces are then dealt by a hash (of their place in the table
too, so that copies of a row are dealt like other rows) into bins of about ``PIECES_PER_BIN``; each bin is packed on its own, longest piece first, and a segment tree indexed by
remaining capacity finds the tightest open window that holds a piece. Bins are many enough at any size that no
task grows, and large enough that the padding stays near that of packing all at once.

Defined cases: a null text is empty and has the end id only; repeated rows are packed as rows of their own; null
ids are kept; an empty table gives an empty result; other columns are ignored. A text of any length is tokenized whole, in
one task, with its ids in memory (a list of some 40 bytes an id, besides the text).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm import tokens
from roadloom.session import cut

PIECES_PER_BIN = 8_000
#: Texts that a task tokenizes at a time.
TEXTS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; ``lengths`` fall. Ties go to the window opened last."""
    leaves = 1 << size.bit_length()
    tree = bytearray(2 * leaves)  # 1: a window with a remaining capacity in this node's range is open
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    left: list[int] = []
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def mark(capacity: int) -> None:
        k = capacity + leaves
        while k and not tree[k]:
            tree[k] = 1
            k >>= 1

    def clear(capacity: int) -> None:
        k = capacity + leaves
        tree[k] = 0
        k >>= 1
        while k and not (tree[2 * k] or tree[2 * k + 1]):
            tree[k] = 0
            k >>= 1

    def tightest(need: int) -> int:
        """The least capacity of at least ``need`` that an open window has, or -1."""
        k = need + leaves
        while not tree[k]:
            while k & 1:  # a right child: go up until a right sibling exists
                k >>= 1
                if k <= 1:
                    return -1
            k += 1
        while k < leaves:
            k = 2 * k if tree[2 * k] else 2 * k + 1
        return k - leaves

    for p, n in enumerate(lengths.tolist()):
        c = tightest(n)
        if c < 0:
            w = len(left)
            left.append(size)
            c = size
        else:
            w = open_at[c].pop()
            if not open_at[c]:
                clear(c)
        window[p], offset[p] = w, size - c
        left[w] = c - n
        if c > n:
            open_at[c - n].append(w)
            mark(c - n)
    return window, offset


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of each document's ids, cut into full windows and a rest."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = tokens.encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * size
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, TEXTS):
                out = [[], [], [], [], []]
                block = [t or "" for t in texts.slice(at, TEXTS).to_pylist()]
                for k, coded in enumerate(enc.encode(block)):
                    coded += end
                    for a in range(0, len(coded), step):
                        piece = coded[a : a + step]
                        for column, value in zip(out, (at + k, a // 4, len(piece) // 4, zlib.crc32(piece), len(coded) // 4)):
                            column.append(value)
                yield pa.record_batch([ids.take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECES)


def pack(table: DataFrame, size: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows that ``pieces`` made."""
    table = cut(table.withColumn("place", F.monotonically_increasing_id()))  # equal rows differ in it
    bins = max(1, -(-table.count() // PIECES_PER_BIN))
    table = table.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "place"), F.lit(bins))).drop("place")

    def one(t: pa.Table) -> pa.Table:
        column = lambda name: t.column(name).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((column("start"), column("ids_crc32"), column("doc_id"), -column("length")))
        t = t.take(pa.array(order))
        window, offset = best_fit_decreasing(t.column("length").to_numpy(), size)
        first = t.column("bin").to_numpy().astype(np.int64) << 32
        return t.drop_columns(["bin"]).append_column("sequence_id", pa.array(first + window)).append_column("offset", pa.array(offset))

    return table.groupBy("bin").applyInArrow(one, PIECES + ", sequence_id long, offset long")
