"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item leaks into a document if a window of as many words as the item has a weighted-shingle
similarity (weighted Jaccard over five-word shingles, a shingle's weight being how often it occurs) of ``SIMILAR``
or more with it. Words are runs of letters and digits, lower-cased by Spark on either side, with one form of sigma.

1. Windows: such a window shares at least ``2 s / (1 + s)`` of its shingle places with the items of its length,
   so running counts of places that hold any of their shingles leave out windows that can't qualify, and none
   that can.
2. Fingerprints: each window left has a ``BITS``-bit SimHash of its weighted shingles, and so has each item.
3. Multi-index: the bits are cut into ``BLOCKS`` blocks. Fingerprints within ``RADIUS`` bits differ in at most as many
   blocks, so they agree in ``BLOCKS - RADIUS`` or more. The index has a table for each block, and adding up the
   tables' rows for a window's blocks counts the agreements with every item at once; a pair needs that many. None within the radius is
   left out, and of unrelated pairs fewer than one in a thousand stays. The distance decides.
4. The exact similarity verifies what is found.

At a similarity of 0.8 a bit differs with probability 0.15, so 128 bits differ in 19 places on average, with a
standard deviation of 4; the radius is four of them above.

The items are sent to the tasks in chunks of at most ``CHUNK_BYTES`` of text. If there are several, one pass over the
documents first keeps those that hold a rare shingle of any item (of each item the rarest ninth of its places and one
more, which every qualifying window shares one of), and the chunks pass over these few only. Documents are never
shuffled or split, and a task holds one block of texts.

Defined cases: null and blank texts or items match nothing; items of fewer than five words are one shingle of
all their words; repeated rows, null ids and items with equal text each count for themselves; texts of any length are read
whole, in a block of their own (some ten bytes a byte); of equally similar windows the first is told; an empty table on
either side gives no matches; other columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadloom.llm.columnar import ALNUM, Words, blocks, mix
from roadloom.session import cut

SHINGLE, SIMILAR = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 64, 36
CHUNK_BYTES = 16_000_000
#: Shingles of windows that are fingerprinted, and pairs of a window and an item that are counted, at a time.
WINDOW_SHINGLES, PAIRS = 100_000, 1_000_000
#: Up to this many leaking documents are sent to all tasks when they are left out; more are joined.
BROADCAST_ROWS = 100_000


def simhash(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes, as two words; a repeated shingle weighs as often as it stands there."""
    words = []
    for values in (shingles, mix(shingles ^ np.uint64(0xA0761D6478BD642F))):
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(*values.shape, 8), axis=2, bitorder="little")
        ones = bits.sum(axis=1, dtype=np.int32)
        words.append(np.packbits(2 * ones > values.shape[1], axis=1, bitorder="little").view("<u8"))
    return np.concatenate(words, axis=1)


def _hot(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint and block one of the block's values is 1: a row of the index."""
    width, n = BITS // BLOCKS, len(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").reshape(n, BLOCKS, width)
    value = (bits << np.arange(width, dtype=np.uint8)).sum(axis=2, dtype=np.int64)
    return (value[:, :, None] == np.arange(1 << width)).reshape(n, -1).astype(np.float32)


class Index:
    """Items of one length: their fingerprints and a table for each block."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, np.ascontiguousarray(_hot(prints).T)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in as many blocks as all pairs within the radius do."""
        found = [np.zeros((0, 2), np.int64)]
        step = max(1, PAIRS // len(self.prints))
        for a in range(0, len(prints), step):
            agree = _hot(prints[a : a + step]) @ self.tables
            found.append(np.argwhere(agree >= BLOCKS - RADIUS) + [a, 0])
        return tuple(np.concatenate(found).T)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        window, item = self.candidates(prints)
        differ = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        return window[differ <= RADIUS], item[differ <= RADIUS]


class Items:
    """Benchmark items by their number of words: shingles and indexed fingerprints."""

    def __init__(self, ids: list, texts: list[str]):
        self.by_length: dict[int, list] = {}
        for row, n, value in item_shingles(texts):
            self.by_length.setdefault(n, []).append((ids[row], value))
        self.lengths = sorted(self.by_length)
        self.index = {n: Index(simhash(np.stack([v for _, v in x]))) for n, x in self.by_length.items()}
        self.vocabulary = {n: np.unique(np.concatenate([v for _, v in x])) for n, x in self.by_length.items()}
        self.known = {k: np.unique(np.concatenate([self.vocabulary[n] for n in self.lengths if min(n, SHINGLE) == k])) for k in {min(n, SHINGLE) for n in self.lengths}}
        self.weights = {n: [Counter(v.tolist()) for _, v in x] for n, x in self.by_length.items()}


def item_shingles(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, number of words, shingle hashes in order) of each text with words."""
    for first, data, offsets in blocks(pa.array(texts, pa.string())):
        words = Words(data, offsets, ALNUM)
        hashes = words.hashes()
        runs = {k: words.runs(hashes, k) for k in range(1, SHINGLE + 1)}
        for row, n in enumerate(words.counts.tolist()):
            if n:
                value, at = runs[min(n, SHINGLE)]
                a, b = np.searchsorted(at, [words.bounds[row], words.bounds[row + 1]])
                yield first + row, n, value[a:b]


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def leaks(items: Items, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int, int], tuple[float, int]]:
    """(row, length, item) -> (best similarity, its first word) in a block of texts."""
    found: dict[tuple[int, int, int], tuple[float, int]] = {}
    words = Words(data, offsets, ALNUM)
    hashes = words.hashes()
    for k, known in items.known.items():
        value, at = words.runs(hashes, k)
        place = np.flatnonzero(_in(known, value)) if len(value) else value
        if not len(place):
            continue
        rows = np.unique(words.doc[at[place]])  # only these hold any shingle of an item
        some = np.flatnonzero(np.isin(words.doc[at], rows, assume_unique=False))
        value, at = value[some], at[some]
        doc = words.doc[at]
        hit = _in(known, value)
        for n in (x for x in items.lengths if min(x, SHINGLE) == k):
            m = n - k + 1  # shingles of a window
            own = hit.copy()
            own[hit] = _in(items.vocabulary[n], value[hit])
            if len(value) < m or own.sum() == 0:
                continue
            total = np.concatenate([[0], np.cumsum(own)])
            need = np.ceil(2 * SIMILAR / (1 + SIMILAR) * m - 1e-9)
            start = np.flatnonzero((total[m:] - total[:-m] >= need) & (doc[: len(doc) - m + 1] == doc[m - 1 :]))
            step = max(1, WINDOW_SHINGLES // m)
            for s in range(0, len(start), step):
                window = start[s : s + step]
                shingles = value[window[:, None] + np.arange(m)[None, :]]
                for w, i in zip(*(x.tolist() for x in items.index[n].near(simhash(shingles)))):
                    have, want = Counter(shingles[w].tolist()), items.weights[n][i]
                    both = sum((have & want).values())
                    share = both / (2 * m - both)
                    row = int(doc[window[w]])
                    first = int(at[window[w]] - words.bounds[row])
                    if share >= SIMILAR and (-share, first) < (-(old := found.get((row, n, i), (0, 0)))[0], old[1]):
                        found[row, n, i] = (share, first)
    return found


def lowered(text: Column) -> Column:
    """Lower case, with one form of the Greek sigma, whose lower case depends on what stands around it."""
    return F.translate(F.lower(text), "\u03c2", "\u03c3")


def _rare(items: DataFrame) -> DataFrame:
    """The hash ``gram`` of the rarest shingles of each item: a ninth of its places, and one more."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, value in item_shingles(batch.column(1).to_pylist()):
                keys = pa.array([batch.column(0)[row].as_py()] * len(value), pa.int64())
                yield pa.record_batch([keys, pa.array(value.view(np.int64)), pa.array([len(value)] * len(value))], ["item", "gram", "m"])

    grams = cut(items.select(F.xxhash64("item_id", "text").alias("item"), "text").mapInArrow(shingled, "item long, gram long, m long"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy("n", "gram"))
    spare = F.floor(F.lit(1 - 2 * SIMILAR / (1 + SIMILAR)) * F.col("m") + 1e-9) + 1
    return grams.join(often, "gram").withColumn("nth", nth).where(F.col("nth") <= spare).select("gram").distinct()


def _holding(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """The rows of ``docs`` (last column: text) that hold one of ``grams``."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(grams.toArrow().column(0).to_numpy().view(np.uint64)))  # eight bytes for about nine of the benchmark's words

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.zeros(batch.num_rows, bool)
            for first, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                words = Words(data, offsets, ALNUM)
                hashes = words.hashes()
                for k in range(1, SHINGLE + 1):
                    value, at = words.runs(hashes, k)
                    if len(sent.value) and len(value):
                        stays[first + words.doc[at[_in(sent.value, value)]]] = True
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(hold, docs.schema)


def matches(docs: DataFrame, benchmark: DataFrame, with_hash: bool = False) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: for each leaked item the best window of a document.

    ``with_hash`` adds ``text_hash``, the ``xxhash64`` of the document's text.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), lowered(F.col("text")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    chunks = max(1, -(-((size[0] or 0) + 64 * size[1]) // CHUNK_BYTES))
    names = ["doc_id", "text_hash", "item_id", "similarity", "first_word", "n_words"]
    schema = "doc_id long, text_hash long, item_id long, similarity double, first_word long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), lowered(F.col("text")).alias("text"))
    if chunks > 1:
        rows = cut(_holding(rows, _rare(items)))
    out = spark.createDataFrame([], schema)
    for k in range(chunks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).collect()  # CHUNK_BYTES or so
        chunk = Items([r["item_id"] for r in held], [r["text"] for r in held])
        if not chunk.lengths:
            continue
        sent = spark.sparkContext.broadcast(chunk)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, data, offsets in blocks(batch.column(2)):
                    found = sorted(leaks(sent.value, data, offsets).items())
                    item = [sent.value.by_length[n][i][0] for (_, n, i), _ in found]
                    at = pa.array([first + row for (row, _, _), _ in found], pa.int64())
                    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(item, pa.int64()), pa.array([s for _, (s, _) in found], pa.float64()), pa.array([w for _, (_, w) in found], pa.int64()), pa.array([n for (_, n, _), _ in found], pa.int64())]
                    yield pa.record_batch(columns, names)

        out = out.union(rows.mapInArrow(find, schema))
    return out if with_hash else out.drop("text_hash")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaks, with all their columns: those that ``matches`` doesn't name."""
    found = matches(docs, benchmark, with_hash=True)
    found = cut(found.select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct())
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = docs["doc_id"].cast("long").eqNullSafe(found["_leak_id"]) & (F.xxhash64(docs["text"]) == found["_leak_hash"])
    return docs.join(F.broadcast(found) if few else found, same, "left_anti")
