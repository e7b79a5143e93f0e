import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadloom.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, size=2048):
    plain = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.pieces(docs, PATH, size), size).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= size
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), size):
            part = np.array(ids[a : a + size], "<u4").tobytes()
            want[r["doc_id"]].append((a, len(part) // 4, zlib.crc32(part), len(ids)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    total = sum(n for held in sequences.values() for _, n in held)
    return total, len(sequences)


def test_each_id_lies_in_one_piece(docs):
    total, sequences = check(docs)
    assert sequences <= 1.03 * total / 2048 + 1


def test_edges(edge, nothing):
    check(edge, 256)
    assert packing.pack(packing.pieces(nothing, PATH)).collect() == []


def test_equal_rows_spread_over_the_bins(shipped):
    """A copied row may be most of the table; its pieces are dealt like any others."""
    from pyspark.sql import functions as F

    row = [F.lit(v).cast("long").alias(c) for c, v in zip(["doc_id", "start", "length", "ids_crc32", "doc_tokens"], [7, 0, 1500, 99, 1500])]
    packed = packing.pack(shipped.range(100_000, numPartitions=8).select(*row))
    held = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32).alias("bin")).count().collect()]
    assert len(held) == 13 and sum(held) == 100_000 and max(held) < 1.1 * packing.PIECES_PER_BIN


def brute(lengths, size):
    """Best fit by looking at every open window."""
    left, out = [], []
    for n in lengths:
        fits = [(c, -w) for w, c in enumerate(left) if c >= n]
        if fits:
            w = -min(fits)[1]
        else:
            w = len(left)
            left.append(size)
        out.append((size - left[w], min(c for c, _ in fits) if fits else size))
        left[w] -= n
    return len(left), out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.just(32))
def test_best_fit_equals_brute_force(lengths, size):
    lengths = sorted(lengths, reverse=True)
    window, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), size)
    windows, steps = brute(lengths, size)
    assert len(set(window.tolist())) == windows
    assert [size - o for o in offset.tolist()] == [c for _, c in steps]


def test_encoder_equals_tokenizer_while_its_cache_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 8)
    coder, plain = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["I'm don't we'LL 3.14%", "É\x85 naïve  co-op", "日本 語 test", "", "<|startoftext|> hi", "a b c d e f g h i j k l m", "İstanbul ǅ x", "z" * 100] * 2
    for at in range(0, len(texts), 3):
        some = texts[at : at + 3]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(some)] == [plain.encode(t, add_special_tokens=False).ids for t in some]
