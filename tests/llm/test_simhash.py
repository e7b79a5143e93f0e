import re

import numpy as np
import pytest
from corpus_tables import table
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from roadloom.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(rows):
    """Smallest id reachable, by comparing all pairs."""
    prints = np.array([f for _, f in rows], np.uint64)
    differ = np.unpackbits((prints[:, None] ^ prints[None, :]).view(np.uint8).reshape(len(rows), len(rows), 8), axis=2).sum(axis=2)
    out = [r[0] for r in rows]
    while True:
        fresh = [min((out[j] for j in np.flatnonzero(differ[k] <= 3) if out[j] is not None), default=None) for k in range(len(rows))]
        if fresh == out:
            return out
        out = fresh


def check(docs):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((i, f, c) for (i, f), c in zip(rows, labels(rows))), key=str)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.components(simhash.fingerprints(docs)).collect()]
    assert sorted(got, key=str) == want


def test_equals_brute_force(docs):
    check(docs)


def test_edges(shipped, edge, nothing):
    check(edge.where("doc_id is not null"))
    assert simhash.components(simhash.fingerprints(nothing)).collect() == []
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    assert simhash.deduplicate(nothing).collect() == []
    rows = [r["doc_id"] for r in kept.collect()]
    assert len(rows) == len(set(rows)) and {1, 4, 5, 6, 8} <= set(rows) and not {2, 3, 7, 9} & set(rows)


@pytest.mark.parametrize("rows", [0, 100_000])
def test_one_of_each_group_stays(docs, edge, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", rows)
    assert sorted(map(str, (r["doc_id"] for r in simhash.deduplicate(edge).collect()))) == sorted(map(str, [1, 4, 5, 6, 8, 10, 11, 12, 13, None]))
    components = {r["component_id"] for r in simhash.components(simhash.fingerprints(docs)).collect()}
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == sorted(components)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=8), st.lists(st.lists(st.integers(0, 63), max_size=5), min_size=1, max_size=200), st.integers(0, 3))
def test_bit_sliced_distances(queries, flips, radius):
    members = [queries[0] ^ sum(1 << b for b in set(f)) for f in flips]
    near = simhash.within(np.array(queries, np.uint64), simhash.planes(np.array(members, np.uint64)), radius)
    got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(members)].astype(bool)
    assert got.tolist() == [[(q ^ m).bit_count() <= radius for m in members] for q in queries]


def test_links_lose_nothing_in_large_buckets(shipped, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(150)} | {int(v) for v in rng.integers(0, 2**63, 100)})
    rows = list(enumerate(prints))
    held = shipped.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in rows], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(held).collect()}
    assert [got[k] for k, _ in rows] == labels(rows)


def test_null_ids_do_not_name_components(shipped):
    docs = table(shipped, [(None, "a b c d"), (5, "a b c d"), (None, "quite another text altogether")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.components(simhash.fingerprints(docs)).collect()), key=str)
    assert got == [(5, 5), (None, 5), (None, None)]


def test_null_and_empty_texts_are_copies(shipped):
    docs = table(shipped, [(1, None), (1, ""), (2, None), (3, "some text"), (3, "some text")])
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == [1, 3]


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 3000, 2000)
    length = np.r_[rng.integers(0, 100, 1990), 511, 512, 513, 700, 1000, 0, 1, 4, 8, 32]
    want = [xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, length)]
    assert simhash.xxh64(data, start, start + length).tolist() == want
