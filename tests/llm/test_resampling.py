import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from corpus_tables import SF, table

from roadloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, low, high):
    held = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return held, [zlib.crc32(" ".join(held[i : i + k]).encode()) % 10_000 for k in range(low, high + 1) for i in range(len(held) - k + 1)]


def brute(docs, target, low=1, high=1, least=20):
    """Rows as plain Python counts and sorts them."""
    docs, s, t = [(i, *features(x, low, high)) for i, x in docs], Counter(), Counter()
    for _, _, f in docs:
        s.update(f)
    for x in target:
        t.update(features(x, low, high)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000)))) for b in s}
    rows = []
    for i, held, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(held) >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(drawn[: len(drawn) * 10 // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("low,high", [(1, 1), (1, 2), (2, 3)])
def test_equals_brute_force(shipped, docs, low, high):
    items = shipped.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()], low, high)
    found = resampling.resample(docs, items, low=low, high=high).collect()
    assert order(found) == order(want) and sum(r["rank"] is not None for r in found) > 5


def test_edges(edge, docs):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    found = resampling.resample(edge, docs, percent=50, least_words=1).collect()
    assert order(r[:4] for r in found) == order(r[:4] for r in brute(rows, [r["text"] for r in docs.collect()]))
    enough = sum(bool(WORD.findall(x or "")) for _, x in rows)
    assert sorted(r["rank"] for r in found if r["rank"] is not None) == list(range(1, enough // 2 + 1))
    assert all(r["n_features"] == 0 and r["weight"] == 0 and r["rank"] is None for r in found if r["doc_id"] in (1, 2, 3))


def test_empty_tables(docs, nothing):
    assert resampling.resample(nothing, docs).collect() == []
    assert order(resampling.resample(docs, nothing).collect()) == order(brute([(r["doc_id"], r["text"]) for r in docs.collect()], []))


def test_ties_and_repeated_rows(shipped):
    text = " ".join(f"w{k}" for k in range(25))
    rows = table(shipped, [(7, text)] * 30 + [(3, text)] * 10)
    found = resampling.resample(rows, rows).collect()
    assert len(found) == 40 and sorted(r["rank"] for r in found if r["rank"] is not None) == [1, 2, 3, 4]
    assert len({(r["doc_id"], r["weight"], r["score"]) for r in found}) == 2


def test_order_does_not_follow_partitions(docs):
    few, many = docs.repartition(2, "text"), docs.repartition(17)
    assert order(resampling.resample(few, docs).collect()) == order(resampling.resample(many, docs).collect())


def test_drawn_rows_look_like_the_target(shipped):
    like = " ".join(f"target{k % 40}" for k in range(60))
    other = " ".join(f"other{k % 40}" for k in range(60))
    rows = table(shipped, [(k, like if k % 10 == 0 else other) for k in range(400)])
    kept = resampling.drawn(rows, table(shipped, [(k, like) for k in range(300)]))
    texts = [r["text"] for r in kept.select("text").collect()]
    assert len(texts) == 40 and sum(x == like for x in texts) >= 34 and set(rows.columns) <= set(kept.columns)


def test_one_very_long_text(shipped):
    text = " ".join(f"w{k % 5000}" for k in range(400_000))
    row = resampling.resample(table(shipped, [(1, text), (2, "w1 w2")]), table(shipped, [(1, "w1 w1")]), percent=100, least_words=1).where("doc_id = 1").first()
    assert row["n_features"] == 400_000 and row["rank"] is not None
