import math
import re
from collections import Counter, defaultdict

import pytest
from corpus_tables import table
from pyspark.sql import functions as F

from roadloom.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(docs, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by sharing the excess again and again."""
    own = Counter()
    for source, n in docs:
        own[source] += n
    order = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(own, 0.0), set(own), share * sum(own.values())
    while left > 1e-9 and open_:
        each, over = left / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += each * weight[s]
            if target[s] >= cap * own[s]:
                over += target[s] - cap * own[s]
                target[s] = cap * own[s]
                open_.discard(s)
        left = over
    return own, target


def tilt(sizes, target, cap=2):
    """The root of one source's dual by halving."""
    mean = sum(sizes) / len(sizes)
    rate = lambda t, s: min(cap, math.exp(min(50, t * s / (s + mean))))
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * rate(mid, s) for s in sizes if s) < target else (low, mid)
    return lambda s: rate(low, s) if s else 1.0


def check(found, rows, slack):
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in found) == Counter((i, size(x), s) for i, x, s in rows)
    own, target = wanted([(s, size(x)) for _, x, s in rows])
    taken = Counter()
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["source_size"] == own[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        taken[r["source"]] += r["taken"]
    assert max((abs(taken[s] - target[s]) for s in own), default=0) <= slack
    return target


def read(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def test_targets_and_rates_equal_brute_force(docs):
    rows, found = read(docs), mixing.mix(docs).collect()
    target = check(found, rows, 80)
    held = defaultdict(list)
    for r in found:
        held[r["source"]].append(r)
    for source, mine in held.items():
        if target[source] < 2 * mine[0]["source_size"]:
            rate = tilt([r["size"] for r in mine], target[source])
            assert all(math.isclose(r["rate"], rate(r["size"]), rel_tol=1e-5) for r in mine)


def many(spark, n=3000):
    """One source holds two thirds, one size a third of all rows."""
    text = lambda k: " ".join(["w"] * (40 if k % 3 == 0 else 1 + k * k % 97))
    rows = [(k, text(k), "hot" if k % 3 else None if k % 2 else f"s{k % 5}") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_hot_source_and_size(shipped):
    docs, rows = many(shipped)
    found = mixing.mix(docs).collect()
    check(found, rows, 2)
    assert sum(abs(r["copies"] - r["rate"]) < 1 for r in found) > 0.98 * len(found)  # but for what makes up the totals


def test_reruns_and_partitions_agree(shipped):
    docs, _ = many(shipped)
    first, second = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect()), key=str) for n in (2, 13))
    assert first == second


def test_edges(edge, nothing):
    check(mixing.mix(edge).collect(), read(edge), 15_000)  # half of the longest
    assert mixing.mix(nothing).collect() == []
    blank = edge.where("doc_id in (1, 2, 3)")
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix(blank).collect())


def test_sources_at_the_cap_and_below(shipped):
    rows = [(1, "a b c d", "x"), (2, "a", "y"), (3, "a " * 50, "z"), (4, None, "void"), (5, "a b", None), (6, "a b", "")]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix(docs).collect(), rows, 25)


def test_shares_beyond_the_cap_are_refused(docs):
    with pytest.raises(ValueError):
        mixing.mix(docs, share=2.5)


def test_carried_columns_and_copies(shipped):
    docs, _ = many(shipped, 300)
    held = mixing.mix(docs.withColumn("size_", F.lit(1)), carry=["text", "size_"])
    words = {r["doc_id"]: r["taken"] for r in held.collect()}
    rows = mixing.repeated(held).groupBy("doc_id").agg(F.sum("size").alias("words"), F.max("copy").alias("most")).collect()
    assert {r["doc_id"]: r["words"] for r in rows} == {k: v for k, v in words.items() if v}
    assert all(r["most"] <= 2 for r in rows)
