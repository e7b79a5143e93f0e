"""Connected components of an edge table: forests of partitions, then alternating star contraction.

Edges of neighbouring nodes are brought together by ranges, and each task replaces its own by a forest of stars, one for each component that it
sees, in chunks of bounded size. A node takes its least centre, and what is left to decide is a graph of centres only, joined up in the same way; that
goes on while it at least halves the edges. Up to ``FEW`` edges are then joined up in one task, and more by stars.

Every round of stars is two shuffles of the edges; a node's smallest neighbour is a plain ``min`` with map-side
combine, so a hub costs one row per task, and the join that sends it back is a sort-merge join that
adaptive execution may split. Edges are de-duplicated each round and only shrink, and each round is cut with
``checkpoint()``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.session import cut, ship

#: Up to this many distinct edges are joined up in one task (under 10 MB of arrays).
FEW = 100_000
#: Edges that a task joins up at a time.
CHUNK = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every row is (larger, smaller)
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a graph and the smallest node it reaches: hooks to smaller labels and pointer jumps in turn."""
    node, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(node))
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return node, node[label]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of a whole graph: each node and the smallest node it reaches."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if held:
        node, least = _least_reachable(*np.concatenate(held, axis=1))
        yield pa.record_batch([pa.array(node), pa.array(least)], ["node", "component"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, centre; the centre is the smallest) that join what a chunk of edges joins."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        node, least = _least_reachable(*np.concatenate(held, axis=1))
        some = node != least
        return pa.record_batch([pa.array(node[some]), pa.array(least[some])], ["node", "centre"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size >= CHUNK:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def shrunk(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From edges ``a > b``: ``node, centre`` of every node that isn't its own centre everywhere, and the edges between centres."""
    stars = cut(now.repartitionByRange("b", "a").mapInArrow(_forest, "node long, centre long"))
    least = cut(stars.groupBy("node").agg(F.min("centre").alias("centre")))
    other = stars.join(least.withColumnRenamed("centre", "least"), "node").where("centre <> least").select(F.col("centre").alias("a"), F.col("least").alias("b"))
    both = least.join(stars.select(F.col("centre").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("centre").alias("b"))  # leaf here, centre there
    return least, cut(other.union(both).distinct())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int | None = None) -> DataFrame:
    """Return ``(node, component)`` for every node that has an edge; ``component`` is the smallest node reachable.

    Nulls and self-loops are ignored; repeated and reversed edges change nothing; no edges give an empty
    table. ``max_rounds`` is a guard for the rounds of stars: they take O(log^2 n), and the guard raises rather than return labels that
    are not final. ``few``: edges that are joined up in one task (``FEW`` if not given).
    """
    few = FEW if few is None else few
    pairs = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    now = cut(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ship(edges.sparkSession)
    passed: list[DataFrame] = []
    count = now.limit(few + 1).count()
    if count > few:
        before = now.count()
        while before > few:
            least, left = shrunk(now)
            after = left.count()
            if 2 * after > before:
                break
            passed.append(least)
            now, before = left, after
        count = min(before, few + 1)
    found = now.repartition(1).mapInArrow(_one_pass, "node long, component long") if count <= few else _by_stars(now, max_rounds)
    for least in reversed(passed):  # a node goes where its centre goes; centres that nothing joined are their own
        found = cut(found)
        centre = least.join(found.select(F.col("node").alias("centre"), "component"), "centre", "left").select("node", F.coalesce("component", "centre").alias("component"))
        roots = least.select(F.col("centre").alias("node")).union(found.select("node")).distinct().join(least, "node", "left_anti")
        roots = roots.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        found = centre.union(roots)
    return found


def _by_stars(now: DataFrame, max_rounds: int) -> DataFrame:
    seen = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        # a forest of stars: no node is both a leaf and a centre, and no leaf has two centres
        state = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))").alias("h"),
        ).first()
        if seen == (state["n"], state["h"]):
            break
        seen = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
