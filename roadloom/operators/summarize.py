"""What is told of clusters: counts, sizes, centroids, hulls and the summary table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.session import ship

RING = "array<struct<x:double,y:double>>"


def real(labelled: DataFrame) -> DataFrame:
    """Points of clusters proper."""
    return labelled.where("cluster > 0")


def sizes(labelled: DataFrame) -> DataFrame:
    """``cluster, size``; all rows count, also equal ones."""
    return real(labelled).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def centroids(labelled: DataFrame) -> DataFrame:
    """``cluster, x, y``: the mean of the distinct points."""
    return real(labelled).select("cluster", "x", "y").distinct().groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def _chain(key: np.ndarray, x: np.ndarray, y: np.ndarray, sign: int) -> np.ndarray:
    """Places of the lower (``sign`` 1) or upper (-1) hull of each run of equal ``key``; rows are different and sorted by key, x, y.

    A point that doesn't turn the right way between its neighbours is no corner. All such points are found at once and every other one of a
    run goes, until none is left: a few passes over arrays, where a stack takes a step for each point.
    """
    at = np.arange(len(key))
    while len(at) > 2:
        a, b, c = at[:-2], at[1:-1], at[2:]
        turn = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
        flat = np.zeros(len(at), bool)
        flat[1:-1] = (sign * turn <= 0) & (key[a] == key[c])
        if not flat.any():
            break
        place = np.arange(len(at))
        nth = place - np.maximum.accumulate(np.where(flat, -1, place))
        at = at[~(flat & (nth % 2 == 1))]
    return at


def hull_corners(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different rows, and the places of the lower and upper hull of each key among them."""
    order = np.lexsort((y, x, key))
    key, x, y = key[order], x[order], y[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    key, x, y = key[fresh], x[fresh], y[fresh]
    return key, x, y, _chain(key, x, y, 1), _chain(key, x, y, -1)


def convex_ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull of points, counter-clockwise from the lowest; fewer than three if it has no area. Turns are taken without a tolerance."""
    x, y = (np.array(c, float) for c in zip(*points)) if points else (np.zeros(0), np.zeros(0))
    _, x, y, low, high = hull_corners(np.zeros(len(x), np.int64), x, y)
    ring = np.concatenate([low, high[-2:0:-1]])
    return list(zip(x[ring].tolist(), y[ring].tolist()))


def outermost(points: DataFrame) -> DataFrame:
    """``points`` (``cluster, x, y``) but for those strictly inside the octagon of their cluster's outermost points, which are no corners."""
    at = F.struct("x", "y")
    keys = [("y", 1), ("x-y", -1), ("x", -1), ("x+y", -1), ("y", -1), ("x-y", 1), ("x", 1), ("x+y", 1)]  # counter-clockwise from the south
    place = {"x": F.col("x"), "y": F.col("y"), "x+y": F.col("x") + F.col("y"), "x-y": F.col("x") - F.col("y")}
    ring = points.groupBy("cluster").agg(F.array(*((F.min_by if sign > 0 else F.max_by)(at, place[k]) for k, sign in keys)).alias("ring"))
    a, b = (lambda s: s["a"]), (lambda s: s["b"])
    sides = F.zip_with("ring", F.concat(F.slice("ring", 2, 7), F.slice("ring", 1, 1)), lambda p, q: F.struct(p.alias("a"), q.alias("b")))
    dx, dy = (lambda s: b(s)["x"] - a(s)["x"]), (lambda s: b(s)["y"] - a(s)["y"])
    px, py = (lambda s: F.col("x") - a(s)["x"]), (lambda s: F.col("y") - a(s)["y"])
    beyond = lambda s: ((dx(s) != 0) | (dy(s) != 0)) & (dx(s) * py(s) - dy(s) * px(s) <= 1e-9 * (F.abs(dx(s)) + F.abs(dy(s))) * (F.abs(px(s)) + F.abs(py(s))))
    few = F.size(F.array_distinct("ring")) < 3
    return points.join(ring, "cluster").where(few | F.exists(sides, beyond)).select("cluster", "x", "y")


def hulls(labelled: DataFrame) -> DataFrame:
    """``cluster, ring, area`` of clusters whose hull is a polygon; the ring is closed.

    Points inside the octagon of their cluster's outermost points go first, then every batch reduces what it holds of a cluster to its own
    hull's corners, so a group holds corners only, however large its cluster is. Points stay in arrays throughout.
    """

    def columns(table, names: str) -> list[np.ndarray]:
        return [table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in names.split()]

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, x, y, low, high = hull_corners(*columns(batch, "cluster x y"))
            some = np.union1d(low, high)
            yield pa.record_batch([pa.array(key[some]), pa.array(x[some]), pa.array(y[some])], ["cluster", "x", "y"])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        _, x, y, low, high = hull_corners(*columns(table, "cluster x y"))
        at = np.concatenate([low, high[-2:0:-1], low[:1]])
        n = 1 if len(at) > 3 else 0
        ring = pa.StructArray.from_arrays([pa.array(x[at[: n * len(at)]]), pa.array(y[at[: n * len(at)]])], ["x", "y"])
        return pa.table({"cluster": pa.array([key[0].as_py()] * n, pa.int64()), "ring": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(at)), ring)})

    ship(labelled.sparkSession)
    rows = outermost(real(labelled).where(g.valid_point(F.col("x"), F.col("y"))).select(F.col("cluster").cast("bigint").alias("cluster"), "x", "y"))
    rings = rows.mapInArrow(corners, "cluster bigint, x double, y double").groupBy("cluster").applyInArrow(one, f"cluster bigint, ring {RING}")
    return rings.withColumn("area", g.shoelace(F.col("ring"))).where(F.col("area") > 0)


def summary(labelled: DataFrame) -> DataFrame:
    """``Cluster_ID, Size, Centroid_X, Centroid_Y, Hull_Area``, one row per cluster, unordered; areas may be null."""
    joined = sizes(labelled).join(centroids(labelled), "cluster", "left").join(hulls(labelled).select("cluster", "area"), "cluster", "left")
    return joined.select(F.col("cluster").alias("Cluster_ID"), F.col("size").alias("Size"), F.col("x").alias("Centroid_X"), F.col("y").alias("Centroid_Y"), F.col("area").alias("Hull_Area"))


def ordered(table: DataFrame) -> DataFrame:
    """The largest clusters first; equal ones by number."""
    return table.orderBy(F.desc("Size"), "Cluster_ID")


def observed_counts() -> dict[str, Column]:
    """The counts of :func:`run_counts` as metrics to observe; clusters are numbered without gaps, so the last number is their count."""
    c = F.col("cluster")
    return {"points": F.count(F.lit(1)), "clusters": F.max(F.when(c > 0, c)), "noise": F.count_if(c == -1), "clustered": F.count_if(c > 0), "unclassified": F.count_if(c == 0)}


def run_counts(labelled: DataFrame) -> DataFrame:
    """One row: ``points, clusters, noise, clustered, unclassified``."""
    c = F.col("cluster")
    return labelled.agg(
        F.count(F.lit(1)).alias("points"), F.countDistinct(F.when(c > 0, c)).alias("clusters"), F.count_if(c == -1).alias("noise"),
        F.count_if(c > 0).alias("clustered"), F.count_if(c == 0).alias("unclassified"),
    )
