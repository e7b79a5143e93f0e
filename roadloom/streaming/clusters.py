"""Clustering of arriving points: what a batch touches is computed again, the rest is kept as state.

With ``eps`` as a cell's side, a new point changes the number of neighbours of points in the 3 x 3 cells around it at most, so only
those can become cores, and only points in the 5 x 5 cells can be linked anew or become border points. The clustering of the 7 x 7 cells
around new points is exact for those, as every neighbour of a point in the 5 x 5 cells is among them. Cores stay cores when
points are added, so components only grow and merge:

* a component is named by its least core; a batch names the components of its new cores and notes which old ones they merge;
* a point that is no core keeps the components of the cores next to it, fewer than ``min_pts``; its cluster is the least of them in the end.

State is four tables in a shared folder, each with a partition for each batch that is only ever added (a batch that is run again replaces its own):
points, rows (the newest row of a point holds), components, and merges. ``labels`` joins them into the same labels that
clustering all points at once gives.

Defined cases: a point index that has arrived before changes nothing, whatever its place; of several in one batch the least row (by place and road) holds;
points with invalid coordinates are noise; late points are points like others; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadloom.functions import geometry as g
from roadloom.operators import dbscan
from roadloom.operators.associate import NONE, sent
from roadloom.operators.components import connected_components
from roadloom.operators.keys import dense_index
from roadloom.operators.roads import allowed_pairs, neighbours
from roadloom.session import cut

_TABLES = {
    "points": "point_idx bigint, x double, y double, road_uid bigint, cx bigint, cy bigint",
    "rows": "point_idx bigint, core boolean, component bigint, near array<bigint>",
    "components": "component bigint",
    "merges": "old bigint, into bigint",
}


class ClusterState:
    """The clusters of all points that have arrived, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, adjacent: DataFrame, eps: float, min_pts: int):
        dbscan.check_arguments(eps, min_pts)
        self.spark, self.path, self.adjacent, self.eps, self.min_pts = spark, path.rstrip("/"), adjacent, float(eps), min_pts
        self.known = neighbours(adjacent)
        for name, schema in _TABLES.items():  # a partition without rows, so that there is something to read
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}/batch=-1")

    def _held(self, name: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{_TABLES[name]}, batch bigint").parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _keep(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _newest(self) -> DataFrame:
        rows = self._held("rows").groupBy("point_idx").agg(F.max_by(F.struct("core", "component", "near"), "batch").alias("r"))
        return rows.select("point_idx", "r.*")

    def _around(self, cells: DataFrame, reach: int) -> DataFrame:
        """The cells that are at most ``reach`` from one of ``cells``, and how far the nearest one is (``away``)."""
        steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(max(abs(i), abs(j))).alias("far")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
        return cells.withColumn("s", F.explode(steps)).groupBy((F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy")).agg(F.min("s.far").alias("away"))

    def update(self, batch: DataFrame, number: int) -> DataFrame:
        """Take in a batch (``point_idx, x, y, road_uid``); returns the points whose rows were computed again."""
        ok = g.valid_point(F.col("x"), F.col("y"))
        cell = lambda c: F.when(ok, F.floor(F.col(c) / self.eps).cast("long"))
        place = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(F.col("road_uid").cast("long"), F.lit(NONE).cast("long")).alias("road_uid"))
        first = batch.where("point_idx is not null").groupBy(F.col("point_idx").cast("long").alias("point_idx")).agg(F.min(place).alias("p")).select("point_idx", "p.*")
        fresh = cut(first.join(self._held("points", number).select("point_idx"), "point_idx", "left_anti").withColumns({"cx": cell("x"), "cy": cell("y")}))
        self._keep("points", fresh, number)
        cells = cut(fresh.where(ok).select("cx", "cy").distinct())
        every = self._held("points").where(F.col("batch") <= number).drop("batch")
        region = cut(every.join(sent(self._around(cells, 3)), ["cx", "cy"]).select("point_idx", "x", "y", "road_uid", "cx", "cy", (F.col("away") <= 2).alias("inner")))
        local = dbscan.cluster(region, self.adjacent, self.eps, self.min_pts, self.known).withColumnRenamed("core", "now")
        before = self._held("rows", number).groupBy("point_idx").agg(F.max_by("component", "batch").alias("component")).join(region.select("point_idx"), "point_idx", "left_semi")
        known = cut(local.join(before, "point_idx", "left").withColumn("was", F.col("component").isNotNull()))
        # components of this batch: what a local cluster's old components and new cores have in common is the cluster, named by the least of them
        inner_cores = known.where("now and inner")
        least = cut(inner_cores.groupBy("cluster").agg(F.min(F.when(F.col("was"), F.col("component")).otherwise(F.col("point_idx"))).alias("least")))
        tied = cut(inner_cores.where("was").select("cluster", F.col("component").alias("node")).distinct().join(least, "cluster"))
        joined = cut(connected_components(tied, "node", "least")).withColumnRenamed("component", "into")
        named = cut(least.join(joined.withColumnRenamed("node", "least"), "least", "left").select("cluster", F.coalesce("into", "least").alias("into")))
        merged = tied.select("node").distinct().join(joined, "node").where("node <> into")
        old = self._held("components", number).select(F.col("component").alias("node"))
        self._keep("merges", merged.join(old, "node", "left_semi").select(F.col("node").alias("old"), "into"), number)
        self._keep("components", named.select(F.col("into").alias("component")).distinct().join(old.withColumnRenamed("node", "component"), "component", "left_anti"), number)
        fresh_core = F.col("now") & F.col("inner")
        cores = known.join(sent(named), "cluster", "left").withColumn("component", F.when(F.col("was"), F.col("component")).when(fresh_core, F.col("into")))
        inside = cores.where("inner")
        near = self._next_to(inside.where("component is null"), cores.where("component is not null"))
        rows = inside.select("point_idx", F.col("component").isNotNull().alias("core"), "component").join(near, "point_idx", "left")
        lost = fresh.where(~ok).select("point_idx", F.lit(False).alias("core"), F.lit(None).cast("long").alias("component"), F.lit(None).cast("array<bigint>").alias("near"))
        self._keep("rows", rows.select("point_idx", "core", "component", "near").union(lost), number)
        return self._held("rows").where(F.col("batch") == number).drop("batch")

    def _next_to(self, border: DataFrame, cores: DataFrame) -> DataFrame:
        """``point_idx, near``: the components of the cores that are neighbours of points that are none."""
        steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        p = border.withColumn("s", F.explode(steps)).select("point_idx", "x", "y", "road_uid", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
        p = sent(cut(p)).alias("p")
        q, close = cores.alias("q"), g.squared(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")) <= self.eps * self.eps
        met = p.join(q, (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy")) & close)
        met = met.select(F.col("p.point_idx").alias("point_idx"), F.col("q.component").alias("component"), F.col("p.road_uid").alias("a"), F.col("q.road_uid").alias("b")).distinct()
        return allowed_pairs(met, self.adjacent, "a", "b", self.known).groupBy("point_idx").agg(F.array_sort(F.collect_set("component")).alias("near"))

    def labels(self) -> DataFrame:
        """``point_idx, x, y, road_uid, core, cluster`` of all points so far."""
        merges = self._held("merges").select("old", "into")
        roots = cut(connected_components(merges, "old", "into"))
        of = self._held("components").select("component").distinct().join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
        of = cut(of.select("component", F.coalesce("root", "component").alias("root")))
        number = dense_index(of.select("root").distinct(), ["root"], "cluster", 1)
        number = of.join(number, "root").select("component", "cluster")
        rows = self._newest().select("point_idx", "core", F.explode(F.when(F.col("core"), F.array("component")).otherwise(F.coalesce("near", F.array().cast("array<bigint>")))).alias("component"))
        found = rows.join(number, "component").groupBy("point_idx").agg(F.min("cluster").alias("cluster"), F.first("core").alias("core"))
        points = self._held("points").drop("batch", "cx", "cy")
        return points.join(found, "point_idx", "left").withColumns({"core": F.coalesce("core", F.lit(False)), "cluster": F.coalesce("cluster", F.lit(dbscan.NOISE)).cast("bigint")})


def cluster_stream(points: DataFrame, state: ClusterState, checkpoint: str, use: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Keep ``state`` up with a stream of associated points; ``use`` gets the rows that each batch computed again."""

    def one(batch: DataFrame, number: int) -> None:
        changed = state.update(batch, number)
        if use is not None:
            use(changed, number)

    return points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
