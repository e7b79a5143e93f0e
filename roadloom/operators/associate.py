"""Nearest road of each point.

The edges stand in an index over cells of sides ``side``, ``4 side``, ``16 side``, ...: at every level an edge is registered in the
cells it crosses and those around them. A point has to look into its own cell only, and a candidate nearer than one side
is final: whatever it doesn't see is at least one side away. Each point looks at the first level at which its cell holds
anything (found for the points' cells, not for each point), and once more if what it finds there is a side away or more: that distance
names the level at which everything nearer is in sight. So there are three joins (the cells of the lowest level go first), however many levels there are and however far the farthest point is.
The lowest level is read once, by its join, and isn't kept; the others are made only if that join leaves points.
The partial minimum of a point's candidates is taken where the join made them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators.roads import cells_of_edge, edges
from roadloom.session import cut, spread

NONE = -999
#: Up to this many places, or cells of places, are sent to all tasks.
SENT = 100_000
#: A cell's side, in sides of the level below.
STEP = 4
_OUT = "point_idx bigint, road_uid bigint, d2 double"


def edge_index(edge_rows: DataFrame, side: float, levels: int, count: int | None = None) -> DataFrame:
    """Edges (``count`` of them) with ``level, cx, cy`` of each cell within a side of them, so of all they cross and those next to these, once for each level."""
    rows = edge_rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    rows = rows.repartition(spread(edge_rows.sparkSession, count), "x1", "y1", "x2", "y2", "level")  # few edges make many rows
    rows = rows.withColumn("_side", side * F.pow(F.lit(float(STEP)), F.col("level")))
    near = cells_of_edge(F.col("_side"), F.col("_side"))
    return rows.withColumn("cell", F.explode(near)).select("road_uid", "x1", "y1", "x2", "y2", "level", "cell.cx", "cell.cy")


def _first_side(state, places: int, box) -> float:
    """A cell's side: so that the index and the candidates of the points' places are about equally many, but not under the mean gap between roads, nor over
    twice the usual edge or under a 256th of it."""
    usual = 2 * state["median"] if state["median"] else 1.0
    area = (box[1] - box[0]) * (box[3] - box[2])
    gap = area / state["length"] if state["length"] else usual
    return min(usual, max(math.sqrt(2 * area / places), gap, usual / 256))


def sent(rows: DataFrame) -> DataFrame:
    """``rows``, sent to all tasks in a join if there are at most ``SENT``: so that the index needn't move for a few places."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows


def _of_places(points: DataFrame, roads: DataFrame, side: float | None) -> DataFrame | None:
    """``x, y, road_uid, d2`` of every place where valid points are; ``None`` without places or roads."""
    rows = cut(edges(roads).groupBy("x1", "y1", "x2", "y2").agg(F.min("road_uid").alias("road_uid")))  # equal edges are equally near
    todo = cut(points.where(g.valid_point(F.col("x"), F.col("y"))).select("x", "y").distinct())  # a place is looked up once
    low, high = (lambda *cs: F.min(F.least(*cs))), (lambda *cs: F.max(F.greatest(*cs)))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    of_edges = rows.agg(low("x1", "x2"), high("x1", "x2"), low("y1", "y2"), high("y1", "y2"), F.sum(length).alias("length"), F.percentile_approx(length, 0.5).alias("median"), F.count(F.lit(1)).alias("edges")).first()
    of_points = todo.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1)).alias("places")).first()
    if of_edges[0] is None or of_points[0] is None:
        return None
    side = side or _first_side(of_edges, of_points["places"], of_edges)
    extent = max(max(of_edges[k + 1], of_points[k + 1]) - min(of_edges[k], of_points[k]) for k in (0, 2))
    last = max(0, math.ceil(math.log(max(extent / side, 1.0), STEP) + 1e-9))  # there no cell is more than one off another
    index = edge_index(rows, side, last + 1, of_edges["edges"])
    size = lambda level: side * F.pow(F.lit(float(STEP)), level)
    at = lambda c: F.floor(F.col(c) / size(F.col("level"))).cast("long")

    def best(rows: DataFrame, index: DataFrame, how: str = "inner") -> DataFrame:
        placed = rows.select("x", "y", "level", at("x").alias("cx"), at("y").alias("cy"))
        met = placed.join(index, ["level", "cx", "cy"], how).withColumn("d2", g.point_edge_squared(F.col("x"), F.col("y"), {k: F.col(k) for k in ("x1", "y1", "x2", "y2")}))
        found = met.groupBy("x", "y", "level").agg(F.min(F.struct("d2", "road_uid")).alias("best"))
        return found.select("x", "y", "level", F.col("best.road_uid").alias("road_uid"), F.col("best.d2").alias("d2"))

    # most places have something near in their cell of the first level; the cells of those without anything are looked up at all levels
    out = ["x", "y", "road_uid", "d2"]
    seen = cut(best(todo.withColumn("level", F.lit(0)), index.where("level = 0"), "left"))
    final = (F.col("level") == last) | (F.col("d2") < size(F.col("level")) * size(F.col("level")))
    held = F.col("d2").isNotNull() & final
    far = cut(seen.where(~held))
    if far.isEmpty():
        return seen.select(*out)
    coarse = cut(index.where("level > 0"))
    found, met = seen.where(held).select(*out), far.where("d2 is not null")
    left = far.where("d2 is null").select("x", "y")
    if not left.isEmpty():
        cell = {"px": F.floor(F.col("x") / side).cast("long"), "py": F.floor(F.col("y") / side).cast("long")}
        up = lambda c: F.floor(F.col(c) / F.pow(F.lit(float(STEP)), F.col("level"))).cast("long")
        cells = left.select(*(c.alias(k) for k, c in cell.items())).distinct().withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(max(last, 1)))))
        cells = sent(cells.withColumns({"cx": up("px"), "cy": up("py")}))
        held_cells = coarse.select("level", "cx", "cy").distinct()  # of the highest levels a few cells hold all edges, and all places
        first = held_cells.join(cells, ["level", "cx", "cy"]).groupBy("px", "py").agg(F.min("level").alias("level"))
        late = cut(best(sent(cut(left.withColumns(cell).join(first, ["px", "py"]).drop("px", "py"))), coarse))
        found, met = found.union(late.where(final).select(*out)), met.union(late.where(~final))
    wanted = F.floor(F.log2(F.sqrt("d2") / side) / math.log2(STEP)).cast("int") + 1
    wanted = F.when(size(wanted) * size(wanted) > F.col("d2"), wanted).otherwise(wanted + 1)
    again = cut(met.select("x", "y", F.least(wanted, F.lit(last)).alias("level")))
    return found if again.isEmpty() else found.union(cut(best(sent(again), coarse)).select(*out))


def nearest(points: DataFrame, roads: DataFrame, side: float | None = None) -> DataFrame:
    """``point_idx, road_uid, d2`` (squared distance) of every valid point; the lowest ``road_uid`` of equally near roads.

    No roads give no rows.
    """
    found = _of_places(points, roads, side)
    if found is None:
        return points.sparkSession.createDataFrame([], _OUT)
    return points.select("point_idx", "x", "y").join(found, ["x", "y"]).select("point_idx", "road_uid", "d2")


def associate(points: DataFrame, roads: DataFrame, side: float | None = None) -> DataFrame:
    """``points`` with ``road_uid`` (-999: none) and ``dist_to_road``. All points stay."""
    found = _of_places(points, roads, side)
    if found is None:
        return points.withColumns({"dist_to_road": F.lit(None).cast("double"), "road_uid": F.lit(NONE).cast("bigint")})
    found = found.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("road_uid").alias("_uid"), F.sqrt("d2").alias("dist_to_road"))
    joined = points.join(found, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left")
    return joined.withColumn("road_uid", F.coalesce("_uid", F.lit(NONE).cast("bigint"))).drop("_uid", "_x", "_y")


def association_counts(associated: DataFrame) -> DataFrame:
    """One row: ``associated`` and ``unassociated`` points."""
    none = F.col("road_uid").isNull() | (F.col("road_uid") == NONE)
    return associated.agg(F.count_if(~none).alias("associated"), F.count_if(none).alias("unassociated"))
