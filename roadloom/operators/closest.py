"""Which groups of points come within a distance of each other, without comparing all of their points.

Both groups of a pair are cut into ever smaller cells (``SPLIT`` a side at each level), of which only the tight boxes, a point of each and
the number of points are looked at. A pair of cells whose boxes are too far apart is dropped; one whose boxes are near enough as a
whole, or whose two chosen points are, settles the pair of groups; of the others, those with at most ``LEAF`` pairs of
points are compared point by point and the rest is cut further. A settled pair of groups takes all its cells out, so what is compared
follows the line along which two groups face each other, not the product of their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.session import cut

#: Cells a side that a cell is cut into; pairs of points that are compared at once; levels before all that is left is compared.
SPLIT, LEAF, DEEPEST = 4, 1024, 16


def _cells(points: DataFrame, side: float) -> DataFrame:
    """``group, cx, cy, n``, the box and one point of each cell."""
    place = {k: F.floor(F.col(c) / side).cast("long") for k, c in (("cx", "x"), ("cy", "y"))}
    box = [f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in ((1, F.min), (2, F.max))]
    return points.withColumns(place).groupBy("group", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), *box, F.min(F.struct("x", "y")).alias("one"))


def _of(cells: DataFrame, side: str) -> DataFrame:
    return cells.select(*(F.col(c).alias(f"{c}_{side}") for c in ("group", "cx", "cy", "n", "x1", "x2", "y1", "y2", "one")))


def _gap(c: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{c}1_a") - F.col(f"{c}2_b"), F.col(f"{c}1_b") - F.col(f"{c}2_a"))


def _span(c: str) -> Column:
    return F.greatest(F.abs(F.col(f"{c}2_a") - F.col(f"{c}1_b")), F.abs(F.col(f"{c}2_b") - F.col(f"{c}1_a")))


def _judged(rows: DataFrame, reach: float) -> DataFrame:
    """Pairs of cells that may hold near points, with ``linked`` where they surely do."""
    limit = F.lit(reach * reach)
    ones = g.squared(F.col("one_a.x"), F.col("one_a.y"), F.col("one_b.x"), F.col("one_b.y"))
    near = rows.where(_gap("x") * _gap("x") + _gap("y") * _gap("y") <= limit)
    linked = (_span("x") * _span("x") + _span("y") * _span("y") <= limit) | (ones <= limit)
    return near.select("group_a", "cx_a", "cy_a", "n_a", "group_b", "cx_b", "cy_b", "n_b", linked.alias("linked"))


def levels(pairs: DataFrame, points: DataFrame, reach: float, side: float) -> Iterator[tuple[DataFrame, DataFrame, float]]:
    """Of each level: the pairs of groups it settled, the pairs of cells it compares point by point, and its cells' side."""
    groups = pairs.select(F.col("a").alias("group")).union(pairs.select(F.col("b").alias("group"))).distinct()
    points = cut(points.select("group", "x", "y").join(groups, "group", "left_semi"))
    cells = cut(_cells(points, side))
    a, b = _of(cells, "a"), _of(cells, "b")
    rows = pairs.select("a", "b").join(a, F.col("a") == F.col("group_a")).join(b, F.col("b") == F.col("group_b"))
    for level in range(DEEPEST + 1):
        rows = cut(_judged(rows, reach))
        settled = cut(rows.where("linked").select("group_a", "group_b").distinct())
        left = rows.join(settled, ["group_a", "group_b"], "left_anti")
        few = (F.col("n_a") * F.col("n_b") <= LEAF) | F.lit(level == DEEPEST)
        yield settled.toDF("a", "b"), left.where(few), side
        left = cut(left.where(~few).select("group_a", "cx_a", "cy_a", "group_b", "cx_b", "cy_b"))
        if left.isEmpty():
            return
        side /= SPLIT
        groups = left.select(F.col("group_a").alias("group")).union(left.select(F.col("group_b").alias("group"))).distinct()
        cells = cut(_cells(points.join(groups, "group", "left_semi"), side))
        up = lambda k: F.floor(F.col(f"c{k}") / SPLIT).cast("long")
        inner = cells.withColumns({"up_x": up("x"), "up_y": up("y")})
        a, b = (_of(inner, s).join(inner.select(F.col("group").alias(f"group_{s}"), F.col("cx").alias(f"cx_{s}"), F.col("cy").alias(f"cy_{s}"), F.col("up_x").alias(f"px_{s}"), F.col("up_y").alias(f"py_{s}")), [f"group_{s}", f"cx_{s}", f"cy_{s}"]) for s in "ab")
        parents = left.withColumnsRenamed({"cx_a": "px_a", "cy_a": "py_a", "cx_b": "px_b", "cy_b": "py_b"})
        rows = parents.join(a, ["group_a", "px_a", "py_a"]).join(b, ["group_b", "px_b", "py_b"])


def compared(leaves: DataFrame, points: DataFrame, reach: float, side: float) -> DataFrame:
    """Pairs of groups of which two points in the cells of ``leaves`` are near."""
    place = {k: F.floor(F.col(c) / side).cast("long") for k, c in (("cx", "x"), ("cy", "y"))}
    placed = points.select("group", "x", "y").withColumns(place)
    of = lambda s: placed.select(*(F.col(c).alias(f"{c}_{s}") for c in ("group", "cx", "cy", "x", "y")))
    met = leaves.join(of("a"), ["group_a", "cx_a", "cy_a"]).join(of("b"), ["group_b", "cx_b", "cy_b"])
    near = g.squared(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")) <= reach * reach
    return met.where(near).select(F.col("group_a").alias("a"), F.col("group_b").alias("b")).distinct()


def touching(pairs: DataFrame, points: DataFrame, reach: float, side: float) -> DataFrame:
    """Those ``pairs`` (``a, b``) of groups of which two ``points`` (``group, x, y``) are at most ``reach`` apart.

    Groups should each lie in one cell of ``side``; larger ones are right but slower.
    """
    out = None
    for settled, leaves, cell in levels(pairs, points, reach, side):
        found = settled.union(compared(leaves, points, reach, cell))
        out = found if out is None else out.union(found)
    return out.distinct()
