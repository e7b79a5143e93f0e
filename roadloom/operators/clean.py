"""Cleaning of point and line layers: kinds, validity, keys and reserved names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import geometry as g
from roadloom.operators.keys import dense_index

RESERVED_POINTS = {"road_uid", "dist_to_road", "cluster", "point_idx"}
RESERVED_ROADS = {"road_uid"}


class LayerError(ValueError):
    """A layer that can't be used: no rows, an invalid line, a missing or reserved column."""


def require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise LayerError(f"{what} lack {', '.join(missing)}")


def reject_reserved(df: DataFrame, reserved: set[str], what: str) -> None:
    taken = sorted(reserved & set(df.columns))
    if taken:
        raise LayerError(f"{what} have reserved columns: {', '.join(taken)}")


def clean_points(points: DataFrame, order: str = "record_no") -> DataFrame:
    """Finite points, with the dense ``point_idx`` that decides cluster numbers. Other kinds of geometry go."""
    require(points, ["x", "y", order], "points")
    reject_reserved(points, RESERVED_POINTS, "points")
    if "kind" in points.columns:
        points = points.where(F.col("kind") == "Point")
    kept = points.where(g.valid_point(F.col("x"), F.col("y"))).withColumns({c: F.col(c).cast("double") for c in ("x", "y")})
    return dense_index(kept, [order], "point_idx")


def key_roads(lines: DataFrame, order: str = "record_no") -> DataFrame:
    """Lines with the dense key ``road_uid``: their position, counted before empty ones are dropped."""
    require(lines, ["parts", order], "roads")
    reject_reserved(lines, RESERVED_ROADS, "roads")
    if "kind" in lines.columns:
        lines = lines.where(F.col("kind").isin("LineString", "MultiLineString"))
    return dense_index(lines, [order], "road_uid")


def audit_lines(lines: DataFrame) -> DataFrame:
    """One row: ``total``, ``invalid`` and ``empty`` lines."""
    empty = ~g.non_empty(F.col("parts"))
    return lines.agg(F.count(F.lit(1)).alias("total"), F.count_if(~empty & ~g.valid_line(F.col("parts"))).alias("invalid"), F.count_if(empty).alias("empty"))


def clean_roads(lines: DataFrame, order: str = "record_no", on_invalid: str = "fail") -> DataFrame:
    """Keyed, non-empty roads.

    ``on_invalid='fail'`` raises :class:`LayerError` if any line is invalid (a repair of lines can't succeed);
    ``'drop'`` leaves such lines out. Keys are given before either, so they may have gaps.
    """
    if on_invalid not in ("fail", "drop"):
        raise ValueError("on_invalid is 'fail' or 'drop'")
    keyed = key_roads(lines, order)
    if on_invalid == "fail":
        counts = audit_lines(keyed).first()
        if counts["invalid"]:
            raise LayerError(f"{counts['invalid']} of {counts['total']} lines are invalid")
    kept = keyed.where(g.non_empty(F.col("parts")))
    return kept if on_invalid == "fail" else kept.where(g.valid_line(F.col("parts")))


def merge_uid(joined: DataFrame, name: str = "road_uid") -> DataFrame:
    """One key column after a join that suffixed it: ``<name>_road`` is renamed, a missing one is null."""
    if f"{name}_road" in joined.columns:
        return joined.drop(name).withColumnRenamed(f"{name}_road", name)
    return joined if name in joined.columns else joined.withColumn(name, F.lit(None).cast("bigint"))


def unassociated(uid="road_uid"):
    return F.col(uid).isNull() | (F.col(uid) == -999)


def to_key(value, default: int = -999):
    """A whole number, or ``default`` for null and what isn't a number. Fractions are cut."""
    as_text = value.cast("string")
    return F.coalesce(as_text.try_cast("bigint"), F.when(F.abs(as_text.try_cast("double")) < 9.2e18, as_text.try_cast("double")).try_cast("bigint"), F.lit(default).cast("bigint"))
