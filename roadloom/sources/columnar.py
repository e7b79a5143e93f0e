"""Layers as partitioned Parquet: the twin of the single-file layers, for what a cluster writes and reads.

A layer is a folder. Rows are laid out along a curve that keeps near ones together, about ``ROWS`` a file, each with its geometry as well-known
binary and its box (``box_x1, box_y1, box_x2, box_y2``). A manifest, itself a small Parquet table, has a row for each file: its name, its box
and its number of rows, and the layer's system. It is written last, in one step of Spark's file system, and readers go by it only, so an
unfinished or failed write is never seen. Neither the driver nor a task's own disk holds any rows.

Reading with a box opens only files whose boxes meet it (one line of the manifest each is looked at), and the row boxes, which are
plain columns that Parquet has statistics of, are compared in the scan.

Defined cases: rows without a geometry (null, empty or not finite) are kept, in files without a box, and are in no box; an empty table is a layer without
files; a layer is replaced by writing it again, and readers that opened it before keep the files they had.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.crs import Crs, parse, to_wkt
from roadloom.functions.geometry import finite, valid_point, with_wkb

ROWS = 500_000
BOX = ["box_x1", "box_y1", "box_x2", "box_y2"]
_BITS = 16
_MANIFEST = "file string, rows bigint, box_x1 double, box_y1 double, box_x2 double, box_y2 double, crs string, data string, schema string"


def with_box(df: DataFrame) -> DataFrame:
    """Add the box of points (``x, y``), lines (``parts``) or polygons (``ring``); nulls without a geometry."""
    if "parts" in df.columns or "ring" in df.columns:
        vertices = F.flatten("parts") if "parts" in df.columns else F.col("ring")
        good = F.filter(vertices, lambda v: finite(v["x"]) & finite(v["y"]))
        edge = {c: F.transform(good, lambda v: v[c]) for c in "xy"}  # noqa: B023
        return df.withColumns({"box_x1": F.array_min(edge["x"]), "box_y1": F.array_min(edge["y"]), "box_x2": F.array_max(edge["x"]), "box_y2": F.array_max(edge["y"])})
    at = {c: F.when(valid_point(F.col("x"), F.col("y")), F.col(c)) for c in "xy"}
    return df.withColumns({"box_x1": at["x"], "box_y1": at["y"], "box_x2": at["x"], "box_y2": at["y"]})


def curve(x: Column, y: Column) -> Column:
    """The place along the curve of two numbers from 0 to 1: their bits in turn."""

    def spread(v: Column) -> Column:
        v = F.least(F.greatest(F.floor(v * (1 << _BITS)), F.lit(0)), F.lit((1 << _BITS) - 1)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def write(df: DataFrame, path: str, crs: Crs, rows_per_file: int = ROWS) -> None:
    """Write a layer (``x, y``, ``parts`` or ``ring`` and attributes) to the folder ``path``."""
    if clash := {*BOX, "wkb"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are made by the layer")
    spark = df.sparkSession
    shape = [c for c in ("x", "y", "parts", "ring") if c in df.columns]
    boxed = with_box(df)
    whole = boxed.agg(*(f(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)), F.count(F.lit(1))).first()
    folder = f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"
    if whole[4]:
        low_x, low_y, high_x, high_y = (v if v is not None else 0.0 for v in whole[:4])
        middle = lambda c, low, high: (F.col(f"box_{c}1") / 2 + F.col(f"box_{c}2") / 2 - low) / ((high - low) or 1.0)
        placed = boxed.withColumn("_place", F.coalesce(curve(middle("x", low_x, high_x), middle("y", low_y, high_y)), F.lit(-1).cast("long")))
        files = max(1, -(-whole[4] // rows_per_file))
        dealt = placed.repartitionByRange(files, "_place", F.xxhash64(*BOX)).sortWithinPartitions("_place").drop("_place")
        with_wkb(dealt).drop(*shape).write.parquet(folder)
        box = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)]
        held = spark.read.parquet(folder).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("rows"), *box)
    else:
        held = spark.createDataFrame([(None,) * 6], _MANIFEST.split(", crs")[0])
    schema = with_wkb(boxed.limit(0)).drop(*shape).schema.json()
    told = held.withColumns({"crs": F.lit(to_wkt(crs)), "data": F.lit(folder), "schema": F.lit(schema)})
    told.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")  # a row for each file


def manifest(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The files of a layer; with ``box`` (x1, y1, x2, y2) those that may hold rows that meet it."""
    held = spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    return held if box is None else held.where(_meets(box) | F.col("file").isNull())


def _meets(box: tuple[float, float, float, float]) -> Column:
    x1, y1, x2, y2 = map(float, box)
    return (F.col("box_x1") <= x2) & (F.col("box_x2") >= x1) & (F.col("box_y1") <= y2) & (F.col("box_y2") >= y1)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, Crs]:
    """The rows of a layer (those whose boxes meet ``box``), with ``wkb`` and box columns, and its system."""
    first = manifest(spark, path).first()
    kept = [r["file"] for r in manifest(spark, path, box).where("file is not null").select("file").collect()]  # a name for each file
    schema = T.StructType.fromJson(json.loads(first["schema"]))
    rows = spark.read.schema(schema).parquet(*(f"{first['data']}/{f}" for f in kept)) if kept else spark.createDataFrame([], schema)
    return (rows if box is None else rows.where(_meets(box))), parse(first["crs"])
