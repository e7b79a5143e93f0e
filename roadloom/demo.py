"""Point and road layers on an integer lattice, made from the driver's tables, so both engines compute exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 2000


def points(spark: SparkSession, sf_dir: str, snap: int = 1) -> DataFrame:
    """``point_idx, x, y`` from ``customer``; ``snap`` moves points to multiples, so that some coincide."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    key = F.col("c_custkey").cast("long")
    x = (key * 7919 + F.col("c_nationkey").cast("long") * 131) % SIDE
    y = F.pmod(F.round(F.col("c_acctbal") * 100).cast("long"), F.lit(SIDE))
    return rows.select(key.alias("point_idx"), (x - x % snap).cast("double").alias("x"), (y - y % snap).cast("double").alias("y"))


def roads(spark: SparkSession, sf_dir: str, bend: int = 0) -> DataFrame:
    """``road_uid, parts`` from ``supplier``: even keys run east, odd keys north, 400 long; with ``bend`` one more edge."""
    key = F.col("s_suppkey").cast("long")
    even = key % 2 == 0
    x1 = F.when(even, (key * 389) % 1600).otherwise((key * 577) % SIDE)
    y1 = F.when(even, (key * 241) % SIDE).otherwise((key * 613) % 1600)
    vertex = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x2, y2 = x1 + F.when(even, 400).otherwise(0), y1 + F.when(even, 0).otherwise(400)
    line = [vertex(x1, y1), vertex(x2, y2), *([vertex(x2 + bend, y2 + bend)] if bend else [])]
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    return rows.select(key.alias("road_uid"), F.array(F.array(*line)).alias("parts"))

