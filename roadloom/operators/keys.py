"""Dense row numbers without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadloom.session import cut


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: the position of each row by ``order``, from ``start``, without gaps.

    Rows are range-partitioned and sorted, each partition's size gives the next one's first number. The table is
    materialised, so the numbers don't change when it is read twice. Rows that are equal in ``order`` get numbers in
    any order among themselves.
    """
    held = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    first = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return held.withColumn("_nth", nth).join(F.broadcast(first), "_range").withColumn(name, F.col("_first") + F.col("_nth") - 1 + start).drop("_range", "_nth", "_first")
