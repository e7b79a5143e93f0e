"""Small tables for the tests of corpus operators."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that operators use themselves.
CLASHING = ["row", "score", "shard", "fp", "component", "size", "old", "pattern", "bin", "key", "word", "class", "n", "trains", "body", "base", "email", "base_", "cands", "_extra", "id", "y", "stay_id"]


def table(spark, rows):
    """Documents with all columns of the real table and some with clashing names."""
    held = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = held.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return held.withColumns({c: F.lit(7) for c in CLASHING})
