"""Resampling documents by how much they look like a target (importance weights of hashed n-grams).

Every run of ``low`` to ``high`` words is a feature and falls into one of ``buckets`` by its checksum. A bucket's gain is the
logarithm of its share in the target over its share in the corpus, in whole thousandths and smoothed by one; a document weighs the mean gain of
its features, plus a Gumbel variable from a hash of its id, so that the documents with the highest scores are a draw
without replacement in proportion to the weights.

All of it is DataFrame functions: features are exploded and counted by bucket (at most ``buckets`` rows leave a task), the
gains are a table of ``buckets`` rows and so may be broadcast, and features are added up to one row a document before that
leaves its task. Ranks come from range partitions and their offsets; only ids and scores are sorted.

Defined cases: null and blank texts have no features and weigh 0; a null id is hashed as an empty one and comes last
among equals; repeated rows are rows of their own, and which of several equal ones has the lower rank is open; ties go to the
smaller id; an empty corpus gives an empty table; an empty target has only smoothed shares; other columns are ignored. One text's
words are held at a time, about 70 bytes each, in the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators.keys import dense_index
from roadloom.session import cut

#: Words: all of ASCII but digits and letters parts them; A-Z counts as a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _runs(held: str, low: int, high: int) -> Column:
    """The features of the words in column ``held``, repeats included."""
    if low == high == 1:
        return F.col(held)

    def of(k: int) -> Column:
        if k == 1:
            return F.col(held)
        starts = F.when(F.size(held) >= k, F.sequence(F.lit(1), F.size(held) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.array_join(F.slice(held, at, k), " "))

    return F.concat(*(of(k) for k in range(low, high + 1)))


def bucketed(table: DataFrame, keep: list[str], low: int, high: int, buckets: int) -> DataFrame:
    """``keep`` and ``bucket``: a row for each feature, and one with a null bucket for a text without any."""
    held = table.withColumn("_words", words(F.col("text"))).select(*keep, "_words")
    rows = held.withColumn("_n_words", F.size("_words").cast("long")).select(*keep, "_n_words", F.explode_outer(_runs("_words", low, high)).alias("feature"))
    return rows.withColumn("bucket", F.pmod(F.crc32(F.encode("feature", "UTF-8")), F.lit(buckets)).cast("int")).drop("feature")


def bucket_counts(table: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    return bucketed(table, [], low, high, buckets).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))


def gains(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket."""
    spark = docs.sparkSession
    counts = bucket_counts(docs, low, high, buckets).select("bucket", F.col("count").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = counts.union(bucket_counts(target, low, high, buckets).select("bucket", F.lit(0).cast("long"), "count"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    held = cut(counts.union(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = held.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    share = lambda c, n: (F.col(c) + 1).cast("double") * F.lit(float(n + buckets))
    return held.select("bucket", F.floor(1000 * F.log(share("t", total["s"]) / share("s", total["t"]))).alias("gain"))


def scores(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` and ``row``, a number of its own for each row."""
    table = F.broadcast(gains(docs, target, low, high, buckets))  # ``buckets`` rows of two numbers
    keep = ["row", "doc_id"]
    rows = bucketed(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), keep, low, high, buckets)
    held = rows.join(table, "bucket", "left").groupBy("row", "doc_id", "_n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gains - pmod(gains, n_features)) div n_features"))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)
    held = held.select("row", "doc_id", F.col("_n_words").alias("n_words"), "n_features", weight.alias("weight"))
    return held.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: ``percent`` of the documents of at least ``least_words`` words have a rank."""
    held = cut(scores(docs, target, low, high, buckets, seed))
    enough = F.col("n_words") >= least_words
    drawn = held.where(enough).count() * percent // 100
    order = held.where(enough).withColumns({"_down": -F.col("score"), "_no_id": F.col("doc_id").isNull()})
    placed = dense_index(order, ["_down", "_no_id", "doc_id", "row"], "rank", 1)
    out = ["doc_id", "n_features", "weight", "score"]
    placed = placed.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return placed.union(held.where(~enough).select(*out, F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with ``rank``; all rows of an id that stands more than once share the lowest."""
    ranks = resample(docs, target, **settings).where("rank is not null and doc_id is not null").groupBy("doc_id").agg(F.min("rank").alias("rank"))
    return docs.drop("rank").join(ranks, "doc_id")
