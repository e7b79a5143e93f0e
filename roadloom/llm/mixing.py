"""Mixing sources to target sizes by entropy balancing.

Each source has a target, in words. Documents get rates (copies on average) that differ as little as possible from one copy, in relative
entropy in which a document weighs its words plus the mean of its source, while the rates of a source add up to its target and none exceeds
``CAP``. The dual of that problem is convex, with one unknown ``tilt`` for each source, and its solution is an exponential tilt: a document of
``s`` words has the rate ``exp(tilt * s / (s + mean))``, at most ``CAP``. Newton's method, kept inside a bracket, finds all tilts at once.

* Documents of one source and one size have one rate, so each Newton pass is an aggregation over a table of (source, size, count), however
  many documents there are; sums are exact decimals, so the order in which tasks end changes nothing.
* Rates become copies by systematic rounding along the sizes of a source, and what a source then lacks or has too much (about one large
  document) is made up for by single copies, the largest that fit first, from a list of bounded length for each source.
* Which documents of one size get the copies follows a hash of their ids; places come from range partitions and their
  offsets, so a source or a size that holds a third of all rows is dealt over many tasks.

Targets: sources in the order of code points, null last, weigh ``WEIGHTS`` in turn, and share ``SHARE`` of all words; none gets over ``CAP``
times its own, and the excess is shared again until none is above.

Defined cases: null text has no words; a null source is a source, the last one; documents without words are taken once and
count nothing; a source without words has the target 0; repeated rows are rows of their own (which of equal ones is
taken more often is open); a null id is an id like others; an empty table gives an empty result; texts of any length count whole
(about 70 bytes a word of one text are held in the JVM); other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadloom.operators.keys import dense_index
from roadloom.session import cut

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Tables of up to so many rows (of a few numbers) are sent to all tasks.
SENT = 100_000
ROUNDS = 80
EXACT = "decimal(30, 6)"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _few(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks a table of no more rows than ``df`` as one to be sent to all tasks, if that is checked to be small."""
    return F.broadcast if df.limit(SENT + 1).count() <= SENT else lambda other: other


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``target`` and ``full`` (the cap binds) to ``sizes`` (``none, source, source_size``, a row for each source)."""
    if share > cap:
        raise ValueError("the sources can't give more than the cap allows")
    placed = dense_index(sizes, ["none", "source"], "_place")
    placed = cut(placed.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_place") % len(weights) + 1).cast("int"))).drop("_place"))
    most = F.col("source_size") * float(cap)
    first = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, level, held = share * (first["size"] or 0), 0.0, -1
    if first["weight"]:
        level = budget / first["weight"]
    while True:  # the level only rises, so each round caps one more source at least
        at = F.lit(level) * F.col("weight")
        state = placed.agg(F.count_if(most < at).alias("held"), F.coalesce(F.sum(F.when(most < at, most)), F.lit(0.0)).alias("capped"), F.sum(F.when(most >= at, F.col("weight"))).alias("weight")).first()
        if state["held"] == held or not state["weight"]:
            break
        held, level = state["held"], (budget - state["capped"]) / state["weight"]
    at = F.lit(level) * F.col("weight")
    return placed.withColumns({"target": F.least(most, at), "full": most <= at}).drop("weight")


def _exponent(size: Column, mean: Column) -> Column:
    return F.when(size > 0, size / (size + mean)).otherwise(0.0)


def tilts(counts: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Add ``mean`` and ``tilt`` to ``sources``: Newton's method for all of them at once; the cap needs no tilt."""
    keys = ["none", "source"]
    least = counts.groupBy(*keys).agg(F.sum("n").alias("_docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("_least"))
    sent = _few(sources)
    rows = sources.join(sent(least), keys).withColumn("mean", F.col("source_size") / F.col("_docs"))
    low = _exponent(F.col("_least"), F.col("mean"))
    open_ = ~F.col("full") & (F.col("target") > 0)
    rows = rows.withColumns({
        "open": open_, "tilt": F.lit(0.0),
        "low": F.when(open_, F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / low)).otherwise(0.0),
        "high": F.when(open_, F.log(F.lit(float(cap))) / low).otherwise(0.0),
    })
    rows = cut(rows.drop("_docs", "_least"))
    size, n = F.col("size"), F.col("n")
    power = _exponent(size, F.col("mean"))
    rate = F.exp(F.col("tilt") * power)
    for _ in range(ROUNDS):
        at = counts.join(sent(rows.where("open").select(*keys, "mean", "tilt")), keys)
        sums = at.groupBy(*keys).agg(F.sum((n * size * F.least(rate, F.lit(float(cap)))).cast(EXACT)).alias("words"), F.sum(F.when(rate < cap, n * size * power * rate).otherwise(0.0).cast(EXACT)).alias("slope"))
        off = F.col("words").cast("double") - F.col("target")
        settled = F.abs(off) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-10)
        rows = rows.join(sent(cut(sums)), keys, "left").withColumn("off", off).withColumn("open", F.col("open") & ~settled)
        rows = rows.withColumns({"low": F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("high"))})
        step = F.col("tilt") - F.col("off") / F.col("slope").cast("double")
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        rows = rows.withColumn("tilt", F.when(~F.coalesce("open", F.lit(False)), F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
        rows = cut(rows.withColumn("open", F.coalesce("open", F.lit(False))).drop("off", "words", "slope"))
        if rows.where("open").isEmpty():
            break
    return rows.drop("open", "low", "high")


def _made_up(strata: DataFrame, cap: int) -> DataFrame:
    """``none, source, size, more``: copies to add (or, negative, to take away) so that each source meets its target."""
    keys = ["none", "source"]
    off = strata.groupBy(*keys).agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("words"))
    off = cut(off.withColumn("off", F.round(F.col("target")).cast("long") - F.col("words")))
    rows = strata.where("size > 0").join(_few(off)(off.select(*keys, "off")), keys)
    free = F.when(F.col("off") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    rows = rows.withColumn("free", free).where((F.col("free") > 0) & (F.col("off") != 0) & (F.col("size") <= F.abs("off")))
    # of the sizes that lie close together the one with the most room: some hundred for each source, whatever its size
    listed = rows.groupBy(*keys, "off", F.floor(8 * F.log2("size")).alias("_class")).agg(F.max(F.struct("free", "size")).alias("best"))
    listed = listed.groupBy(*keys, "off").agg(F.sort_array(F.collect_list(F.struct(F.col("best.size").alias("size"), F.col("best.free").alias("free"))), False).alias("list"))
    start = F.struct(F.abs("off").alias("left"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("moves"))

    def take(state: Column, item: Column) -> Column:
        more = F.least(item["free"], F.floor(state["left"] / item["size"]))
        return F.struct((state["left"] - more * item["size"]).alias("left"), F.concat(state["moves"], F.array(F.struct(item["size"].alias("size"), more.alias("more")))).alias("moves"))

    moves = listed.select(*keys, F.signum("off").cast("long").alias("_sign"), F.explode(F.aggregate("list", start, take)["moves"]).alias("m"))
    return moves.select(*keys, "m.size", (F.col("m.more") * F.col("_sign")).alias("more")).where("more <> 0")


def copies(counts: DataFrame, rated: DataFrame, cap: int = CAP) -> DataFrame:
    """``none, source, size, n, rate, copies``: the copies that all documents of a source and size get together."""
    keys = ["none", "source"]
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).otherwise(F.least(F.exp(F.col("tilt") * _exponent(F.col("size"), F.col("mean"))), F.lit(float(cap))))
    rows = counts.join(_few(rated)(rated), keys).withColumn("rate", rate)
    part = (F.col("n") * (F.col("rate") - F.floor("rate"))).cast(EXACT)
    along = Window.partitionBy(*keys).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each size that occurs
    rows = rows.withColumn("_part", part).withColumn("_sum", F.sum("_part").over(along))
    whole = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2, 1)")).cast("long")
    rows = rows.withColumn("copies", F.col("n") * F.floor("rate") + whole(F.col("_sum")) - whole(F.col("_sum") - F.col("_part")))
    rows = cut(rows.drop("_part", "_sum"))
    more = cut(_made_up(rows, cap))
    more = rows.join(_few(more)(more), [*keys, "size"], "left")
    return more.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies, rate`` of every document, and the columns named in ``carry``."""
    keys = ["none", "source"]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        word_count(F.col("text")).alias("size"), F.struct(*carry).alias("carried") if carry else F.lit(None).alias("carried"),
    )
    rows = cut(rows)
    counts = cut(rows.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("n")))
    sources = targets(counts.groupBy(*keys).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    strata = cut(copies(counts, tilts(counts, sources, cap), cap))
    placed = dense_index(rows.withColumn("_hash", F.xxhash64("doc_id")), [*keys, "size", "_hash", "doc_id", "row"], "_at")
    first = placed.groupBy(*keys, "size").agg(F.min("_at").alias("_first"))
    strata = cut(strata.withColumnRenamed("copies", "_all").join(first, [*keys, "size"]))
    held = placed.join(_few(strata)(strata), [*keys, "size"])
    each = F.expr("_all div n") + F.when(F.col("_at") - F.col("_first") < F.col("_all") % F.col("n"), 1).otherwise(0)
    held = held.withColumn("copies", each.cast("int")).withColumn("source", F.when(~F.col("none"), F.col("source")))
    out = held.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "rate", "carried")
    return out.select("*", "carried.*").drop("carried") if carry else out.drop("carried")


def repeated(mixed: DataFrame) -> DataFrame:
    """A row for each copy, with ``copy`` from 1; documents that are not taken go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
