"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover. DataFrame functions only.

Fixed patterns give the base spans. Each is a seed: the words around the whole span are lexical patterns (the two before
it; the one before and the one after). Words are runs of letters and digits, digits count as 0, and ``NEAR`` characters to either side are seen.
Candidates are the tokens between blanks that hold a digit and that no base span touches. Patterns and instances form a bipartite graph. A
seed's instance is its kind and value; a candidate's is its token, or, if that has under ``LONG`` characters or ``DIGITS`` digits and so
names nothing by itself, the token with the word before it. In each of ``ROUNDS`` rounds a
pattern's confidence becomes the mean score of its distinct instances (smoothed by one bad one) if at least
``SUPPORT`` of them score, and an unseen instance's score becomes 1 - product(1 - confidence) over its confident patterns. Candidates
whose instance's score reaches ``ACCEPT`` are spans of kind ``identifier``, wherever they stand.

A text's matches are placed without positions from the engine: ``split`` by a pattern gives what stands between
the matches that ``regexp_extract_all`` gives, so running sums of lengths are the code point offsets. The
patterns use possessive repeats and look-behinds, which match the same spans as the plain ones but neither
backtrack quadratically nor recurse on very long runs. Long texts are read whole: arrays of n spans are worked on in
about sqrt(n) runs, each with its own stretch of the text, so that time grows with the length times sqrt(n) at most; a row holds a few copies
of its text and some 100 bytes a span.

Defined cases: null text is empty (no spans); repeated rows have their own spans and count as one instance in the
graph; null ids are kept; an empty table gives an empty result; other columns are ignored by ``find`` and kept
by ``redact``, which leaves null texts null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.session import cut

KINDS = ["email", "ip", "card", "phone"]
# The base patterns, in forms that don't backtrack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
ROUNDS, SUPPORT, CONFIDENT, ACCEPT, NEAR = 3, 3, 0.6, 0.8, 64
LONG, DIGITS = 6, 3
#: Parts into which the edges of one pattern are dealt when they meet its confidence.
SALTS = 16
#: Up to this many documents with discovered spans are sent to all tasks when redacting; more are shuffled.
BROADCAST_ROWS = 20_000
_SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; expressions inside functions on arrays are computed for each element."""
    return F.transform(F.array(value), use)[0]


def _chunks(items: Column) -> Column:
    """An array cut into about as many runs as each is long, so that growing arrays stay short."""
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"))
    runs = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
    return F.when(F.size(items) > 0, F.transform(runs, lambda k: F.slice(items, k * size + 1, size))).otherwise(F.array())


def _before(values: Column, least: Column, join) -> Column:
    """For each number of an array what ``join`` makes of all before it, starting with ``least``."""
    start = F.struct(least.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _spans(text: Column, pattern: str) -> Column:
    """All matches with code point offsets."""
    zero = F.lit(0).cast("long")

    def paired(hits: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        return F.zip_with(between, hits, lambda g, h: F.struct(F.length(g).cast("long").alias("gap"), F.length(h).cast("long").alias("long"), h.alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        one = F.array(F.struct(a.alias("start"), (a + x["long"]).alias("end"), x["hit"].alias("hit")))
        return F.struct((a + x["long"]).alias("at"), F.concat(acc["out"], one).alias("out"))

    def placed(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])

    def located(runs: Column) -> Column:
        lengths = F.transform(runs, lambda run: F.aggregate(run, zero, lambda n, x: n + x["gap"] + x["long"]))
        return F.flatten(F.zip_with(runs, _before(lengths, zero, lambda a, b: a + b), placed))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: _let(paired(hits), lambda pairs: _let(_chunks(pairs), located)))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: F.when(k % 2 == 1, F.substring(back, k, 1).cast("int")).otherwise(2 * F.substring(back, k, 1).cast("int") - F.when(F.substring(back, k, 1).cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(hit))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _validator(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _labelled(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def with_base(df: DataFrame, text: str = "body") -> DataFrame:
    """Add a column of base spans for each kind. ``text`` must not be null."""
    body = F.col(text)
    none = F.array().cast(_SPAN)
    has_digit = body.rlike("[0-9]")
    gates = {"email": F.contains(body, F.lit("@")), "ip": has_digit, "card": has_digit, "phone": has_digit & F.contains(body, F.lit("+"))}
    df = df.withColumns({f"_{k}": F.when(gates[k] & body.rlike(PATTERNS[k]), _spans(body, PATTERNS[k])).otherwise(none) for k in KINDS})
    return df.withColumns({k: F.filter(f"_{k}", _validator(k)) for k in KINDS}).drop(*(f"_{k}" for k in KINDS))


def _candidates(text: str = "body") -> Column:
    """Tokens with digits and their offsets, without what is no letter or digit at their ends."""

    def trimmed(s: Column) -> Column:
        lead, tail = F.length(F.regexp_extract(s["hit"], r"^[^\p{L}\p{N}+]*+", 0)), F.length(F.regexp_extract(F.substring(s["hit"], -NEAR, NEAR), r"[^\p{L}\p{N}]*$", 0))
        token = F.lower(F.regexp_replace(s["hit"], r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", ""))
        return F.struct((s["start"] + lead).alias("start"), F.greatest(s["start"] + lead, s["end"] - tail).alias("end"), token.alias("token"))

    kind = "array<struct<start:bigint,end:bigint,token:string>>"
    return F.when(F.col(text).rlike("[0-9]"), F.transform(_spans(F.col(text), TOKEN), trimmed)).otherwise(F.array().cast(kind)).cast(kind)


def _runs(items: Column, of_run) -> Column:
    """``of_run`` of the runs that ``_chunks`` cuts, put together again."""
    return F.flatten(F.transform(_chunks(items), of_run))


def _untouched(cands: Column, base: Column) -> Column:
    """Candidates that no base span touches. Each run of candidates meets the spans around it only."""

    def of_run(run: Column) -> Column:
        low, high = F.element_at(run, 1)["start"], F.array_max(F.transform(run, lambda c: c["end"]))
        near = F.filter(base, lambda b: (b["start"] < high) & (b["end"] > low))
        return _let(near, lambda spans: F.filter(run, lambda c: ~F.exists(spans, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))))

    return _runs(cands, of_run)


def _named(kind: str):
    """A base span as a seed. Cards and phones are the same whatever stands between their digits."""
    value = (lambda hit: _digits(hit)) if kind in ("card", "phone") else F.lower
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), value(s["hit"]).alias("token"), F.lit(kind).alias("kind"))


def _slots(body: Column) -> Column:
    """Seeds and candidates in their order: offsets, instance, and the patterns they stand in (null if no word stands before)."""
    cands = _untouched(F.col("cands"), F.col("base"))
    unseen = F.transform(cands, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"), F.lit("").alias("kind")))
    words = lambda part: F.filter(F.split(F.lower(F.translate(part, "123456789", "0" * 9)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    nth = lambda around, k: F.coalesce(F.try_element_at(around, F.lit(k)), F.lit(""))

    def slot(s: Column, around: Column) -> Column:
        left2, left1, right1 = nth(around["before"], -2), nth(around["before"], -1), nth(around["after"], 1)
        vague = (s["kind"] == "") & ((F.length(s["token"]) < LONG) | (F.length(_digits(s["token"])) < DIGITS))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            (s["kind"] != "").alias("seed"),
            F.xxhash64(s["kind"], s["token"], F.when(vague, left1)).alias("instance"),
            F.when(left1 != "", F.array(F.xxhash64(F.lit(1), left2, left1), F.xxhash64(F.lit(2), left1, right1))).alias("patterns"),
        )

    def of_run(run: Column) -> Column:
        first = F.greatest(F.element_at(run, 1)["start"] - NEAR, F.lit(0))
        last = F.array_max(F.transform(run, lambda s: s["end"])) + NEAR

        def within(stretch: Column) -> Column:
            part = lambda a, b: words(stretch.substr((a - first + 1).cast("int"), (b - a).cast("int")))

            def around(s: Column) -> Column:
                return F.struct(part(F.greatest(s["start"] - NEAR, F.lit(0)), s["start"]).alias("before"), part(s["end"], s["end"] + NEAR).alias("after"))

            return F.transform(run, lambda s: _let(around(s), lambda held: slot(s, held)))

        return _let(body.substr((first + 1).cast("int"), (last - first).cast("int")), within)

    return _let(F.array_sort(F.concat(*(F.transform(k, _named(k)) for k in KINDS), unseen)), lambda slots: _runs(slots, of_run))


def _base_list() -> Column:
    return F.concat(*(F.transform(k, _labelled(k)) for k in KINDS))


def _scan(docs: DataFrame) -> DataFrame:
    """One narrow row per document: base spans and slots (seeds and candidates), no text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    rows = with_base(rows).withColumn("cands", _candidates()).withColumn("base", _base_list())
    none = F.array().cast("array<struct<start:bigint,end:bigint,seed:boolean,instance:bigint,patterns:array<bigint>>>")
    slots = F.when((F.size("cands") > 0) | (F.size("base") > 0), _slots(F.col("body"))).otherwise(none)
    return cut(rows.select("doc_id", F.xxhash64("body").alias("text_hash"), "base", slots.alias("slots")).withColumn("row", F.monotonically_increasing_id()))


def discover(rows: DataFrame) -> DataFrame:
    """Spans of unseen identifiers: ``row, doc_id, text_hash, start, end`` of candidates that reach ``ACCEPT``."""
    each = rows.select("row", "doc_id", "text_hash", F.explode("slots").alias("s")).select("row", "doc_id", "text_hash", "s.*")
    # the graph: distinct edges, so a copied page or one frequent line counts once
    uses = each.select("instance", "seed", F.explode("patterns").alias("pattern"))
    edges = cut(uses.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).withColumn("salt", F.pmod("instance", F.lit(SALTS)).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # a pattern of too few instances never speaks
    enough = edges.groupBy("pattern").count().where(F.col("count") >= SUPPORT).select("pattern", every)
    edges = cut(edges.join(enough, ["pattern", "salt"], "left_semi"))
    score = edges.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double"))
    for _ in range(ROUNDS):
        scored = edges.select("pattern", "instance").join(score, "instance")
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count_if(F.col("score") >= ACCEPT).alias("support"))
        patterns = patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)).select("pattern", "confidence", every)
        drawn = edges.join(patterns, ["pattern", "salt"]).groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("drawn"))
        score = cut(score.join(drawn, "instance", "left").select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("drawn", F.lit(0.0))).alias("score")))
    accepted = score.where(~F.col("seed") & (F.col("score") >= ACCEPT)).select("instance")
    return each.where("not seed").join(accepted, "instance", "left_semi").select("row", "doc_id", "text_hash", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, the digest of the base spans, and all spans."""
    rows = _scan(docs)
    extra = discover(rows).groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.lit("identifier").alias("kind"), "start", "end"))).alias("extra"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = rows.join(extra, "row", "left")
    base = text(F.col("base"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    more = F.coalesce(text(F.col("extra")), F.lit(""))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.when(base != "", base), F.when(more != "", more)).alias("spans"))


def _masked(body: Column, spans: Column) -> Column:
    """``body`` with sorted ``spans`` replaced by their kinds; of overlapping ones the first is replaced."""
    zero = F.lit(0).cast("long")

    def of_run(run: Column, first: Column) -> Column:
        last = F.greatest(first, F.array_max(F.transform(run, lambda s: s["end"])))

        def within(text: Column) -> Column:
            part = lambda a, b: text.substr((a - first + 1).cast("int"), (b - a).cast("int"))

            def step(acc: Column, s: Column) -> Column:
                more = F.concat(acc["out"], part(acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

            return F.aggregate(run, F.struct(first.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

        return _let(body.substr((first + 1).cast("int"), (last - first).cast("int")), within)

    def joined(runs: Column) -> Column:
        ends = F.transform(runs, lambda run: F.array_max(F.transform(run, lambda s: s["end"])))
        return F.array_join(F.zip_with(runs, _before(ends, zero, F.greatest), of_run), "")

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(_let(_chunks(spans), joined), body.substr((last + 1).cast("int"), F.length(body)))


def redact(docs: DataFrame) -> DataFrame:
    """Replace every span by ``[KIND]``; other columns are kept, and ``n_chars``, if there, is counted anew."""
    extra = discover(_scan(docs)).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.lit("identifier").alias("kind"), "start", "end")).alias("_extra"))
    extra = cut(extra.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_extra"))
    columns, kind = docs.columns, "array<struct<kind:string,start:bigint,end:bigint>>"
    own = [f"_own_{k}" for k in range(len(columns))]  # so that no name can clash with those used here
    rows = docs.toDF(*own)
    doc_id, text = own[columns.index("doc_id")], own[columns.index("text")]
    rows = rows.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
    found = extra.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        rows = rows.withColumn("_extra", F.array().cast(kind))
    else:
        same = F.col(doc_id).cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("_body") == F.col("_hash"))
        rows = rows.join(F.broadcast(extra) if found <= BROADCAST_ROWS else extra, same, "left").drop("_doc", "_hash")
    rows = with_base(rows, "_body")
    spans = F.array_sort(F.concat(_base_list(), F.coalesce("_extra", F.array().cast(kind))), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(b["end"] - a["end"]).cast("int")))
    rows = rows.withColumn("_spans", spans).withColumn("_fresh", F.when(F.size("_spans") > 0, _masked(F.col("_body"), F.col("_spans"))).otherwise(F.col(text)))
    out = {o: F.col(o) for o in own} | {text: F.col("_fresh")}
    if "n_chars" in columns:
        n_chars = own[columns.index("n_chars")]
        out[n_chars] = F.when(F.size("_spans") > 0, F.length("_fresh").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars))
    return rows.select(*(c.alias(name) for name, c in zip(columns, out.values())))
