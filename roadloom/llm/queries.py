"""The thin queries ``opN_<name>`` over the tables of a data folder, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import decontaminate, language_model, licenses, mixing, neighbours, packing, pii, quality, resampling, sharding, simhash, toxicity, whitening
from roadloom.session import cut, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.reshard(_table(spark, sf_dir, "documents"), 32, 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = simhash.components(cut(simhash.fingerprints(_table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_model.score(_table(spark, sf_dir, "documents"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_reshard": op1_reshard,
    "op2_pack": op2_pack,
    "op3_pii": op3_pii,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity": op5_toxicity,
    "op6_neighbours": op6_neighbours,
    "op7_quality": op7_quality,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_model": op10_language_model,
    "op11_mix": op11_mix,
    "op12_resample": op12_resample,
    "op13_whiten": op13_whiten,
}
# op6: exact search; the index finds the same wherever its probes hold ``neighbours.COVER`` rows or all there are.
SQL: dict[str, str] = {
    "op6_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        near AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM near)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 10""",
    # checksums from a table by the usual polynomial, once for each different word
    "op12_resample": r"""WITH lines AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS line),
        held AS (SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
        words AS (SELECT kind, row, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM held),
        places AS (SELECT kind, row, unnest(words) AS word FROM words),
        counted AS (SELECT kind, row, word, count(*) AS n FROM places GROUP BY ALL),
        hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)),
        bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda k: CAST(instr('0123456789ABCDEF', h[2 * k + 1]) * 16 + instr('0123456789ABCDEF', h[2 * k + 2]) - 17 AS BIGINT)) AS b FROM hexed),
        buckets AS (SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(c >> 8, line[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, lines),
        sums AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM counted JOIN buckets USING (word) GROUP BY bucket),
        total AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS all_s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS all_t FROM sums),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM sums, total),
        weighed AS (SELECT row, sum(n) AS n, CAST(sum(n * gain) AS HUGEINT) AS g FROM counted JOIN buckets USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row),
        docs AS (SELECT id AS doc_id, len(words) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
            (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM words LEFT JOIN weighed USING (row) WHERE kind = 'd'),
        scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM docs),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed""",
}
