"""The corpus pipeline: stages of ``roadloom.llm`` applied to ``documents`` one after another.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread as the next one's ``docs``.
All but the last return the columns of ``docs``.

Defined cases, for every stage: an empty table stays empty; a null text is treated as the empty one and, where it is kept, stays null;
null ids are kept and are no part of the fit; repeated rows are rows of their own, but near-dedup keeps one of them; of ties
(equal scores, copies) near-dedup keeps the smallest id; texts of any length are worked on whole; other columns go through.
The stages' tables stay below the checkpoint folder, as the result of ``run`` reads the last of them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadloom.llm import decontaminate, packing, pii, similar, toxicity
from roadloom.session import ensure_checkpoint_dir, ship

#: Vocabulary for the packing stage.
TOKENIZER = "word_bpe_49k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    ship(spark)
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more) stays."""
    ship(spark)
    return similar.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, packed into sequences."""
    ship(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]
#: SQL expresses neither the network nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
