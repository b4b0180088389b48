"""From raw documents to token ids: toxic, unidentified, repeated and contaminated documents go, the rest is encoded.

Every stage sees all rows that the one before it kept, and all but the last return the columns of documents. Rows with
null texts or ids run through like any others: a null text has no language and goes with the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_transducer, contamination, language, near_join, toxicity
from tidemark.llm.catalog import table
from tidemark.llm.text_queries import id_remainder
from tidemark.session import cut_lineage


#: Rows with their whole texts pass through Python in batches of so many: a task holds a few MB of them at a time, not hundreds.
BATCH_ROWS = 500


def batched(spark: SparkSession) -> None:
    """Bounds the batches between Spark and Python for all stages of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; labels outside the held-out fifth teach it."""
    batched(spark)
    model = toxicity.CharacterModel.of(toxicity.character_counts(docs))
    labels = table(spark, sf_dir, "labels").where(id_remainder(5) != 0)
    return toxicity.keep_clean(docs, model, toxicity.fit(docs, labels, model))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the model is sure of go; rows outside the held-out third teach it."""
    batched(spark)
    return language.keep_identified(docs, language.fit(docs.where(id_remainder(3) != 1).select("doc_id", "lang", "text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or similar documents the one of the lowest id stays."""
    batched(spark)
    return near_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    batched(spark)
    return contamination.keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    batched(spark)
    return bpe_transducer.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_copies", drop_near_copies),
    ("contamination", drop_contaminated),
    ("encoding", encode),
]

#: Trained scores and merges are beyond SQL; the tests hold the pipeline against its parts done by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
