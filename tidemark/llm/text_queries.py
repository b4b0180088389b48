"""Queries on texts: toxicity and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import language, toxicity
from tidemark.llm.catalog import query, table


def id_remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_remainder(5) != 0)
    model = toxicity.CharacterModel.of(toxicity.character_counts(docs))
    scored = toxicity.score_texts(docs, model, toxicity.fit(docs, labels, model))
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(id_remainder(3) != 1).select("doc_id", "lang", "text"))
    held_out = F.coalesce(id_remainder(3) == 1, F.lit(False))
    return language.predict_texts(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
