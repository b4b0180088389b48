"""Delimited tables and word lists with fixed schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas
from tidemark.functions.text import strip


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A-5: tab-separated ``pat, progr, CPC``."""
    return spark.read.schema(schemas.CODES).csv(path, sep="\t", header=True)


def read_years(spark: SparkSession, path: str) -> DataFrame:
    """A-6: tab-separated ``pat, year``; year 0 is a missing year."""
    years = spark.read.schema(schemas.YEARS).csv(path, sep="\t", header=True)
    return years.withColumn("year", F.nullif("year", F.lit(0)))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A-7: one word per line, from .txt or .csv."""
    if os.path.splitext(path)[1].lower() not in (".txt", ".csv"):
        raise AssertionError(f"lexicon should be a .txt or .csv file, not {path!r}")
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).distinct()


def read_stop_words(spark: SparkSession, path: str, extra: list[str] = ()) -> DataFrame:
    """A-8: white-space separated words, the two mark-up words, and a further list."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word"))
    more = [".sub.", ".sup.", *extra]
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in more])).alias("word"))
    return words.where("word <> ''").unionByName(fixed).distinct()


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """A-8: symbols separated by commas and white space."""
    parts = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("part"))
    return parts.where("part <> ''").select(F.explode(F.split("part", ",")).alias("symbol")).distinct()


def read_greek(spark: SparkSession, path: str) -> DataFrame:
    """A-8: rows of ``(variant, standard)``; five fields by position, "-" means no variant."""
    fields = "mark STRING, v1 STRING, v2 STRING, v3 STRING, standard STRING"
    table = spark.read.schema(fields).csv(path, header=True, enforceSchema=True)
    variants = table.unpivot("standard", ["v1", "v2", "v3"], "column", "variant")
    return variants.where("variant <> '-' AND standard IS NOT NULL").select("variant", "standard")

