"""The driver's tables seen as documents, vectors and codes; each view in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.windows import WindowSpec, assign_windows
from tidemark.sources.documents import spread

SLIDING = WindowSpec(1900, 1925, 11, 1)
EPOCHS = WindowSpec(1900, 1928, 5, 5)
STOP_WORDS = ("of", "on", "the", "to")
SYMBOLS = ("es", "le")
GREEK = (("re", "rho"), ("eta", "eta"), ("th", "theta"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year(key: str):
    return (1900 + F.col(key) % 25).cast("int").alias("year")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(rows, "doc_id").select(
        F.col("doc_id").alias("patent"), F.col("source").alias("file"), F.col("text").alias("contents"),
        year("doc_id"),
    )


def doc_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and years only: the texts are not read."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("patent"), year("doc_id"))


def docs_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        "patent", "file",
        F.when(F.col("patent") % 23 == 0, "").otherwise(F.col("contents")).alias("contents"),
        F.when(F.col("patent") % 17 == 0, 0).otherwise(F.col("year")).cast("int").alias("year"),
    )


def split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose longer words are cut in two."""
    cut = F.regexp_replace("contents", "([A-Za-z]{3})([A-Za-z]{4,})", "$1 $2")
    return docs(spark, sf_dir).withColumn("contents", cut)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))
    return table(spark, sf_dir, "benchmark").select(F.explode(words).alias("word")).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lit("vec").alias("model"), F.col("vec_id").alias("patent"), year("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def vector_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patent"), year("vec_id"))


def coded(rows: DataFrame) -> DataFrame:
    """Code rows of rows (pat, progr)."""
    m = "(pat * (1 + 2 * progr) + progr)"
    code = (
        f"concat(chr(cast(65 + {m} % 8 as int)), {m} % 2, ({m} div 2) % 3, "
        f"chr(cast(65 + ({m} div 6) % 4 as int)), 1 + ({m} div 24) % 5, '/', ({m} div 120) % 4)"
    )
    return rows.select("pat", "progr", F.expr(code).alias("CPC"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pat"), F.explode(F.array(F.lit(0), F.lit(1))).alias("progr")
    )
    return coded(rows)


def wide_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of no, one to three, eight and thirty codes."""
    many = (
        F.when(F.col("doc_id") % 100 == 50, 30).when(F.col("doc_id") % 10 == 0, 0)
        .when(F.col("doc_id") % 20 == 7, 8).otherwise((1 + F.col("doc_id") % 3).cast("int"))
    )
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pat"), many.alias("_n")).where("_n > 0")
    return coded(rows.select("pat", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("progr")))


def code_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pat"), year("doc_id"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = docs(spark, sf_dir).select(F.explode(F.split(F.lower("contents"), " ")).alias("token"))
    values = [
        ((F.ascii("token") * k + F.length("token")) % 7 - 3).cast("double") for k in range(1, 9)
    ]
    return tokens.where("token <> ''").distinct().select("token", F.array(*values).alias("vector"))


def members(rows: DataFrame, spec: WindowSpec) -> DataFrame:
    placed = assign_windows(rows.select("patent", "year"), spec.frame(rows.sparkSession))
    return placed.select("window", "patent", "year")


# --- the same views in SQL -----------------------------------------------------------------------

SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CLASS = r"\p{L}\p{N}_"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
TRIPLES = "|".join(c * 3 for c in LETTERS)
RUNS = "|".join(f"{c}{{2,}}" for c in LETTERS)


def sql_windows(spec: WindowSpec) -> str:
    first = spec.year_start - (spec.year_start - 1838) % spec.step
    return (
        f'windows AS (SELECT s || \'-\' || (s + {spec.size - 1}) AS "window", CAST(s AS INTEGER) AS start, '
        f'CAST(s + {spec.size - 1} AS INTEGER) AS "end" '
        f"FROM range({first}, {spec.year_end - spec.size + 1}, {spec.step}) t(s))"
    )


def sql_members(source: str) -> str:
    return (
        f'members AS (SELECT w."window", d.patent, d.year FROM {source} d '
        'JOIN windows w ON d.year BETWEEN w.start AND w."end")'
    )


DOCS = (
    "docs AS (SELECT doc_id AS patent, source AS file, text AS contents, "
    "CAST(1900 + doc_id % 25 AS INTEGER) AS year FROM documents)"
)
GAPS = (
    "docs AS (SELECT doc_id AS patent, source AS file, "
    "CASE WHEN doc_id % 23 = 0 THEN '' ELSE text END AS contents, "
    "CAST(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1900 + doc_id % 25 END AS INTEGER) AS year FROM documents)"
)
SPLIT = (
    "docs AS (SELECT doc_id AS patent, source AS file, "
    r"regexp_replace(text, '([A-Za-z]{3})([A-Za-z]{4,})', '\1 \2', 'g') AS contents, "
    "CAST(1900 + doc_id % 25 AS INTEGER) AS year FROM documents)"
)
LEXICON = (
    "lexicon AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM benchmark)"
)
VECTORS = (
    "vectors AS (SELECT 'vec' AS model, vec_id AS patent, CAST(1900 + vec_id % 25 AS INTEGER) AS year, "
    "CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
)
UNITS = (
    "units AS (SELECT model, patent, year, list_transform(embedding, lambda x: "
    "x / sqrt(list_dot_product(embedding, embedding))) AS u FROM vectors)"
)
CODED = (
    "codes AS (SELECT pat, CAST(progr AS INTEGER) AS progr, concat(chr(CAST(65 + m % 8 AS INTEGER)), m % 2, "
    "(m // 2) % 3, chr(CAST(65 + (m // 6) % 4 AS INTEGER)), 1 + (m // 24) % 5, '/', (m // 120) % 4) AS CPC "
    "FROM (SELECT doc_id AS pat, progr, doc_id * (1 + 2 * progr) + progr AS m "
)
CODES = CODED + "FROM documents, (VALUES (0), (1)) t(progr)))"
WIDE_CODES = (
    CODED + "FROM documents, range(30) t(progr) WHERE progr < CASE WHEN doc_id % 100 = 50 THEN 30 WHEN doc_id % 10 = 0 THEN 0 "
    "WHEN doc_id % 20 = 7 THEN 8 ELSE 1 + doc_id % 3 END))"
)
CODE_YEARS = "years AS (SELECT doc_id AS pat, CAST(1900 + doc_id % 25 AS INTEGER) AS year FROM documents)"
# present years, focal year and reach of each window
FOCAL = (
    'spans AS (SELECT "window", min(year) AS lo, max(year) AS hi FROM members GROUP BY 1), '
    'focal AS (SELECT "window", CAST((lo + hi) // 2 AS INTEGER) AS focal_year, '
    'greatest((lo + hi) // 2 - lo, hi - (lo + hi) // 2) AS reach FROM spans)'
)
TOKEN_VECTORS = (
    "token_vectors AS (SELECT token, "
    + ", ".join(f"CAST((ascii(token) * {k} + length(token)) % 7 - 3 AS DOUBLE) AS v{k}" for k in range(1, 9))
    + " FROM (SELECT DISTINCT unnest(string_split(lower(contents), ' ')) AS token FROM docs) WHERE token <> '')"
)


def sql_with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def similarity_levels() -> str:
    """Similarity by the number of agreeing levels, as a SQL CASE over ``k``."""
    cases = " ".join(f"WHEN k = {k} THEN 1 - pow(2.0 / 3.0, {k})" for k in range(6))
    return f"CASE {cases} ELSE 1 END"


def agreeing_levels(a: str, b: str) -> str:
    """Number of leading levels two codes share, as SQL over their level columns l1..l6."""
    tests = " ".join(f"WHEN {a}.l{i} <> {b}.l{i} THEN {i - 1}" for i in range(1, 7))
    return f"CASE {tests} ELSE 6 END"


LEVELS = (
    "levels AS (SELECT pat, progr, CPC, substr(CPC, 1, 1) AS l1, substr(CPC, 2, 1) AS l2, "
    "substr(CPC, 3, 1) AS l3, substr(CPC, 4, 1) AS l4, split_part(substr(CPC, 5), '/', 1) AS l5, "
    "split_part(substr(CPC, 5), '/', 2) AS l6 FROM codes)"
)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Round the named columns, so that sums in another order compare equal."""
    return df.select(
        *[F.round(c, digits).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    )
