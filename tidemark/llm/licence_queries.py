"""Licence scan over documents. Documents stand for files: the source is the root directory, thousands and hundreds of the
id the two levels below it, and every hundredth document is the licence file of its directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import licences
from tidemark.llm.catalog import query, table

_TERMS = ", ".join(f"('{n}', '{t}')" for n, text in licences.TEMPLATES.items() for t in sorted(set(text.split())))
_WORD = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"

OP10_SQL = rf"""
WITH terms(licence, term) AS (VALUES {_TERMS}
), files AS (
  SELECT doc_id AS id, text, source || CASE WHEN doc_id % 1000 = 0 THEN '/LICENSE' WHEN doc_id % 100 = 0
    THEN '/' || (doc_id // 1000) || '/' || (doc_id // 100 % 10) || '/LICENSE'
    ELSE '/' || (doc_id // 1000) || '/' || (doc_id // 100 % 10) || '/' || doc_id || '.txt' END AS path FROM documents
), n AS (SELECT count(*) AS n FROM files
), freq AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{_WORD}'))) AS term FROM files)
  WHERE term IN (SELECT term FROM terms) GROUP BY term
), weights AS (
  SELECT DISTINCT term, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM terms LEFT JOIN freq USING (term) CROSS JOIN n
), template AS (
  SELECT licence, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY licence)) AS part FROM terms JOIN weights USING (term)
), lines AS (
  SELECT id, unnest(string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10))) AS line FROM files
), numbered AS (SELECT id, row_number() OVER () AS spot, line FROM lines WHERE lower(line) SIMILAR TO '.*(licen|released|public|use|cc|gnu|mit|isc|bsd|apache|governed|subject|unencumbered|mozilla).*'
), bags AS (
  SELECT id, spot, term, count(*)::DOUBLE AS tf
  FROM (SELECT id, spot, unnest(regexp_extract_all(lower(line), '{_WORD}')) AS term FROM numbered) GROUP BY id, spot, term
), known AS (
  SELECT id, spot, term, tf * coalesce(idf, ln(n + 1.0) + 1.0) AS w FROM bags LEFT JOIN weights USING (term) CROSS JOIN n
), lengths AS (SELECT spot, sqrt(sum(w * w)) AS len FROM known GROUP BY spot
), dots AS (SELECT id, spot, licence, sum(w * part) AS dot FROM known JOIN template USING (term) GROUP BY id, spot, licence
), best AS (
  SELECT id, licence, max(round(dot / len, 6)) AS score FROM dots JOIN lengths USING (spot) GROUP BY id, licence
), own AS (
  SELECT id, licence, score FROM best WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, licence) = 1
), placed AS (
  SELECT id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, regexp_extract(path, '([^/]*)$', 1) AS name FROM files
), licensed AS (
  SELECT directory AS above, licence, score FROM placed JOIN own USING (id) WHERE name = 'LICENSE'
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, name, licence) = 1
), chains AS (
  SELECT DISTINCT p.directory, l.licence, l.score, length(l.above) AS deep FROM (SELECT DISTINCT directory FROM placed) p
  JOIN licensed l ON p.directory = l.above OR starts_with(p.directory, l.above || '/')
), inherited AS (
  SELECT directory, licence AS from_above, score AS score_above FROM chains
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY deep DESC) = 1
)
SELECT id AS doc_id, path, coalesce(licence, from_above) AS licence, coalesce(score, score_above) AS score,
  CASE WHEN licence IS NOT NULL THEN 'own' WHEN from_above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM placed LEFT JOIN own USING (id) LEFT JOIN inherited USING (directory)"""


@query("op10_licences", OP10_SQL)
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    thousand, hundred = F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100 % 10").cast("string")
    path = F.when(F.expr("doc_id % 1000 = 0"), F.concat("source", F.lit("/LICENSE"))).when(
        F.expr("doc_id % 100 = 0"), F.concat("source", F.lit("/"), thousand, F.lit("/"), hundred, F.lit("/LICENSE"))
    ).otherwise(F.concat("source", F.lit("/"), thousand, F.lit("/"), hundred, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return licences.scan(files).withColumnRenamed("id", "doc_id")
