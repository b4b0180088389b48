"""Queries on overlap between texts: contamination and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import contamination, near_join
from tidemark.llm.catalog import query, table


@query("op2_contamination")
def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, list_sort(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM w
), sets AS (
  SELECT s, min(doc_id) AS set_id, count(*) AS n_copies, len(s) AS size FROM g WHERE len(s) > 0 GROUP BY s
), e AS (SELECT set_id, size, unnest(s) AS gram FROM sets
), pairs AS (
  SELECT a.set_id AS a, b.set_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.set_id <> b.set_id
  GROUP BY a.set_id, b.set_id, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*))
), reach(id, other) AS (
  SELECT set_id, set_id FROM sets UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON r.other = p.a
), classes AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id
), links AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT g.doc_id, coalesce(class_id, g.doc_id) AS class_id, coalesce(set_id, g.doc_id) AS set_id,
  coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM g LEFT JOIN sets USING (s) LEFT JOIN classes ON set_id = id LEFT JOIN links ON set_id = a"""


@query("op8_near_join", OP8_SQL)
def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(table(spark, sf_dir, "documents"))
