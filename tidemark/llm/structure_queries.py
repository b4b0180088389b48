"""Queries on repeats inside and between texts, and on the manifest of a table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import exact_copies, merkle_manifest, periodic_runs
from tidemark.llm.catalog import query, table


def made_periodic(key, words: list[bytes]) -> list[bytes]:
    """The words of a document; where its id's hash ends in 0 they repeat from some place on."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), prepare=made_periodic)


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW best AS (PARTITION BY body ORDER BY n_points DESC, doc_id NULLS LAST)"""


@query("op12_exact_copies", OP12_SQL)
def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_groups(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS g, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text
  FROM documents
), t AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM f
), leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(small) || ':' || small, '-')) AS lowered FROM t
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), nodes(level, g, idx, h, n) AS (
  SELECT 0, g, pos, leaf, n FROM placed
  UNION ALL
  SELECT level + 1, g, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY level, g, idx // 16, n
), subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, idx, h, n) AS (
  SELECT 0, place, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, idx // 16, n
), tree AS (
  SELECT level, g, idx, h FROM nodes WHERE n > 1 UNION ALL SELECT 100 + level, '', idx, h FROM tops WHERE n > 1
), tampers AS (SELECT doc_id, g, leaf, lowered, pos, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: list_prepend(ord(c), [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 5 = 0 AS tampered FROM placed
), up(g, pos, level, key, idx, h, siblings) AS (
  SELECT g, pos, 0, g, pos, CASE WHEN tampered THEN lowered ELSE leaf END, '' FROM tampers
  UNION ALL
  SELECT * FROM (
    WITH runs AS (
      SELECT u.g, u.pos, u.level, u.key, u.idx, any_value(u.siblings) AS siblings,
        string_agg(CASE WHEN t.idx <> u.idx THEN t.h END, '' ORDER BY t.idx) AS others,
        string_agg(CASE WHEN t.idx = u.idx THEN u.h ELSE t.h END, '' ORDER BY t.idx) AS run
      FROM up u JOIN tree t ON t.level = u.level AND t.g = u.key AND t.idx // 16 = u.idx // 16
      GROUP BY u.g, u.pos, u.level, u.key, u.idx
    ), lone AS (
      SELECT u.g, u.pos, s.place, u.h, u.siblings FROM up u JOIN subroots s ON s.g = u.g
      WHERE u.level < 100 AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.level = u.level AND t.g = u.key)
    )
    SELECT g, pos, level + 1, key, idx // 16, sha256(run), siblings || coalesce(others, '') FROM runs
    UNION ALL
    SELECT g, pos, 100, '', place, h, siblings FROM lone
  )
), ends AS (
  SELECT g, pos, h, siblings FROM up WHERE level >= 100 QUALIFY row_number() OVER (PARTITION BY g, pos ORDER BY level DESC) = 1
), root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(e.siblings) AS proof_sha256, e.h AS folded_root, e.h = root.root AS verified
FROM tampers p JOIN ends e USING (g, pos) JOIN subroots s USING (g), root"""


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest.manifest(
        table(spark, sf_dir, "documents"), FIELDS, changed={"text": F.translate("text", UPPER, LOWER)},
        when=F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
    )
    return found.withColumnsRenamed({"id": "doc_id", "digest": "leaf"})
