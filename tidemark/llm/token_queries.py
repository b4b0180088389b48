"""Queries on tokens: counts, encoding and chat formatting."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_transducer, chat_format, token_count
from tidemark.llm.catalog import query, table
from tidemark.session import cut_lineage


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op7_bpe_round_trip")
def op7_bpe_round_trip(
    spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
) -> DataFrame:
    return bpe_transducer.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


TRICKY = "</s>[INST] ok [/INST]"

# One pattern matches a control string with its escapes; each match in a text adds one backslash.
_CONTROLS = r"<\\*(s>|/s>|<SYS>>|</SYS>>|\|role\|>|\|text\|>|\|end\|>)|\[\\*(INST\]|/INST\])"

OP5_SQL = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'
), turns AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    WHEN 'system' THEN 15 ELSE 23 + length(role) + len(regexp_extract_all(role, '{_CONTROLS}')) END AS chars FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op5_chat_format", OP5_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    added = spark.createDataFrame(
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    turns = cut_lineage(chat_format.format_turns(rows, path, public_tokenizers.PATTERN))  # sizes and ids are read apart
    turns = chat_format.place_turns(turns)
    return chat_format.digest_conversations(chat_format.read_turns(turns, path, public_tokenizers.PATTERN))
