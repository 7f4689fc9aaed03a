"""op9: repeated runs of words taken out of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table
from .substrings import dedup_substrings


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
runs AS (
  SELECT doc_id, start, list_aggregate(words[start:start + 19], 'string_agg', ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM listed WHERE len(words) >= 20)),
again AS (
  SELECT doc_id, start FROM (
    SELECT doc_id, start, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS place FROM runs)
  WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM again),
each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM listed),
left_over AS (
  SELECT doc_id, count(*) AS n_left, string_agg(word, ' ' ORDER BY place) AS kept
  FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_left, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM listed LEFT JOIN left_over USING (doc_id)
"""
