"""op8: groups of near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table
from .minhash import LOWEST, near_documents


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    back = lambda c: F.nullif(F.col(c), F.lit(LOWEST))
    return near_documents(docs).select(
        back("doc").alias("doc_id"), back("class_id").alias("class_id"), back("component_id").alias("component_id"),
        (F.col("doc") == F.col("component_id")).alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, md5(coalesce(text, '')) AS key, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
classes AS (SELECT key, min(doc_id) AS id, any_value(words) AS words FROM listed WHERE len(words) > 0 GROUP BY key),
bags AS (
  SELECT id, shingle, count(*) AS n FROM (
    SELECT id, list_aggregate(words[start:start + 4], 'string_agg', ' ') AS shingle
    FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS start FROM classes))
  GROUP BY id, shingle),
sizes AS (SELECT id, sum(n) AS size FROM bags GROUP BY id),
shared AS (
  SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS n
  FROM bags x JOIN bags y ON x.shingle = y.shingle AND x.id <> y.id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes s ON a = s.id JOIN sizes t ON b = t.id WHERE n >= 0.8 * (s.size + t.size - n)),
reached AS (
  SELECT a AS id, b AS other FROM links
  UNION
  SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS other FROM reached GROUP BY id)
SELECT doc_id, coalesce(c.id, doc_id) AS class_id, least(coalesce(c.id, doc_id), coalesce(r.other, doc_id)) AS component_id,
  doc_id = least(coalesce(c.id, doc_id), coalesce(r.other, doc_id)) AS kept
FROM listed LEFT JOIN classes c USING (key) LEFT JOIN least r ON r.id = c.id
"""
