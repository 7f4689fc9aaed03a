"""op4: all documents mixed to the target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import mix


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS source_key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source_key) - 1) % 3 + 1] AS weight
  FROM (SELECT source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY source_key)),
ordered AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source_key) AS turn
  FROM weighed),
levels AS (
  SELECT turn, weight, cap, (1.5 * (SELECT sum(source_size) FROM weighed)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered),
level AS (
  -- Sources are filled in the order of cap per weight, until one is not above its cap.
  SELECT coalesce(arg_min(level, turn) FILTER (level * weight <= cap), 0) AS level FROM levels),
rated AS (
  SELECT source_key, source_size, least(source_size * 2.0::DOUBLE, weight * level) AS target,
    ('0x' || md5('mix' || source_key)[1:8])::BIGINT / 4294967296.0::DOUBLE AS start
  FROM weighed, level),
placed AS (
  SELECT s.*, r.source_size, r.target, r.start,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source_key ORDER BY s.size DESC, s.digest, s.doc_id) AS place
  FROM sized s JOIN rated r USING (source_key))
SELECT doc_id, source, size::BIGINT AS size, source_size, target,
  (size * (floor(place * rate + start) - floor((place - 1) * rate + start)))::BIGINT AS taken
FROM placed
"""
