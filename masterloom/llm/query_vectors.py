"""op6: all vectors linked by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vectors import near_vectors


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE long AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE list_sum([CASE WHEN isfinite(x) THEN 0 ELSE 1 END FOR x IN embedding]) = 0 AND NOT list_contains([x IS NULL FOR x IN embedding], true)),
unit AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM long WHERE list_dot_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reached AS (
  SELECT a AS vec_id, b AS other FROM links
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS other FROM reached GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
same AS (SELECT embedding, min(vec_id) AS class_id FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.other, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(r.other, e.vec_id)) AS kept, coalesce(s.class_id, e.vec_id) AS class_id
FROM embeddings e LEFT JOIN least r USING (vec_id) LEFT JOIN degree d USING (vec_id) LEFT JOIN same s USING (embedding)
"""
