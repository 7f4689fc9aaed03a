"""op12: spelling variants among the words of all documents."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .spelling import count_words, spelling_groups


def misspelt(doc_id: str, words: list[str]) -> list[str]:
    """Words of one document, some without a letter, chosen by a hash of document and word."""
    begin = crc32(f"{doc_id}:".encode())
    hashes = [crc32(word, begin) for word in "\n".join(words).encode().split(b"\n")]
    return [w if h % 31 else w[:h % len(w)] + w[h % len(w) + 1:] for w, h in zip(words, hashes)]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_words(table(spark, sf_dir, "documents"), change=misspelt)
    return spelling_groups(counts).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps),
met AS (
  SELECT doc, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
    FROM documents)
  GROUP BY ALL),
keyed AS (SELECT *, hex(encode(doc || ':' || run)) AS key FROM met),
hashed AS (
  SELECT keyed.*, xor(list_reduce(
    list_transform(range(0, length(key) // 2), lambda i: ('0x' || substr(key, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM keyed, crc_table),
written AS (
  SELECT n, CASE WHEN h % 31 = 0
    THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM holes AS a JOIN holes AS b USING (head, tail) WHERE a.word <> b.word
  UNION SELECT a.word, w.word FROM holes AS a JOIN words AS w ON w.word = a.head || a.tail
  UNION SELECT w.word, a.word FROM holes AS a JOIN words AS w ON w.word = a.head || a.tail),
near AS (
  SELECT p.word, count(*) AS n_near, min({'n': -o.n, 'form': other}) AS best
  FROM pairs AS p JOIN words AS o ON o.word = other GROUP BY p.word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.n >= 10 * w.n THEN best.form END AS form, CASE WHEN -best.n >= 10 * w.n THEN -best.n END AS form_n
  FROM words AS w LEFT JOIN near USING (word)),
steps AS (
  SELECT word, word AS reached FROM formed
  UNION ALL SELECT s.word, f.form FROM steps AS s JOIN formed AS f ON f.word = reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.reached AS root, f.n, f.n_near, f.form_n
FROM formed AS f JOIN steps AS s USING (word) JOIN formed AS l ON l.word = s.reached AND l.form IS NULL
"""
