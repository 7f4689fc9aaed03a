"""op11: all conversations, damaged by rule and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table
from .repair import repair_conversations


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user by a hash of their place."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = own_columns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    fixed = repair_conversations(damaged(rows)).withColumnRenamed("conv_id", "_id")
    every = rows.select("conv_id").distinct()
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return every.join(fixed, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce(said, F.lit("")), 256).alias("repaired_sha256"))


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _step(state: str, edit: str, cost: str, when: str = "true") -> str:
    """A way to go on from the cheapest path to a state."""
    return f"{{'c': CASE WHEN {when} THEN b.{state}.c + {cost} ELSE 1000000000 END, 't': b.{state}.t || '{edit}'}}"


def _folded() -> str:
    """One turn of a fold that holds, for each role said last, the cheapest path to it: first
    inserts before the turn (``b``), then what becomes of the turn."""
    def inserted(to: str, *states: str) -> str:
        return _least(f"a.{to}", *[f"{{'c': a.{s}.c + 3, 't': a.{s}.t || 'I'}}" for s in states])

    # Users follow the start, a system turn or an assistant; two inserts in a row never pay.
    before = f"{{'z': a.z, 's': a.s, 'u': {inserted('u', 'z', 's', 'a')}, 'a': {inserted('a', 'u')}}}"
    stay, cut = "t.f IN ('', 'truncated')", "CASE WHEN t.f = 'truncated' THEN 3 ELSE 0 END"

    def reached(to: str, *states: str) -> str:
        steps = [_step(to, "D", "4")]
        for s in states:
            steps.append(_step(s, "K", cut, f"{stay} AND t.i = '{to}'"))
            steps.append(_step(s, "R", f"3 + {cut}", f"{stay} AND t.i <> '{to}'"))
        return _least(*steps)

    kept_s = _least(_step("s", "D", "4"), _step("z", "K", cut, f"{stay} AND t.i = 's'"))
    after = (f"{{'z': {_step('z', 'D', '4')}, 's': {kept_s}, "
             f"'u': {reached('u', 'z', 's', 'a')}, 'a': {reached('a', 'u')}}}")
    return f"list_transform([{before}], lambda b: {after})[1]"


_START = ("{'z': {'c': 0::BIGINT, 't': ''}, 's': {'c': 1000000000::BIGINT, 't': ''}, "
          "'u': {'c': 1000000000::BIGINT, 't': ''}, 'a': {'c': 1000000000::BIGINT, 't': ''}}")
# Hashes are built from their rule; paths grow by one turn a round, for all conversations at once.
OP11_SQL = rf"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps),
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
judged AS (
  SELECT said.*, xor(list_reduce(list_transform(range(1, length(place) + 1), lambda i: ord(substr(place, i, 1))::BIGINT),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM said, crc_table),
rows_left AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM judged),
placed AS (
  SELECT *, substr(role, 1, 1) AS i, row_number() OVER turns AS p,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    lag(substr(role, 1, 1)) OVER turns AS before
  FROM rows_left WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS f FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
    count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (p > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
paths AS (
  SELECT conv_id, 0::BIGINT AS p, {_START} AS a FROM counted
  UNION ALL
  SELECT paths.conv_id, t.p, {_folded()} AS a
  FROM paths JOIN faulty AS t ON t.conv_id IS NOT DISTINCT FROM paths.conv_id AND t.p = paths.p + 1),
ends AS (
  SELECT paths.conv_id, list_min([a.z, a.a, {{'c': a.u.c + 3, 't': a.u.t || 'I'}}, {{'c': a.s.c + 6, 't': a.s.t || 'II'}}]) AS best
  FROM paths JOIN counted AS n ON n.conv_id IS NOT DISTINCT FROM paths.conv_id WHERE p = n),
edits AS (
  SELECT conv_id, unnest(string_split(best.t, '')) AS e, unnest(range(1, length(best.t) + 1)) AS k FROM ends WHERE best.t <> ''),
walked AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER upto AS p, count(*) FILTER (e <> 'D') OVER upto AS o
  FROM edits WINDOW upto AS (PARTITION BY conv_id ORDER BY k)),
met AS (
  SELECT w.conv_id, w.k, w.e, w.o, t.role, t.text, t.i,
    coalesce(max(CASE WHEN w.e = 'K' AND w.o = 1 AND t.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id), 0) AS opened
  FROM walked AS w LEFT JOIN faulty AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.p = w.p AND w.e <> 'I'
  WHERE w.e <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM met GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.t, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counted AS n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired AS r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
