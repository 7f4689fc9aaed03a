"""Status and owner rules, turned into expressions.

The rule tables are arguments: pass others to extend the engine. They become
part of the plan, so no join and no broadcast is needed to apply them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import strip_space

StatusRules = Mapping[str, tuple[str, str | None]]
OwnerRules = Sequence[tuple[str, str, bool]]


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def with_status(df: DataFrame, name: str, raw: Column, is_placeholder: Column,
                rules: StatusRules = fv.STATUS_RULES) -> DataFrame:
    """Append struct(value, sub_tag, raw). A placeholder is pending whatever it says."""
    table = F.create_map(*[
        item
        for key, (value, sub_tag) in rules.items()
        for item in (F.lit(key), F.struct(_text(value).alias("value"), _text(sub_tag).alias("sub_tag")))
    ])
    found = F.col("_found")
    staged = df.withColumn("_found", F.try_element_at(table, F.lower(strip_space(raw))))
    return staged.withColumn(name, F.struct(
        F.when(is_placeholder, "pending").otherwise(F.coalesce(found["value"], F.lit("unknown"))).alias("value"),
        F.when(is_placeholder, "pre_publication").otherwise(found["sub_tag"]).alias("sub_tag"),
        raw.alias("raw"),
    )).drop("_found")


def with_owner(df: DataFrame, name: str, raw: Column, rules: OwnerRules = fv.OWNER_RULES,
               non_owners: Sequence[str] = fv.KNOWN_NON_OWNERS) -> DataFrame:
    """Append struct(raw, normalized, is_confirmed_owner, needs_review, known_non_owner).

    The first rule whose pattern occurs in the text decides; a text no rule
    knows passes through for review.
    """
    text = F.nullif(strip_space(raw), F.lit(""))
    staged = df.withColumn("_text", F.when(F.lower(text) != "nan", text))
    text, hit = F.col("_text"), F.col("_hit")

    # Number of the first matching rule. It is a column of its own, so each
    # pattern is tried at most once per row.
    first = F.lit(None).cast("int")
    for position in reversed(range(len(rules))):
        first = F.when(text.rlike("(?iU)" + rules[position][0]), F.lit(position)).otherwise(first)
    staged = staged.withColumn("_hit", first)

    names = F.array(*[_text(rule[1]) for rule in rules])
    confirmed = F.array(*[F.lit(bool(rule[2])) for rule in rules])
    is_owner = F.coalesce(F.get(confirmed, hit), F.lit(False))
    listed = F.lit(False)
    for needle in non_owners:
        listed = listed | F.lower(text).contains(needle)
    return staged.withColumn(name, F.struct(
        F.coalesce(text, raw).alias("raw"),
        F.coalesce(F.get(names, hit), text).alias("normalized"),
        is_owner.alias("is_confirmed_owner"),
        (~is_owner).alias("needs_review"),
        F.coalesce(listed & hit.isNull(), F.lit(False)).alias("known_non_owner"),
    )).drop("_text", "_hit")


def rule_snapshot(spark: SparkSession, rules: OwnerRules = fv.OWNER_RULES,
                  non_owners: Sequence[str] = fv.KNOWN_NON_OWNERS) -> DataFrame:
    """The owner rules as a table for audit: patterns in order, then the
    sorted names known not to own."""
    rows = [("owner_rule", i, p, n, c) for i, (p, n, c) in enumerate(rules)]
    rows += [("known_non_owner", i, needle, None, False) for i, needle in enumerate(sorted(non_owners))]
    return spark.createDataFrame(
        rows, "kind string, priority int, pattern string, normalized string, is_confirmed_owner boolean")
