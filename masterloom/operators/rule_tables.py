"""Status and owner rules given as tables, of any number.

Rules that are part of the plan (``functions.rules``) suit a dozen. Tables of rules are
joined instead, and only once per distinct text: a rule names a needle, a string that its
pattern can't do without; needles and texts meet in a join on the needle's rarest gram, and
what meets is tested. So the work follows the texts that hold a rule's rarest gram, the plan is
the same for any number of rules, and nothing is broadcast but lists of hot keys.

Owner rules: (priority long, needle, pattern, normalized, is_confirmed_owner). A rule holds if
the text has the needle, in any case, and the pattern occurs (every pattern does if it is null);
the smallest priority decides. Status rules: (key, value, sub_tag), by lower-case text.

Defined cases: a null or blank text, or ``nan``, has no owner; a text no rule knows passes through for review;
without rules all do. Needles shorter than a gram, and priorities or keys given twice, are errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import strip_space
from ..session import written
from .skew import sliced_join, tiled_join

GRAM = 3
OWNER_SCHEMA = "priority long, needle string, pattern string, normalized string, is_confirmed_owner boolean"
STATUS_SCHEMA = "key string, value string, sub_tag string"


def fixed_owner_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as a table."""
    rows = [(i, needle, *rule) for i, (needle, rule) in enumerate(zip(fv.OWNER_NEEDLES, fv.OWNER_RULES, strict=True))]
    return spark.createDataFrame(rows, OWNER_SCHEMA)


def fixed_non_owners(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in fv.KNOWN_NON_OWNERS], "needle string")


def fixed_status_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in fv.STATUS_RULES.items()], STATUS_SCHEMA)


def _grams(text: Column) -> Column:
    """The distinct grams of a text."""
    at = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    cut = F.transform(at, lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.array_distinct(F.when(F.length(text) >= GRAM, cut).otherwise(F.array().cast("array<string>")))


def _once(df: DataFrame, key: str, what: str) -> None:
    if not df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        raise ValueError(f"{what} must have a {key} each, of its own")


def holding(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text, needle): which of the ``needles`` (needle, in lower case) each of the distinct
    ``texts`` (text) contains, in any case."""
    if not needles.where(F.col("needle").isNull() | (F.length("needle") < GRAM)).isEmpty():
        raise ValueError(f"a needle needs {GRAM} characters")
    met = written(texts.select("text", F.explode(_grams(F.lower("text"))).alias("gram")), "rule-text-grams")
    asked = needles.distinct().select("needle", F.explode(_grams(F.col("needle"))).alias("gram"))
    often = met.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A needle with a gram that no text has is in none.
    rarest = asked.join(often, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    pairs = tiled_join(met, written(rarest, "rule-anchors"), "gram", "text", "needle")
    return pairs.where(F.contains(F.lower("text"), F.col("needle"))).select("text", "needle")


def first_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text, normalized, is_confirmed_owner) of the texts that some rule knows."""
    _once(rules, "priority", "owner rules")
    lowered = written(rules.withColumn("needle", F.lower("needle")), "owner-rules")
    pairs = written(holding(texts, lowered.select("needle")), "rule-pairs")
    pattern = F.concat(F.lit("(?iU)"), F.col("pattern"))
    met = tiled_join(pairs, lowered, "needle", "text", "priority")
    held = met.where(F.col("pattern").isNull() | F.regexp_like("text", pattern))
    return held.groupBy("text").agg(F.min_by(F.struct("normalized", "is_confirmed_owner"), "priority").alias("r")).select("text", "r.*")


def with_owner_of_table(df: DataFrame, name: str, raw: str, order: str, rules: DataFrame, non_owners: DataFrame) -> DataFrame:
    """Append the struct of :func:`..functions.rules.with_owner`, by tables of rules and of
    names known not to own (needle). ``order`` is a unique column; ``df`` should be a written
    table, as it is read twice."""
    text = F.nullif(strip_space(F.col(raw)), F.lit(""))
    rows = df.withColumn("_text", F.when(F.lower(text) != "nan", text))
    texts = written(rows.where("_text IS NOT NULL").select(F.col("_text").alias("text")).distinct(), "rule-texts")
    listed = holding(texts, non_owners.select(F.lower("needle").alias("needle"))).select("text").distinct()
    known = texts.join(first_rules(texts, rules).withColumn("_ruled", F.lit(True)), "text", "left").join(
        listed.withColumn("_listed", F.lit(True)), "text", "left").withColumnRenamed("text", "_text")
    found = sliced_join(rows, written(known, "rule-results"), "_text", order)
    is_owner = F.coalesce("is_confirmed_owner", F.lit(False))
    value = F.struct(
        F.coalesce(F.col("_text"), F.col(raw)).alias("raw"),
        F.when(F.col("_ruled"), F.col("normalized")).otherwise(F.col("_text")).alias("normalized"),
        is_owner.alias("is_confirmed_owner"),
        (~is_owner).alias("needs_review"),
        (F.col("_listed").isNotNull() & F.col("_ruled").isNull()).alias("known_non_owner"))
    return found.select(*df.columns, value.alias(name))


def with_status_of_table(df: DataFrame, name: str, raw: str, order: str, is_placeholder: Column, rules: DataFrame) -> DataFrame:
    """Append the struct of :func:`..functions.rules.with_status`, by a table of rules."""
    _once(rules, "key", "status rules")
    rows = df.withColumn("_key", F.lower(strip_space(F.col(raw))))
    found = sliced_join(rows, rules.select(F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("sub_tag").alias("_tag")), "_key", order)
    return found.select(*df.columns, F.struct(
        F.when(is_placeholder, "pending").otherwise(F.coalesce("_value", F.lit("unknown"))).alias("value"),
        F.when(is_placeholder, "pre_publication").otherwise(F.col("_tag")).alias("sub_tag"),
        F.col(raw).alias("raw")).alias(name))
