"""The data-quality report: twelve categories over the master and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .merge import only_source

OVERSIZED = "oversized_families"

# Categories that count as alerts on the overview. A record in several counts
# once for each.
ALERTS = ("assignee_review", "missing_expiration", "unknown_status", "foreign_orphans",
          "bulk_only_non_owner", OVERSIZED)

# Buckets that first rows of a category are picked from.
PREVIEW_BUCKETS = 64


def record_tests() -> dict[str, Column]:
    """Category -> test on a record of the master."""
    status = F.col("status.value")
    confirmed = F.col("assignee.is_confirmed_owner")
    line = F.col("product_line.value")
    bulk_only = only_source(fv.BULK)
    return {
        "assignee_review": F.col("assignee.needs_review"),
        "missing_expiration": F.col("expiration_date.value").isNull() & status.isin("active", "pending"),
        "missing_filing": F.col("filing_date.value").isNull(),
        "unknown_status": status == "unknown",
        "placeholder_number": F.col("is_placeholder"),
        "foreign_orphans": F.col("is_orphan"),
        "bulk_only_non_owner": bulk_only & ~confirmed,
        "bulk_only_historical": bulk_only & confirmed,
        "curated_only": only_source(fv.CURATED) & ~F.col("is_placeholder"),
        "missing_product_line": line.isNull() | (line == ""),
        "missing_tech_cluster": F.size("technology_cluster.value") == 0,
    }


def thin() -> list[Column]:
    """The short form of a record that reports list."""
    return [
        F.col("seq"), F.col("id"), F.col("normalized_number"), F.col("raw_number"),
        F.col("title.value").alias("title"),
        F.col("country"),
        F.col("status.value").alias("status"),
        F.col("status.sub_tag").alias("status_sub_tag"),
        F.col("assignee.normalized").alias("assignee"),
        F.col("product_line.value").alias("product_line"),
        F.col("family_id"),
        F.col("data_quality_flags").alias("flags"),
    ]


def exception_rows(master: DataFrame) -> DataFrame:
    """(category, thin record): one row per category a record falls into.

    One pass over the master; nothing is shuffled.
    """
    named = F.array_compact(F.array(*[F.when(test, name) for name, test in record_tests().items()]))
    return master.select(F.explode(named).alias("category"), *thin())


def oversized_families(families: DataFrame) -> DataFrame:
    return families.where("oversized").select("family_id", "parent_title", "member_count", "countries")


def exception_summary(master: DataFrame, families: DataFrame) -> DataFrame:
    """(category, n) for all twelve categories, zeros included."""
    counts = master.agg(*[F.count_if(test).alias(name) for name, test in record_tests().items()])
    grown = families.agg(F.count_if("oversized").alias(OVERSIZED))
    long = counts.unpivot([], counts.columns, "category", "n")
    return long.unionByName(grown.unpivot([], grown.columns, "category", "n"))


def alert_count(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("category").isin(*ALERTS)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"))


def alert_records(master: DataFrame) -> DataFrame:
    """Records with at least one alert, each counted once."""
    tests = record_tests()
    alerting = F.lit(False)
    for name in ALERTS:
        if name in tests:
            alerting = alerting | tests[name]
    return master.agg(F.count_if(alerting).alias("records"))


def exception_preview(master: DataFrame, shown: int = fv.PREVIEW_SIZE) -> DataFrame:
    """The first rows of each category in emission order, with the size of the
    category and whether rows are left out of the preview.

    Each map task keeps ``shown`` rows per category and bucket before the first
    shuffle (WindowGroupLimit), and a bucket leaves as many, so the last step sees
    ``shown`` rows per bucket however many tasks there are; the totals come from a
    second, shuffle-light aggregate.
    """
    rows = exception_rows(master).withColumn("_bucket", F.pmod(F.xxhash64("seq"), F.lit(PREVIEW_BUCKETS)))

    def limited(df: DataFrame, name: str, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("seq")
        return df.withColumn(name, F.row_number().over(order).cast("long")).where(F.col(name) <= shown)

    first = limited(limited(rows, "_place", "category", "_bucket").drop("_place", "_bucket"), "place", "category")
    totals = master.agg(*[F.count_if(test).alias(name) for name, test in record_tests().items()])
    totals = totals.unpivot([], totals.columns, "category", "total")
    # One row per category: eleven.
    return first.join(F.broadcast(totals), "category").withColumn("truncated", F.col("total") > shown)


def format_duplicates(records: DataFrame) -> DataFrame:
    """Numbers that occur in more than one spelling."""
    spelled = records.where(F.col("normalized_number").isNotNull()).groupBy("normalized_number", "raw_number").agg(
        F.count("*").alias("rows"))
    return (
        spelled.groupBy("normalized_number")
        .agg(F.count("*").alias("spellings"), F.sum("rows").alias("rows"))
        .where("spellings > 1")
    )
