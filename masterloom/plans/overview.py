"""The overview: breakdowns, totals, alert count and last refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import alert_count
from ..operators.stats import facets_of_cells, overview_counts, overview_of_cells
from ..sources.published import Published


def overview(master: DataFrame, summary: DataFrame) -> DataFrame:
    """(metric, name, n, first): all overview figures, from one scan of the
    master and the twelve-row exception summary."""
    return _with_alerts(overview_counts(master), summary)


def published_overview(published: Published) -> DataFrame:
    """The same from what a refresh kept: its cells and its summary; the master isn't read."""
    return _with_alerts(overview_of_cells(published.read("overview_cells")), published.read("exception_summary"))


def published_facets(published: Published) -> DataFrame:
    return facets_of_cells(published.read("overview_cells"))


def _with_alerts(counts: DataFrame, summary: DataFrame) -> DataFrame:
    alerts = alert_count(summary).select(
        F.lit("exception_count").alias("metric"), F.lit("").alias("name"), F.col("alerts").alias("n"),
        F.lit(None).cast("long").alias("first"))
    return counts.unionByName(alerts)


def merge_shape(refresh_log: DataFrame) -> DataFrame:
    """Matched, curated-only and bulk-only counts of a refresh log; absent ones are 0."""
    have = refresh_log.schema["merge"].dataType.names
    return refresh_log.select(*[
        F.coalesce(F.col(f"merge.{name}") if name in have else F.lit(None).cast("long"), F.lit(0).cast("long")).alias(name)
        for name in ("matched", "curated_only", "bulk_only")])


def last_refresh(refresh_log: DataFrame) -> DataFrame:
    return refresh_log.select("last_run")
