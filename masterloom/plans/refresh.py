"""One refresh: build the master, write every output, publish them at once.

A refresh that fails leaves the last good version as it is. A source that could not be
landed doesn't hold up the other: its rows are those of the last good version, and the
records that it had a part in say since when they are stale.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rules import rule_snapshot
from ..operators.families import family_members, member_lists
from ..operators.merge import has_source, texts_of
from ..operators.overrides import OVERRIDE_SCHEMA
from ..operators.quality import exception_rows, exception_summary, oversized_families
from ..operators.snapshots import snapshot_diff
from ..operators.stats import bulk_summary, curated_summary, merge_stats, overview_cells, taxonomy, top_countries
from ..session import scratch_run, written
from ..sinks.tables import BOOKKEEPING, seed
from ..sinks.versions import Publication, published_versions
from ..sources.published import Published
from .mastering import Mastered, build_records, normalized_sources

SOURCES = (fv.CURATED, fv.BULK)
RUN_SCHEMA = ("version string, source string, started_at timestamp, refreshed_at timestamp, outcome string, error string")
# Fields of a record whose changes since the version before are listed.
COMPARED = ("title", "status", "owner", "filing_date", "grant_date", "expiration_date", "product_line", "family_id")


def _one_struct(summary: DataFrame, name: str) -> DataFrame:
    return summary.select(F.struct("*").alias(name))


def last_good(spark: SparkSession, out: str) -> Published | None:
    return Published(spark, out) if published_versions(spark, out) else None


def last_refreshed(runs: DataFrame, source: str) -> datetime | None:
    """When rows of the source were last read."""
    return runs.where((F.col("source") == source) & F.col("refreshed_at").isNotNull()).agg(F.max("refreshed_at")).first()[0]


def _log_run(spark: SparkSession, path: str, version: str, started: datetime, outcomes: dict[str, tuple[str, str | None]]) -> None:
    """One row per source, appended; read whole by ``freshness``."""
    rows = [(version, source, started, started if outcome == "refreshed" else None, outcome, error)
            for source, (outcome, error) in outcomes.items()]
    spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _sources(curated_rows: DataFrame | None, bulk_rows: DataFrame | None, before: Published | None
             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised rows and texts; those of the last good version for a source that failed."""
    if curated_rows is None and bulk_rows is None:
        raise ValueError("no source to refresh from")
    if None in (curated_rows, bulk_rows) and before is None:
        raise ValueError("the first refresh needs both sources")
    curated, bulk, texts = normalized_sources(
        before.spark.createDataFrame([], "row_index long") if curated_rows is None else curated_rows,
        before.spark.createDataFrame([], "row_index long") if bulk_rows is None else bulk_rows)
    if curated_rows is None:
        curated = before.read("curated")
    if bulk_rows is None:
        bulk, texts = before.read("bulk"), texts_of(before.master())
    return curated, bulk, texts


def _stale_since(failed: dict[str, datetime | None]) -> Column:
    """The oldest of the last refreshes of a record's sources that failed this time."""
    times = [F.when(has_source(source), F.lit(at)) for source, at in failed.items() if at is not None]
    none = F.lit(None).cast("timestamp")
    return F.least(*times, none) if times else none


def _compared(master: DataFrame) -> DataFrame:
    nested = {"owner": "assignee.normalized", "family_id": "family_id"}
    return master.select("id", "seq", *[F.col(nested.get(f, f"{f}.value")).alias(f) for f in COMPARED])


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two masters, by id. Records that share an id are told apart by
    their place among those, in emission order."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    keyed = lambda m: _compared(m).withColumn("key", F.concat_ws("#", "id", place)).drop("seq", "id")
    found = snapshot_diff(keyed(before), keyed(after), "key", COMPARED)
    return found.select(F.substring_index("key", "#", 1).alias("id"), "change", "field", "before", "after")


def _write_log(outputs: Publication, built: Mastered, records: DataFrame, summary: DataFrame, run_at: Column, started: float,
               errors: list[str]) -> None:
    # Four one-row frames, side by side.
    countries = top_countries(built.bulk).agg(F.map_from_entries(
        F.transform(F.sort_array(F.collect_list(F.struct(-F.col("count"), "first", "country", "count"))),
                    lambda e: F.struct(e["country"], e["count"]))).alias("m"))
    merge = merge_stats(records)
    counts = summary.agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))
    bulk = bulk_summary(built.bulk).withColumn("by_country_top10", countries.scalar())
    parts = _one_struct(curated_summary(built.curated), "curated").withColumns({
        "bulk": _one_struct(bulk, "bulk").scalar(),
        "merge": _one_struct(merge, "merge").scalar(),
        "exceptions_summary": counts.scalar(),
    })
    parts = written(parts, "log")
    outputs.write(parts.select(
        run_at.alias("last_run"),
        F.lit(round(time.time() - started, 2)).alias("duration_seconds"),
        "curated", "bulk", "merge", "exceptions_summary",
        F.array(*map(F.lit, errors)).cast("array<string>").alias("errors"),
    ), "refresh_log")


def refresh(spark: SparkSession, curated_rows: DataFrame | None, bulk_rows: DataFrame | None, out: str,
            similar_percent: int | None = None, errors: dict[str, str] | None = None) -> Published:
    """Build and publish a new version under the folder ``out``, and return it.

    A source that could not be landed is given as None, with the reason in ``errors`` (by
    label); its last good rows are used. If the refresh itself fails, the version before stays,
    the failure is logged and raised. Every report reads the written records, so a lost
    executor repeats a report, not the build. Scratch tables are removed at the end.
    """
    started = time.time()
    now = datetime.now(timezone.utc).replace(microsecond=0)
    outputs, before = Publication(spark, out), last_good(spark, out)
    runs = f"{outputs.out}/runs"
    outcomes = {source: ("refreshed", None) if rows is not None else ("kept", (errors or {}).get(source, "not landed"))
                for source, rows in zip(SOURCES, (curated_rows, bulk_rows))}
    try:
        with scratch_run(spark):
            _write_tables(spark, outputs, before, curated_rows, bulk_rows, outcomes, now, started, similar_percent)
    except Exception as error:
        outputs.abandon()
        _log_run(spark, runs, outputs.version, now, {s: ("failed", f"{type(error).__name__}: {error}"[:500]) for s in SOURCES})
        raise
    # Logged first: a run without a version is listed, a version without a run would not be.
    _log_run(spark, runs, outputs.version, now, outcomes)
    return Published(spark, out, outputs.publish())


def _write_tables(spark: SparkSession, outputs: Publication, before: Published | None, curated_rows: DataFrame | None,
                  bulk_rows: DataFrame | None, outcomes: dict, now: datetime, started: float, similar_percent: int | None) -> None:
    run_at = F.lit(now).cast("timestamp")
    curated, bulk, texts = _sources(curated_rows, bulk_rows, before)
    built = build_records(outputs.write(curated, "curated"), outputs.write(bulk, "bulk"), texts, run_at,
                          similar_percent=similar_percent)
    failed = {s: last_refreshed(before.runs(), s) for s, (outcome, _) in outcomes.items() if outcome != "refreshed"}

    # Only the output holds the texts; every report reads the records, which don't.
    records = built.records
    master = outputs.write(built.master.withColumn("stale_since", _stale_since(failed)).drop(*BOOKKEEPING), "master")
    outputs.write(built.families, "families")
    outputs.write(family_members(records).drop("seq"), "family_members")
    outputs.write(member_lists(records), "member_lists")
    outputs.write(exception_rows(records), "exceptions", partition_by="category")
    outputs.write(oversized_families(built.families), "oversized_families")
    summary = outputs.write(exception_summary(records, built.families), "exception_summary")
    outputs.write(overview_cells(records).coalesce(1), "overview_cells")
    outputs.write(changes(before.master() if before else master.limit(0), master), "changes")
    outputs.write(rule_snapshot(spark), "owner_rules")
    _write_log(outputs, built, records, summary, run_at, started, [f"{s}: {e}" for s, (o, e) in outcomes.items() if o != "refreshed"])

    seed(taxonomy(records, "product_line").select("name", "count", F.array().cast("array<string>").alias("aliases")),
         f"{outputs.out}/taxonomy_product_lines")
    seed(taxonomy(records, "model").select("name", "count", F.lit(None).cast("string").alias("product_line")),
         f"{outputs.out}/taxonomy_models")
    seed(spark.createDataFrame([], OVERRIDE_SCHEMA), f"{outputs.out}/overrides")
