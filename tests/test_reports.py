"""Reports: the identities that tie the counts of one run together."""

import pytest
from pyspark.sql import functions as F

from masterloom.operators import overrides, quality, snapshots, stats
from workload.queries import bulk_rows, curated_rows, mastered
from masterloom.operators.normalize import normalize_bulk, normalize_curated


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def built(request, spark):
    return mastered(spark, f"/root/testdata/sf{request.param}")


def counts(built):
    summary = {r.category: r.n for r in quality.exception_summary(built.master, built.families).collect()}
    return summary, stats.merge_stats(built.master).first()


def test_identities(built):
    summary, merge = counts(built)
    curated = stats.curated_summary(built.curated).first()
    bulk = stats.bulk_summary(built.bulk).first()
    unknown_country = built.master.where("country IS NULL").count()
    placeholders = built.master.where("is_placeholder AND size(_sources) = 1 AND _sources[0] = 'xlsx'").count()
    assert merge.matched + merge.curated_only + merge.bulk_only == merge.total_records
    assert bulk.unique_normalized + bulk.unparseable_numbers - merge.matched == merge.bulk_only
    assert summary["curated_only"] == merge.curated_only - placeholders
    assert summary["bulk_only_non_owner"] + summary["bulk_only_historical"] == merge.bulk_only
    assert merge.families == merge.home_records + unknown_country + summary["foreign_orphans"] == built.families.count()
    assert summary["assignee_review"] == summary["bulk_only_non_owner"]
    assert merge.home_records + merge.foreign_records + unknown_country == merge.total_records
    assert summary["missing_tech_cluster"] == merge.total_records
    assert curated.us_rows + curated.foreign_rows == curated.total_rows
    assert set(summary) == {*quality.record_tests(), quality.OVERSIZED}


def test_exception_rows_agree_with_summary(built):
    summary, _ = counts(built)
    rows = {r.category: r["count"] for r in quality.exception_rows(built.master).groupBy("category").count().collect()}
    assert {c: rows.get(c, 0) for c in quality.record_tests()} == {c: n for c, n in summary.items() if c != quality.OVERSIZED}
    preview = quality.exception_preview(built.master, shown=7).groupBy("category").agg(
        F.count("*").alias("n"), F.max("place").alias("last"), F.max("total").alias("total"), F.max("truncated").alias("cut")).collect()
    for r in preview:
        assert (r.n, r.last, r.total, r.cut) == (min(7, summary[r.category]), r.n, summary[r.category], summary[r.category] > 7)


def test_unique_record_order(built):
    assert built.master.select("seq").distinct().count() == built.master.count()


def test_sources_are_the_given_tables(spark):
    d = "/root/testdata/sf0.001"
    assert normalize_bulk(bulk_rows(spark, d)).count() > 1000 and normalize_curated(curated_rows(spark, d)).count() > 50


def test_overview_breakdown_order(built):
    all_counts = stats.overview_counts(built.master)
    lines = stats.overview_breakdown(all_counts, "by_product_line", 3).collect()
    assert len(lines) == 3 and [r.n for r in lines] == sorted((r.n for r in lines), reverse=True)
    decades = [r.name for r in stats.overview_breakdown(all_counts, "by_decade").collect()]
    assert decades == sorted(decades) and all(d.endswith("0s") for d in decades)


def test_overrides(spark, built):
    ids = [r.id for r in built.master.orderBy("seq").limit(3).collect()]
    log = spark.createDataFrame([
        (ids[0], "status", "dead", "", "me", "2026-01-02 00:00:00"),
        (ids[0], "status", "active", "", "me", "2026-01-01 00:00:00"),
        (ids[0], "technology_cluster", "a, b", "", "me", "2026-01-01 00:00:00"),
        (ids[1], "exclude", "true", "", "me", "2026-01-01 00:00:00"),
        (ids[2], "exclude", "true", "", "me", "2026-01-01 00:00:00"),
        (ids[2], "exclude", "false", "", "me", "2026-01-03 00:00:00"),
        (ids[2], "assignee_confirmed", "true", "", "me", "2026-01-03 00:00:00"),
    ], "id string, field string, value string, reason string, applied_by string, at string").withColumn("applied_at", F.to_timestamp("at"))
    out = {r.id: r for r in overrides.apply_overrides(built.master, log).collect()}
    first, third = out[ids[0]], out[ids[2]]
    assert (first.status.value, first.status.source, first.status.override) == ("dead", "manual", "dead")
    assert (first.technology_cluster.value, first.technology_cluster.was_overridden) == (["a", "b"], True)
    assert ids[1] not in out and len(out) == built.master.count() - 1
    assert third.assignee.is_confirmed_owner and third.assignee.source == "manual" and not third.notes.was_overridden


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "z"), (4, "d", "q")], "k int, v string, w string")
    diff = {tuple(r) for r in snapshots.snapshot_diff(old, new, "k", ["v", "w"]).collect()}
    assert diff == {(1, "removed", None, None, None), (2, "changed", "v", "b", "B"), (4, "added", None, None, None)}
    kept = {tuple(r) for r in snapshots.keep_good(old, new, "k", ["v", "w"], F.col("v") == "B").collect()}
    assert kept == {(1, "a", "x", True), (2, "b", None, True), (3, "c", "z", False), (4, "d", "q", False)}


def test_freshness_lists_named_sources(spark):
    log = spark.createDataFrame([("xlsx", "2026-01-01"), ("xlsx", "2026-02-01"), ("csv", "2025-12-01")], "source string, at string").select(
        "source", F.to_timestamp("at").alias("refreshed_at"))
    rows = snapshots.freshness(log, F.lit("2026-02-10").cast("date"), sources=("xlsx", "api")).collect()
    assert {(r.source, str(r.last_refresh)[:10], r.stale) for r in rows} == {
        ("xlsx", "2026-02-01", False), ("csv", "2025-12-01", True), ("api", "None", None)}


def test_cells_sum_to_the_master(built):
    cells = stats.overview_cells(built.master)
    assert cells.agg(F.sum("n")).first()[0] == built.master.count()
    assert [tuple(r) for r in stats.facets_of_cells(cells).collect()] == [
        tuple(r) for r in stats.facets(built.master.select(F.col("product_line.value").alias("product_line"), "country")).collect()]
    totals = {r.metric: r.n for r in stats.overview_of_cells(cells).where("name = ''").collect()}
    assert totals["family_count"] == built.families.count()
    assert stats.overview_counts(built.master.limit(0)).where("metric <> 'jurisdiction_count'").count() == 0  # no rows, no figures
