"""Versions, failed refreshes, sources that are kept, corrections at display."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from masterloom.operators.snapshots import freshness
from masterloom.plans import refresh as plan
from masterloom.plans.refresh import refresh
from masterloom.plans.view import published_rows
from masterloom.session import scratch_dir, scratch_run, written
from masterloom.sinks.files import exists, names
from masterloom.sinks.versions import KEEP, Publication, published_versions
from masterloom.sources.published import Published
from workload.frames import bulk_rows, curated_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sources(spark):
    return curated_rows(spark, SF), bulk_rows(spark, SF)


@pytest.fixture(scope="module")
def first(spark, sources, tmp_path_factory):
    return refresh(spark, *sources, str(tmp_path_factory.mktemp("refresh")))


def shown(master):
    return sorted(map(str, master.withColumn("status", F.col("status.value")).drop("last_refreshed", "stale_since").collect()))


def scratch_runs(spark):
    return [n for n in names(spark, f"{scratch_dir(spark)}/masterloom") if n.startswith("run-")]


def test_versions(spark, tmp_path):
    out = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        Published(spark, out)
    made = []
    for k in range(KEEP + 2):
        p = Publication(spark, out)
        p.write(spark.range(k), "t")
        if k == 1:
            continue  # one that died
        made.append(p.publish())
        assert Published(spark, out).read("t").count() == k
    assert published_versions(spark, out) == sorted(made)[-KEEP:] and len(names(spark, f"{out}/versions")) == KEEP
    # A reader stays with its version; a refresh under way is not seen and not removed.
    pinned = Published(spark, out)
    under_way = Publication(spark, out)
    under_way.write(spark.range(99), "t")
    later = Publication(spark, out)
    later.write(spark.range(50), "t")
    later.publish()
    assert pinned.read("t").count() == KEEP + 1 and Published(spark, out).version == later.version
    assert exists(spark, under_way.path("t"))
    with pytest.raises(FileNotFoundError):
        Published(spark, out, under_way.version)


def test_scratch_of_a_run_goes(spark):
    before = scratch_runs(spark)
    with pytest.raises(KeyError):
        with scratch_run(spark):
            written(spark.range(3), "x")
            assert len(scratch_runs(spark)) == len(before) + 1
            raise KeyError
    assert scratch_runs(spark) == before and "run-" not in written(spark.range(3), "x").inputFiles()[0]


def test_failed_refresh_leaves_the_last_version(spark, sources, first, monkeypatch):
    before = shown(first.master())
    left = scratch_runs(spark)

    def fails(*_):
        raise OSError("disk full")

    monkeypatch.setattr(plan, "exception_rows", fails)
    with pytest.raises(OSError):
        refresh(spark, sources[0].limit(3), sources[1].limit(3), first.folder)
    again = Published(spark, first.folder)
    assert again.version == first.version and shown(again.master()) == before
    assert again.exceptions().count() > 0 and names(spark, f"{first.folder}/versions") == [first.version]
    assert scratch_runs(spark) == left
    failed = again.runs().where("outcome = 'failed'").collect()
    assert {r.source for r in failed} == {"xlsx", "csv"} and all("disk full" in r.error and r.refreshed_at is None for r in failed)


def test_source_that_failed_is_kept(spark, sources, first):
    """Either source: the master is the one before, its records say since when they are stale."""
    before = shown(first.master())
    cases = (("csv", (sources[0], None)), ("xlsx", (None, sources[1])))
    for label, given in cases:
        at = {r.source: r.last for r in first.runs().groupBy("source").agg(F.max("refreshed_at").alias("last")).collect()}
        out = refresh(spark, *given, first.folder, errors={label: "no answer"})
        rows = out.master()
        assert shown(rows) == before
        stale = {r.id: r.stale_since for r in rows.collect()}
        inside = "status.raw_bulk IS NOT NULL OR abstract.value IS NOT NULL" if label == "csv" else "product_line.value IS NOT NULL"
        assert all(stale[r.id] == at[label] for r in rows.where(inside).select("id").collect())
        assert None in stale.values() and out.refresh_log().first().errors == [f"{label}: no answer"]
        last = {r.source: r.last_refresh for r in freshness(out.runs(), F.lit(datetime.now())).collect()}
        assert last[label] == at[label] < last["csv" if label == "xlsx" else "xlsx"]
        assert out.read("changes").count() == 0
    with pytest.raises(ValueError):
        refresh(spark, None, None, first.folder)
    assert out.runs().where("outcome = 'failed'").count() >= 2


def test_first_refresh_needs_both(spark, sources, tmp_path):
    with pytest.raises(ValueError):
        refresh(spark, sources[0], None, str(tmp_path))
    assert published_versions(spark, str(tmp_path)) == []


def test_changes_of_edited_sources(spark, sources, first):
    curated, bulk = sources
    edited = curated.withColumn("product_line", F.when(F.col("row_index") % 2 == 0, "New line").otherwise(F.col("product_line"))).where(
        "row_index % 10 <> 3")
    before = {r.id: r for r in Published(spark, first.folder).master().collect()}
    out = refresh(spark, edited, bulk, first.folder)
    after = {r.id: r for r in out.master().collect()}
    got = {(r.id, r.change, r.field): (r.before, r.after) for r in out.read("changes").collect()}
    want = {}
    for key in before.keys() | after.keys():
        if key not in before or key not in after:
            want[key, "added" if key in after else "removed", None] = (None, None)
            continue
        b, a = before[key], after[key]
        for field in plan.COMPARED:
            get = lambda r: r.assignee.normalized if field == "owner" else r.family_id if field == "family_id" else r[field].value  # noqa: E731,B023
            if get(b) != get(a):
                want[key, "changed", field] = tuple(None if get(r) is None else str(get(r)) for r in (b, a))
    assert got == want and {k[1] for k in got} >= {"changed", "removed"}


def test_corrections_outlive_a_refresh(spark, sources, first):
    now = Published(spark, first.folder)
    active = now.master().where("status.value = 'active'")
    row, hidden = active.orderBy("seq").first(), active.orderBy(F.desc("seq")).first()
    at = datetime(2026, 1, 1)
    log = [(row.id, "status", "pending", "checked", "me", at), (hidden.id, "exclude", "true", "checked", "me", at)]
    spark.createDataFrame(log, now.overrides().schema).write.mode("append").parquet(now.path("overrides"))

    def check(published):
        rows = {r.id: r.status for r in published_rows(published).collect()}
        assert rows[row.id] == "pending" and hidden.id not in rows

    check(now)
    check(refresh(spark, *sources, first.folder))


def test_folder_listing(spark, tmp_path):
    assert names(spark, str(tmp_path / "none")) == [] and not os.path.exists(tmp_path / "none")


def test_the_log_of_a_published_version_needs_no_build(spark, tmp_path, monkeypatch):
    import workload.queries as queries

    master = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1 << 60)], "id string, seq long")
    spark.sql("SELECT id AS event_id, 'view' AS event_type, id AS user_id, timestamp'2024-01-01' AS ts FROM range(9)").write.parquet(
        f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "mastered", None)
    log = queries._override_log(spark, str(tmp_path), master)
    assert log.count() == 9 and {r["id"] for r in log.collect()} == {"a", "b", "c"}


def test_landed_files_grow_in_number(spark, monkeypatch):
    import workload.queries as queries

    read = []
    monkeypatch.setattr(queries, "FILE_ROWS", 200)
    monkeypatch.setattr(queries, "read_bulk", lambda s, folder: read.append(folder) or s.read.text(folder))
    sf = "/root/testdata/sf0.001"
    queries.landed_bulk(spark, sf)
    rows = queries.bulk_rows(spark, sf).count()
    assert len(spark.read.text(read[0]).inputFiles()) >= rows // 200 > 4
