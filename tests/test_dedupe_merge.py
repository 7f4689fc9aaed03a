"""Duplicate folding and merging against plain-Python models."""

import random
import re

from pyspark.sql import functions as F

from masterloom.functions import fixed_values as fv
from masterloom.operators.dedupe import absorb_duplicates, first_per_key, with_key
from masterloom.operators.merge import bulk_remainder, merge_sources
from masterloom.operators.normalize import normalize_bulk, normalize_curated
from masterloom.plans.mastering import build_master


def run_at():
    return F.lit("2026-01-01").cast("timestamp")


BULK = "row_index long, number string, title string, abstract string, status string, current_assignee string, inventors string, filing_date string"
CURATED = "row_index long, number string, country string, title string, ip_status string, product_line string, filing_date string"


def bulk_rows(seed, n, keys):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    rows = []
    for i in range(n):
        # A third of all rows carry one number.
        key = "EP1" if rng.random() < 0.33 else pick("-", "PRO", *(f"EP{rng.randrange(2, keys)}" for _ in range(6)))
        rows.append((i, key + pick("", "A1", "B2") if key[:2] == "EP" else key, pick(None, f"t{i}"), pick(None, "nan", f"a{i}"),
                     pick(None, "Pending", "odd", "Expired"), pick(None, "Recurrent Solutions", f"h{i % 3}"),
                     pick(None, "a,b,a", f"n{i % 4}, ,a", f"n{i % 5},n{i % 3}"), pick(None, "1/2/2003", f"3/4/20{i % 90:02d}")))
    rng.shuffle(rows)
    return rows


def fold(records):
    """The duplicate rules, row by row."""
    kept = None
    for r in sorted(records, key=lambda r: r["row_index"]):
        if kept is None:
            kept = dict(r, inventors=list(r["inventors"]))
            continue
        if kept["status"]["value"] == "unknown" != r["status"]["value"]:
            kept["status"] = r["status"]
        if r["assignee"]["is_confirmed_owner"] and not kept["assignee"]["is_confirmed_owner"]:
            kept["assignee"] = r["assignee"]
        for field in ("title", "abstract", "claims_text", "filing_date", "grant_date"):
            kept[field] = kept[field] or r[field]
        kept["inventors"] += [v for i, v in enumerate(r["inventors"]) if v not in kept["inventors"] and v not in r["inventors"][:i]]
    return kept


def test_absorb_matches_model(spark):
    normal = normalize_bulk(spark.createDataFrame(bulk_rows(1, 600, 60), BULK).repartition(5)).drop("raw").cache()
    groups = {}
    for r in normal.collect():
        r = r.asDict(recursive=True)
        groups.setdefault(r["normalized_number"] or ("loose", r["row_index"]), []).append(r)
    want = {r["row_index"]: r for r in map(fold, groups.values())}
    got = {r["row_index"]: r for r in (r.asDict(recursive=True) for r in absorb_duplicates(with_key(normal, "b")).drop("_key").collect())}
    assert got == want


def test_first_per_key(spark):
    rows = [(3, "EP1", "EP", "c", None, None, None), (1, "EP1", "EP", "a", None, None, None), (2, None, "EP", "b", None, None, None),
            (4, None, "EP", "d", None, None, None)]
    df = first_per_key(with_key(normalize_curated(spark.createDataFrame(rows, CURATED)), "c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.title for r in df.collect()) == ["a", "b", "d"]


def test_merge_fields(spark):
    curated = normalize_curated(spark.createDataFrame([
        (0, "1", "US", "T", "lapsed?", "L", None),
        (1, "2", "US", None, "Granted", "", "2001-01-01"),
        (2, "-", "FR", "T2", None, None, None),
        (3, None, None, None, None, None, None),
        (4, None, None, "only title", None, None, None),
        (5, "PRO", "US", "p", None, None, None),
    ], CURATED))
    bulk = normalize_bulk(spark.createDataFrame([
        (0, "US1", "bt", "abs", "Pending", None, "x,y", "1/2/2003"),
        (1, "US2", "bt2", None, "Expired", "who", None, "1/2/2003"),
        (2, "US3", None, None, None, "Recurrent Solutions", None, None),
        (3, "PRO", None, None, None, None, None, None),
        (4, None, "gone", None, None, None, None, None),
    ], BULK))
    merged = merge_sources(curated, bulk, F.lit("2026-01-01").cast("timestamp")).orderBy("seq").collect()
    first, second, made, title_only, placeholder, lone, loose = merged
    assert (first.status.value, first.status.source, first.status.raw_curated, first.status.raw_bulk) == ("pending", "csv", "lapsed?", "Pending")
    assert (first.title.value, first.title.source, first.abstract.value, first.inventors.value) == ("T", "xlsx", "abs", ["x", "y"])
    assert (first.assignee.normalized, first.assignee.is_confirmed_owner, first.assignee.needs_review, first.assignee.source) == (
        fv.HOUSE_OWNER, True, False, "csv")
    # Flags are those of the sources, also where the other source filled the gap.
    assert first.data_quality_flags == ["unknown_status", "missing_filing_date", "assignee_needs_review"]
    assert (first.filing_date.source, str(first.filing_date.value)) == ("csv", "2003-01-02")
    assert (second.title.value, second.title.source, second.status.value) == ("bt2", "csv", "active")
    assert second.assignee.normalized == "who"
    # A foreign number that is all noise gets a made-up key but stays a placeholder.
    assert (made.normalized_number, made.patent_type, made.is_placeholder, made.status.value) == ("FR", "foreign", True, "pending")
    assert (title_only.title.value, title_only.country, title_only.normalized_number, title_only.assignee.source) == ("only title", None, None, "xlsx")
    assert (placeholder.patent_type, placeholder._sources) == ("provisional", ["xlsx"])
    assert (lone.normalized_number, lone._sources, lone.assignee.is_confirmed_owner) == ("US3", ["csv"], True)
    assert (loose.normalized_number, loose._bulk_row_index, loose.assignee.normalized) == (None, 3, None)
    assert len({r.id for r in merged}) == len(merged)
    assert [r.normalized_number for r in bulk_remainder(curated, bulk).orderBy("row_index").collect()] == ["US3", None]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_full_merge_shuffles(spark):
    """All columns: one exchange per side, two for the inventors, each scan of what it reads only."""
    curated = normalize_curated(spark.createDataFrame([], CURATED))
    bulk = normalize_bulk(spark.createDataFrame([], BULK))
    assert exchanges(merge_sources(curated, bulk, run_at())) == 4


def test_texts_move_once(spark, tmp_path):
    """In the plan of the whole master, one scan reads texts and one exchange moves them."""
    rows = spark.createDataFrame(bulk_rows(2, 300, 40), BULK).withColumn("claims", F.col("abstract"))
    rows.write.parquet(str(tmp_path / "bulk"))
    curated = spark.createDataFrame([(i, f"EP{i}", "EP", f"t{i}", "Granted", None, None) for i in range(60)], CURATED)
    built = build_master(curated, spark.read.parquet(str(tmp_path / "bulk")), run_at())
    long_plan = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "100000"}
    for key, value in long_plan.items():
        spark.conf.set(key, value)
    plan = built.master._jdf.queryExecution().executedPlan().toString()
    for key in long_plan:
        spark.conf.unset(key)
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", plan + "\n", re.S)
    wide = [schema for schema in schemas if "claims" in schema]
    assert len(schemas) == 2 and wide == ["row_index:bigint,number:string,abstract:string,claims:string"], schemas
    # One exchange of the folded texts, one of the records they are joined to.
    assert plan.count("Exchange hashpartitioning") == 2, plan
    # No table written before the master holds a text.
    for df in (built.bulk, built.curated, built.records):
        assert not {"abstract", "claims_text", "raw"} & set(df.columns)


def test_late_texts_change_nothing(spark):
    curated = spark.createDataFrame([(i, f"EP{i}" if i % 3 else None, "EP", f"t{i}", "Granted", None, None) for i in range(60)], CURATED)
    bulk = spark.createDataFrame(bulk_rows(3, 500, 40), BULK).withColumn("claims", F.when(F.col("row_index") % 3 == 0, F.col("title")))
    at_once = merge_sources(normalize_curated(curated), normalize_bulk(bulk), run_at())
    late = build_master(curated, bulk, run_at()).master
    assert late.columns[:len(at_once.columns)] == at_once.columns
    shown = lambda df: sorted(map(str, df.select([c for c in at_once.columns if c != "data_quality_flags"]).collect()))
    assert shown(late) == shown(at_once)
