"""The registered queries: each operator run over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masterloom.functions import display, fixed_values as fv
from masterloom.functions.identifiers import with_number
from masterloom.functions.text import iso, title_key, with_clean
from masterloom.operators import families as fam
from masterloom.operators import overrides, pages, quality, rule_tables, snapshots, stats, view
from masterloom.operators.dedupe import absorb_duplicates, first_per_key, with_key
from masterloom.operators.merge import bulk_remainder, has_source
from masterloom.operators.normalize import normalize_bulk, normalize_curated
from masterloom.operators.numbering import with_dense_number
from masterloom.operators.search import search
from masterloom.operators.similar_titles import PERCENT, best_similar
from masterloom.plans.mastering import build_master
from masterloom.plans.overview import merge_shape as overview_shape
from masterloom.plans.overview import overview, published_facets, published_overview
from masterloom.plans.refresh import refresh
from masterloom.plans.view import published_rows
from masterloom.plans.view import view as table_view
from masterloom.session import scratch_dir, written
from masterloom.sinks.tables import export_csv, export_json
from masterloom.sources.landing import read_bulk
from masterloom.sources.published import Published, read_json, record_by_id
from masterloom.sources.schemas import BULK_HEADERS

from .frames import bulk_rows, curated_rows

RUN_AT = "2026-01-01 00:00:00"
AS_OF = "2026-01-01"
FRESH_AS_OF = "2024-02-28"
SEARCH_QUERY = "smal wdget"
LONG_QUERY = "small widgets and - medium size, brand#25"
# A record takes the overrides of the events that fall on its number.
OVERRIDE_STEP = 7919
LOOKUP_NUMBER = "EP1000074"
DEEP_PAGE, PAGE_RANGE = 3, 60
# Rows of a landed file.
FILE_ROWS = 200_000

@dataclass
class Built:
    curated: DataFrame
    bulk: DataFrame
    master: DataFrame
    families: DataFrame


_built: dict[tuple[str, str], Built] = {}


def mastered(spark: SparkSession, sf_dir: str) -> Built:
    """The master of a data folder, built and written once per application;
    the reports read the written table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        built = build_master(curated_rows(spark, sf_dir), bulk_rows(spark, sf_dir), F.lit(RUN_AT).cast("timestamp"))
        _built[key] = Built(built.curated, built.bulk, written(built.master, "master"), built.families)
    return _built[key]


def joined(column: str | Column) -> Column:
    return F.array_join(column, "|")


# --- normalisation ------------------------------------------------------------

def curated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_curated(curated_rows(spark, sf_dir)).select(
        "row_index", "section", "raw_number", "normalized_number", "country", "patent_type", "is_placeholder",
        F.col("status.value").alias("status"), F.col("status.sub_tag").alias("sub_tag"),
        F.col("status.raw").alias("status_raw"), "title", iso(F.col("filing_date")).alias("filing_date"),
        iso(F.col("grant_date")).alias("grant_date"), iso(F.col("expiration_date")).alias("expiration_date"),
        "model", "product_line", "google_patents_link", joined("data_quality_flags").alias("flags"))


def bulk_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "row_index", "raw_number", "normalized_number", "country", "patent_type", "is_placeholder",
        F.col("status.value").alias("status"), F.col("status.sub_tag").alias("sub_tag"),
        F.col("status.raw").alias("status_raw"), F.col("assignee.raw").alias("owner_raw"),
        F.col("assignee.normalized").alias("owner"), F.col("assignee.is_confirmed_owner").alias("confirmed"),
        F.col("assignee.needs_review").alias("review"), "title", "abstract", "claims_text",
        iso(F.col("filing_date")).alias("filing_date"), iso(F.col("grant_date")).alias("grant_date"),
        joined("inventors").alias("inventors"), joined("data_quality_flags").alias("flags"))


def bulk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk_columns(normalize_bulk(bulk_rows(spark, sf_dir)))


def normalize_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_bulk(bulk_rows(spark, sf_dir)).select(
        "row_index", "raw_number", "normalized_number", "country", "patent_type", "is_placeholder")


def normalize_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_bulk(bulk_rows(spark, sf_dir)).groupBy(
        F.col("status.raw").alias("raw"), F.col("status.value").alias("status"),
        F.col("status.sub_tag").alias("sub_tag"), "is_placeholder").agg(F.count("*").alias("n"))


def normalize_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_bulk(bulk_rows(spark, sf_dir)).groupBy(
        F.col("assignee.raw").alias("raw"), F.col("assignee.normalized").alias("owner"),
        F.col("assignee.is_confirmed_owner").alias("confirmed"), F.col("assignee.needs_review").alias("review"),
        F.col("assignee.known_non_owner").alias("known_non_owner")).agg(F.count("*").alias("n"))


def owner_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of every bulk row by the rules as tables."""
    raw = with_clean(bulk_rows(spark, sf_dir), ("number", "current_assignee")).where(F.col("number").isNotNull())
    rows = written(raw.select("row_index", "current_assignee"), "owners")
    owned = rule_tables.with_owner_of_table(
        rows, "assignee", "current_assignee", "row_index", rule_tables.fixed_owner_rules(spark), rule_tables.fixed_non_owners(spark))
    return owned.groupBy(
        F.col("assignee.raw").alias("raw"), F.col("assignee.normalized").alias("owner"),
        F.col("assignee.is_confirmed_owner").alias("confirmed"), F.col("assignee.needs_review").alias("review"),
        F.col("assignee.known_non_owner").alias("known_non_owner")).agg(F.count("*").alias("n"))


def status_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every bulk row by the rules as a table."""
    raw = with_clean(bulk_rows(spark, sf_dir), ("number", "status")).where(F.col("number").isNotNull())
    rows = with_number(raw, F.col("number"), prefix="n_").select("row_index", "status", F.col("n_is_placeholder").alias("is_placeholder"))
    known = rule_tables.with_status_of_table(
        written(rows, "statuses"), "s", "status", "row_index", F.col("is_placeholder"), rule_tables.fixed_status_rules(spark))
    return known.groupBy(F.col("s.raw").alias("raw"), F.col("s.value").alias("status"), F.col("s.sub_tag").alias("sub_tag"),
                         "is_placeholder").agg(F.count("*").alias("n"))


def raw_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_bulk(bulk_rows(spark, sf_dir)).select(
        "row_index", "raw.number", "raw.title", "raw.abstract", "raw.main_text",
        iso(F.col("raw.filing_date")).alias("filing_date"), iso(F.col("raw.granted_date")).alias("granted_date"),
        "raw.status", "raw.current_assignee", "raw.inventors", "raw.claims", "raw.figure_urls")


# --- duplicates and merge -----------------------------------------------------

def dedupe_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk_columns(absorb_duplicates(with_key(normalize_bulk(bulk_rows(spark, sf_dir)), "b")))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_per_key(with_key(normalize_curated(curated_rows(spark, sf_dir)), "c"))
    return rows.select("row_index", "normalized_number", "raw_number", "country", "title")


def bulk_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = normalize_curated(curated_rows(spark, sf_dir))
    bulk = normalize_bulk(bulk_rows(spark, sf_dir))
    return bulk_remainder(curated, bulk).select("row_index", "normalized_number", "country", "title")


def merge_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("title", "abstract", "claims_text", "filing_date", "grant_date", "publication_date", "expiration_date",
              "product_line", "model", "google_patents_url", "notes")
    m = mastered(spark, sf_dir).master
    return m.select(
        "seq", "id", "raw_number", "normalized_number", "patent_type", "country", "is_placeholder",
        *[F.col(f"{f}.value").cast("string").alias(f) for f in fields],
        *[F.col(f"{f}.source").alias(f"{f}_source") for f in fields],
        F.col("title.was_overridden").alias("title_overridden"),
        F.col("status.value").alias("status"), F.col("status.sub_tag").alias("sub_tag"),
        F.col("status.source").alias("status_source"), F.col("status.raw_curated").alias("raw_curated"),
        F.col("status.raw_bulk").alias("raw_bulk"),
        F.col("assignee.raw").alias("owner_raw"), F.col("assignee.normalized").alias("owner"),
        F.col("assignee.is_confirmed_owner").alias("confirmed"), F.col("assignee.needs_review").alias("review"),
        F.col("assignee.source").alias("owner_source"), joined("inventors.value").alias("inventors"),
        "family_id", joined("data_quality_flags").alias("flags"), joined("_sources").alias("sources"),
        "_curated_row_index", "_bulk_row_index")


def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.merge_stats(mastered(spark, sf_dir).master)


# --- families -----------------------------------------------------------------

def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastered(spark, sf_dir).families.select(
        "family_id", "parent_id", "parent_number", "parent_title", "member_count",
        joined("countries").alias("countries"), "orphan", "oversized")


def _member_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "family_id", "place", "id", "normalized_number", "country", "status",
                     iso(F.col("filing_date")).alias("filing_date"), iso(F.col("grant_date")).alias("grant_date"))


def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _member_columns(fam.family_members(mastered(spark, sf_dir).master))


def family_member_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of every family, in lists of bounded size."""
    lists = fam.member_lists(mastered(spark, sf_dir).master, chunk_bits=8)
    return lists.select(
        "family_id", "chunk", F.size("members").cast("long").alias("n"),
        joined(F.transform("members", lambda m: F.concat_ws(
            "/", m["id"], F.coalesce(m["normalized_number"], F.lit("-")), F.coalesce(m["country"], F.lit("-")), m["status"],
            F.coalesce(iso(m["filing_date"]), F.lit("-")), F.coalesce(iso(m["grant_date"]), F.lit("-"))))).alias("members"))


def similar_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every curated foreign record without a parent of its title, and the parent of the most
    similar title, if one is similar enough."""
    records = mastered(spark, sf_dir).master.select(
        "seq", "family_no", "is_orphan", "is_parent", has_source(fv.CURATED).alias("has_curated"),
        title_key(F.col("title.value")).alias("title_key"))
    claims = fam.title_claims(records.where("is_parent AND NOT is_orphan")).withColumnRenamed("title_key", "title")
    alone = records.where("is_orphan AND has_curated").select("seq", F.col("title_key").alias("title"))
    best = best_similar(alone.select("title"), claims)
    return alone.join(best, "title", "left").select(
        "seq", "title", "family_no", F.col("other").alias("parent_title"), "distance")


def families_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families, where similar titles link too."""
    records = written(fam.family_input(mastered(spark, sf_dir).master), "family_input")
    return fam.build_families(records, similar_percent=PERCENT).families.select(
        "family_id", "parent_id", "member_count", joined("countries").alias("countries"), "orphan", "oversized")


def member_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.member_chunks(mastered(spark, sf_dir).master, chunk_bits=8).select(
        "family_id", "chunk", joined("member_ids").alias("member_ids"))


def oversized_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.oversized_families(mastered(spark, sf_dir).families).withColumn("countries", joined("countries"))


def siblings_of_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mastered(spark, sf_dir).master
    return _member_columns(fam.siblings(m, m.where("is_parent")), "of_id")


def record_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = mastered(spark, sf_dir)
    rows = fam.with_family_header(built.master.select("id", "seq", "family_id"), built.families)
    return rows.select("id", "seq", "family_id", "family.parent_id", "family.member_count", "family.orphan", "family.oversized")


def record_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of one number, found by its id."""
    record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, fv.ID_SEED_PREFIX + LOOKUP_NUMBER))
    rows = record_by_id(mastered(spark, sf_dir).master, record_id)
    return rows.select("id", "normalized_number", "country", F.col("title.value").alias("title"), "family_id")


def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.family_coverage(mastered(spark, sf_dir).master)


# --- quality ------------------------------------------------------------------

def _thin(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumn("flags", joined("flags")).select("category", *more, "seq", "id", "normalized_number", "raw_number", "title", "country",
                     "status", "status_sub_tag", "assignee", "product_line", "family_id", "flags")


def exceptions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thin(quality.exception_rows(mastered(spark, sf_dir).master))


def exception_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = mastered(spark, sf_dir)
    return quality.exception_summary(built.master, built.families)


def exception_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.exception_preview(mastered(spark, sf_dir).master)
    return rows.select("category", "place", "total", "truncated", "seq", "id",
                       display.display_number(F.col("normalized_number"), F.col("raw_number")).alias("number"),
                       display.short_list(F.col("flags")).alias("flags"))


def alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.alert_records(mastered(spark, sf_dir).master)


def alert_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.alert_count(exception_summary(spark, sf_dir))


def format_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.format_duplicates(normalize_bulk(bulk_rows(spark, sf_dir)))


# --- statistics ---------------------------------------------------------------

def curated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.curated_summary(normalize_curated(curated_rows(spark, sf_dir))).withColumn("countries", joined("countries"))


def bulk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bulk_summary(normalize_bulk(bulk_rows(spark, sf_dir)))


def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_countries(normalize_bulk(bulk_rows(spark, sf_dir)))


def merge_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = stats.merge_stats(mastered(spark, sf_dir).master).select(F.struct("*").alias("merge"))
    return overview_shape(log)


def taxonomy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.taxonomy(mastered(spark, sf_dir).master, "product_line")


def taxonomy_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.taxonomy(mastered(spark, sf_dir).master, "model")


def overview_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = mastered(spark, sf_dir)
    return overview(built.master, quality.exception_summary(built.master, built.families)).select("metric", "name", "n")


def overview_top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.overview_counts(mastered(spark, sf_dir).master)
    return stats.overview_breakdown(counts, "by_product_line", stats.TOP).select("name", "n", "first")


# --- table --------------------------------------------------------------------

def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.table_rows(mastered(spark, sf_dir).master)


def _shown_rows(rows: DataFrame) -> DataFrame:
    dates = {d: iso(F.col(d)) for d in ("filing_date", "grant_date", "expiration_date")}
    return rows.withColumns({**dates, "inventors": joined("inventors"), "flags": joined("flags")})


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_rows(_rows(spark, sf_dir))


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.facets(_rows(spark, sf_dir))


def view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_view(_rows(spark, sf_dir), statuses=("active", "pending"), countries=("US", "EP"), page_number=1)
    return rows.select("seq", "id", "title", "status", "country", iso(F.col("filing_date")).alias("filing_date"))


def view_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by number, read through the bounds of ranges."""
    rows = _rows(spark, sf_dir)
    bounds = written(pages.page_bounds(rows, "title", descending=False, range_rows=PAGE_RANGE), "page-bounds")
    return pages.page_by_number(rows, bounds, DEEP_PAGE, "title", descending=False).select("seq", "id", "title", "country")


def filtered_by_date_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view.filtered(_rows(spark, sf_dir), types=("utility", "design"), filed=("1995-01-01", "2005-12-31"))
    return rows.select("id", "patent_type", iso(F.col("filing_date")).alias("filing_date"))


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.page_count(_rows(spark, sf_dir))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.export_rows(view.sorted_rows(_rows(spark, sf_dir), "title", descending=False))


def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_rows(spark, sf_dir), SEARCH_QUERY).select("id", "title")


def search_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_rows(spark, sf_dir), LONG_QUERY).select("id", "title")


def search_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_view(_rows(spark, sf_dir), SEARCH_QUERY, sort_key="country", descending=False, page_number=0)
    return rows.select("seq", "id", "country", F.round("rank", 6).alias("rank"))


def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mastered(spark, sf_dir).master
    return m.select(
        "id",
        display.display_number(F.col("normalized_number"), F.col("raw_number")).alias("number"),
        display.external_link(F.col("google_patents_url.value"), F.col("normalized_number")).alias("link"),
        display.format_date(F.col("filing_date.value")).alias("filed"),
        display.year_of(F.col("filing_date.value")).alias("year"),
        display.decade(F.col("filing_date.value")).alias("decade"),
        display.status_label(F.col("status.value")).alias("status"),
        display.short_list(F.col("inventors.value")).alias("inventors"))


# --- declared extras ----------------------------------------------------------

def _override_log(spark: SparkSession, sf_dir: str, master: DataFrame) -> DataFrame:
    """Every event as the correction of one record of the master, of either source."""
    numbered = written(master.select("id", "seq"), "numbered")
    n = numbered.agg(F.count("*")).scalar()
    numbered = with_dense_number(numbered, "seq", "no").select("id", "no")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    field = F.get(F.array(*[F.lit(f) for f in overrides.OVERRIDE_FIELDS]), (F.col("event_id") % 6).cast("int"))
    value = F.when(field.isin("assignee_confirmed", "exclude"), F.when(F.col("event_id") % 4 < 2, "true").otherwise("false"))
    hit = events.withColumn("hit", F.pmod(F.col("event_id") * OVERRIDE_STEP, n) + 1)
    return hit.join(numbered, F.col("hit") == F.col("no")).select(
        "id", field.alias("field"), F.coalesce(value, F.concat("event_type", F.lit(" "), F.col("user_id"))).alias("value"),
        F.lit("checked").alias("reason"), F.lit("reviewer").alias("applied_by"),
        F.col("ts").cast("timestamp").alias("applied_at"), "event_id")


def override_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = mastered(spark, sf_dir).master
    m = overrides.apply_overrides(master, _override_log(spark, sf_dir, master), tie="event_id")
    return m.select(
        "id", F.col("status.value").alias("status"), F.col("status.source").alias("status_source"),
        F.col("product_line.value").alias("product_line"), F.col("product_line.was_overridden").alias("line_overridden"),
        F.col("notes.value").alias("notes"), joined("technology_cluster.value").alias("clusters"),
        F.col("assignee.is_confirmed_owner").alias("confirmed"), F.col("assignee.needs_review").alias("review"))


SNAPSHOT_FIELDS = ("status", "product_line", "notes")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole master before and after its corrections."""
    def fields(master: DataFrame) -> DataFrame:
        return master.select("seq", *[F.col(f"{f}.value").alias(f) for f in SNAPSHOT_FIELDS])

    master = mastered(spark, sf_dir).master
    return fields(master), fields(overrides.apply_overrides(master, _override_log(spark, sf_dir, master), tie="event_id"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In both directions, so that records are removed in one and added in the other."""
    old, new = _snapshots(spark, sf_dir)
    return snapshots.snapshot_diff(old, new, "seq", SNAPSHOT_FIELDS).withColumn("direction", F.lit("to corrected")).unionByName(
        snapshots.snapshot_diff(new, old, "seq", SNAPSHOT_FIELDS).withColumn("direction", F.lit("from corrected")))


def keep_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected records that got an error event count as failed, excluded ones as lost."""
    old, new = _snapshots(spark, sf_dir)
    return snapshots.keep_good(old, new, "seq", SNAPSHOT_FIELDS, F.col("status").startswith("error"))


# --- landing, publishing and reading back -------------------------------------

_published: dict[tuple[str, str], Published] = {}


def published(spark: SparkSession, sf_dir: str) -> Published:
    """One whole refresh, published once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _published:
        _published[key] = refresh(spark, curated_rows(spark, sf_dir), bulk_rows(spark, sf_dir), _folder(spark, "published"))
    return _published[key]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/masterloom/{name}-{uuid.uuid4().hex}"


def landed_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk rows written as CSV files, with quotes and line breaks in a column, and landed."""
    broken = F.concat("main_text", F.lit('\nsays "so", twice\n'))
    cells = bulk_rows(spark, sf_dir).withColumn("main_text", broken)
    # A quoted file is read by one task, so the files grow in number, not in size.
    files = cells.repartitionByRange(max(4, -(-cells.count() // FILE_ROWS)), "row_index").sortWithinPartitions("row_index").select(
        *[F.col(name).alias(header) for header, name in BULK_HEADERS.items()])
    folder = _folder(spark, "csv")
    files.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(folder)
    return read_bulk(spark, folder)


def published_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).master().select(
        "seq", "id", "normalized_number", "country", F.col("title.value").alias("title"),
        F.col("status.value").alias("status"), "family_id", joined("data_quality_flags").alias("flags"))


def published_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a published version with the corrections logged beside it."""
    out = published(spark, sf_dir)
    if out.overrides().isEmpty():
        # The published master has the ids and order of a build: none is run beside it.
        log = _override_log(spark, sf_dir, out.master()).withColumn("applied_by", F.format_string("reviewer %012d", "event_id"))
        log.select(out.overrides().columns).write.mode("append").parquet(out.path("overrides"))
    return published_rows(out, tie="applied_by").select(
        "seq", "id", "title", "status", "product_line", "is_confirmed_owner", "family_id")


def kept_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh that could not land the bulk source: its last good rows serve again."""
    out = published(spark, sf_dir)
    again = refresh(spark, curated_rows(spark, sf_dir), None, out.folder, errors={fv.BULK: "not landed"})
    return again.master().select(
        "seq", "id", "normalized_number", F.col("title.value").alias("title"), F.col("abstract.value").alias("abstract"),
        F.col("claims_text.value").alias("claims_text"), "family_id", F.col("stale_since").isNotNull().alias("stale"))


def published_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomies as seeded, each value with its count."""
    lines, models = published(spark, sf_dir).taxonomy()
    return lines.select(F.lit("product_line").alias("field"), "name", "count").unionByName(
        models.select(F.lit("model").alias("field"), "name", "count"))


def overview_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview of a published version, from its cells."""
    return published_overview(published(spark, sf_dir)).select("metric", "name", "n")


def facets_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published_facets(published(spark, sf_dir))


def published_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = published(spark, sf_dir)
    sizes = out.read("member_lists").groupBy("family_id").agg(F.sum(F.size("members")).alias("members"))
    return out.families().select("family_id", "member_count").join(sizes, "family_id")


def refresh_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).refresh_log().select(
        "merge.total_records", "merge.matched", "merge.families", F.col("curated.total_rows").alias("curated_rows"),
        F.col("bulk.total_rows").alias("bulk_rows"), "bulk.unique_normalized",
        F.element_at("exceptions_summary", "unknown_status").alias("unknown_status"),
        F.element_at("exceptions_summary", "oversized_families").alias("oversized"), F.size("errors").alias("errors"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "export")
    export_csv(view.sorted_rows(_rows(spark, sf_dir), "title", descending=False), folder)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folder = _rows(spark, sf_dir), _folder(spark, "json")
    export_json(rows, folder)
    return _shown_rows(read_json(spark, folder, rows))


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the refreshes of one source."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("source "), F.col("user_id").cast("string")).alias("source"), F.col("ts").alias("refreshed_at"))
    return snapshots.freshness(log, F.lit(FRESH_AS_OF).cast("date")).withColumn(
        "last_refresh", F.date_format("last_refresh", "yyyy-MM-dd"))


def expiry_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    expires, as_of = F.col("expiration_date.value"), F.lit(AS_OF).cast("date")
    return mastered(spark, sf_dir).master.select(
        "id", snapshots.expiry_band(expires, as_of).alias("band"),
        snapshots.remaining_days(expires, as_of).cast("long").alias("days"))


def split_product_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = display.split_line(F.col("product_line.value"))
    return mastered(spark, sf_dir).master.where("product_line.value IS NOT NULL").groupBy(
        line["primary"].alias("primary_line"), joined(line["secondary"]).alias("secondary_lines")).agg(F.count("*").alias("n"))


def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records are in both sources, and how many in only one."""
    return mastered(spark, sf_dir).master.groupBy(
        has_source(fv.CURATED).alias("in_curated"), has_source(fv.BULK).alias("in_bulk")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        entity_overlap, curated_records, bulk_records, normalize_number, normalize_status, normalize_owner, owner_by_table, status_by_table, raw_payload,
        dedupe_absorb, dedupe_first, bulk_only, merge_master, merge_stats,
        families, family_members, family_member_lists, member_chunks, oversized_families, siblings_of_parents,
        similar_title_links, families_by_similarity, record_families, record_lookup, family_coverage, exceptions_long, exception_summary, exception_preview, alert_count, alert_records, format_duplicates,
        curated_summary, bulk_summary, top_countries, merge_shape, taxonomy_lines, taxonomy_models, overview_all, overview_top_lines,
        table_rows, facets, view_page, view_page_deep, filtered_by_date_and_type, page_count, export_rows, search_matches, search_long, search_view,
        display_fields, override_apply, snapshot_diff, keep_good, landed_bulk, published_master, published_members, published_view, published_taxonomy,
        kept_source, refresh_log, overview_kept, facets_kept,
        csv_round_trip, json_round_trip, freshness, expiry_bands, split_product_lines,
    )
}
