"""Counts over the sources and the master. All are hash aggregates with a
partial step before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.display import decade
from .merge import has_source, only_source

TOP = 10


def curated_summary(curated: DataFrame) -> DataFrame:
    return curated.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("section") == "us").alias("us_rows"),
        F.count_if(F.col("section") == "foreign").alias("foreign_rows"),
        F.count_if("is_placeholder").alias("placeholder_rows"),
        F.count_if(F.col("status.value") == "unknown").alias("unknown_status"),
        F.count_if(F.col("normalized_number").isNull()).alias("missing_numbers"),
        F.sort_array(F.collect_set("country")).alias("countries"),
    )


def bulk_summary(bulk: DataFrame) -> DataFrame:
    """Counts of the bulk rows before duplicates are collapsed.

    Rows are first counted per number, so the distinct count needs no second
    copy of the rows and a frequent number arrives pre-aggregated.
    """
    number = F.col("normalized_number")
    per_number = bulk.groupBy("normalized_number").agg(
        F.count("*").alias("rows"),
        F.count_if("assignee.is_confirmed_owner").alias("confirmed"),
        F.count_if("assignee.needs_review").alias("review"),
        F.count_if(F.col("status.value") == "unknown").alias("unknown"),
    )

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return per_number.agg(
        total(F.col("rows")).alias("total_rows"),
        F.count("normalized_number").alias("unique_normalized"),
        total(F.when(number.isNull(), F.col("rows"))).alias("unparseable_numbers"),
        total(F.col("confirmed")).alias("confirmed_owner"),
        total(F.col("review")).alias("needs_assignee_review"),
        total(F.col("unknown")).alias("unknown_status"),
    )


def counted(df: DataFrame, value: Column, name: str, order: str) -> DataFrame:
    """(name, count, first): rows per value, most frequent first; equal counts
    in order of first appearance by ``order``."""
    return (
        df.groupBy(value.alias(name))
        .agg(F.count("*").alias("count"), F.min(order).alias("first"))
        .orderBy(F.desc("count"), F.asc("first"))
    )


def top_countries(bulk: DataFrame, top: int = TOP) -> DataFrame:
    return counted(bulk, F.coalesce("country", F.lit("UNKNOWN")), "country", "row_index").limit(top)


def taxonomy(master: DataFrame, field: str) -> DataFrame:
    """Observed values of ``product_line`` or ``model`` with their counts."""
    value = F.col(f"{field}.value")
    return counted(master.where(value != ""), value, "name", "seq")


def merge_stats(master: DataFrame) -> DataFrame:
    return master.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.size("_sources") == 2).alias("matched"),
        F.count_if(only_source(fv.CURATED)).alias("curated_only"),
        F.count_if(only_source(fv.BULK)).alias("bulk_only"),
        F.count_if("is_parent").alias("families"),
        F.count_if(F.col("country") == fv.HOME_COUNTRY).alias("home_records"),
        F.count_if(F.col("country") != fv.HOME_COUNTRY).alias("foreign_records"),
        F.count_if("assignee.is_confirmed_owner").alias("confirmed_owner"),
    )


CELL_KEYS = ("status", "product_line", "decade", "country")
CELL_SUMS = ("n", "confirmed", "families", "matched", "curated_only", "bulk_only")


def overview_cells(master: DataFrame) -> DataFrame:
    """Counts per (status, product line, decade, country): what the overview and the choices of
    the filters are summed from. A scan of the master leaves one row per cell and task; a
    refresh keeps the table, so that an overview costs no scan."""
    keys = master.select(
        "seq",
        F.col("status.value").alias("status"),
        F.col("product_line.value").alias("product_line"),
        decade(F.col("filing_date.value")).alias("decade"),
        "country",
        F.col("assignee.is_confirmed_owner").alias("confirmed"),
        "is_parent",
        has_source(fv.CURATED).alias("in_curated"),
        has_source(fv.BULK).alias("in_bulk"),
    )
    both = F.col("in_curated") & F.col("in_bulk")
    return keys.groupBy(*CELL_KEYS).agg(
        F.count("*").alias("n"),
        F.min("seq").alias("first"),
        F.count_if("confirmed").alias("confirmed"),
        F.count_if("is_parent").alias("families"),
        F.count_if(both).alias("matched"),
        F.count_if(F.col("in_curated") & ~F.col("in_bulk")).alias("curated_only"),
        F.count_if(F.col("in_bulk") & ~F.col("in_curated")).alias("bulk_only"),
    )


def overview_counts(master: DataFrame) -> DataFrame:
    """(metric, name, n, first) for every breakdown and total of the overview."""
    return overview_of_cells(overview_cells(master))


def overview_of_cells(cells: DataFrame) -> DataFrame:
    """The same from the cells: the breakdowns are grouping sets of one aggregate over them."""
    keys = cells.select(
        "status",
        F.coalesce("product_line", F.lit("(unmapped)")).alias("product_line"),
        F.coalesce("decade", F.lit("")).alias("decade"),
        F.coalesce("country", F.lit("(unknown)")).alias("place"),
        F.nullif("country", F.lit("")).alias("jurisdiction"),
        "first", *CELL_SUMS)
    sets = keys.groupingSets(
        [[F.col("status")], [F.col("product_line")], [F.col("decade")], [F.col("place")], [F.col("jurisdiction")], []],
        "status", "product_line", "decade", "place", "jurisdiction",
    ).agg(
        F.grouping_id().alias("g"),
        F.min("first").alias("first"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CELL_SUMS],
    )
    # The grouping id has a bit for each key that is *not* grouped on.
    status, line, years, place, jurisdiction, total = 0b01111, 0b10111, 0b11011, 0b11101, 0b11110, 0b11111

    def entry(metric: str, name: Column, n: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), name.alias("name"), n.alias("n"), F.col("first").alias("first"))

    blank = F.lit("")
    one = F.lit(1).cast("long")
    g = F.col("g")
    totals = F.array(*[entry(m, blank, F.col(c)) for m, c in (
        ("total", "n"), ("confirmed_owner", "confirmed"), ("family_count", "families"),
        ("matched", "matched"), ("curated_only", "curated_only"), ("bulk_only", "bulk_only"))])
    entries = (
        F.when(g == status, F.array(entry("by_status", F.col("status"), F.col("n"))))
        .when(g == line, F.array(entry("by_product_line", F.col("product_line"), F.col("n"))))
        .when((g == years) & (F.col("decade") != ""), F.array(entry("by_decade", F.col("decade"), F.col("n"))))
        .when(g == place, F.array(entry("by_country", F.col("place"), F.col("n"))))
        .when((g == jurisdiction) & F.col("jurisdiction").isNotNull(), F.array(entry("jurisdiction", blank, one)))
        .when(g == total, totals)
    )
    listed = sets.select(F.inline(entries))
    # Jurisdictions arrive as one entry each; their sum is the count.
    return listed.groupBy(
        F.when(F.col("metric") == "jurisdiction", "jurisdiction_count").otherwise(F.col("metric")).alias("metric"), "name"
    ).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def overview_breakdown(counts: DataFrame, metric: str, top: int | None = None) -> DataFrame:
    """One breakdown in its display order, optionally only the head of it."""
    rows = counts.where(F.col("metric") == metric)
    rows = rows.orderBy("name") if metric == "by_decade" else rows.orderBy(F.desc("n"), F.asc("first"))
    return rows if top is None else rows.limit(top)


def facets(rows: DataFrame) -> DataFrame:
    """(facet, value): the sorted choices of the product-line and country filters."""
    listed = rows.select(F.explode(F.array(
        F.struct(F.lit("product_line").alias("facet"), F.col("product_line").alias("value")),
        F.struct(F.lit("country").alias("facet"), F.col("country").alias("value")),
    )).alias("f")).select("f.facet", "f.value")
    return listed.where(F.col("value") != "").distinct().orderBy("facet", "value")


def facets_of_cells(cells: DataFrame) -> DataFrame:
    """The same choices from the cells of the overview."""
    return facets(cells)
