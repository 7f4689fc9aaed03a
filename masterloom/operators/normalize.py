"""Raw source rows to normalised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.identifiers import synthetic_number, with_number
from ..functions.rules import OwnerRules, StatusRules, with_owner, with_status
from ..functions.text import split_names, with_clean
from ..sources.schemas import BULK_HEADERS, CURATED_HEADERS


def flags(**tests: Column) -> Column:
    """Names of the tests that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def normalize_curated(df: DataFrame, status_rules: StatusRules = fv.STATUS_RULES,
                      exact_unicode: bool = True) -> DataFrame:
    """Normalise curated rows. Rows that name nothing at all are dropped;
    ``row_index`` still counts them."""
    naming = ("country", "ip_status", "title", "number")
    dates = ("filing_date", "issue_date", "expiration_date")
    texts = [name for name in CURATED_HEADERS.values() if name not in dates]
    raw = with_clean(df, texts).where(F.coalesce(*naming).isNotNull())
    numbered = with_number(raw, F.col("number"), F.col("country"), "n_", exact_unicode)
    # Dates follow behind the number rules, in a generated method of their own:
    # one method for all would be too large for the JVM to compile.
    numbered = with_clean(numbered, [], dates)

    country = F.coalesce("country", "n_country")
    foreign = country != fv.HOME_COUNTRY
    unkeyed = foreign & F.col("number").isNotNull() & F.col("n_normalized_number").isNull()
    keyed = numbered.withColumns({
        "_country": country,
        "_unkeyed": F.coalesce(unkeyed, F.lit(False)),
        "_key": F.when(unkeyed, synthetic_number(country, F.col("number"))).otherwise(F.col("n_normalized_number")),
    })
    known = with_status(keyed, "_status", F.col("ip_status"), F.col("n_is_placeholder"), status_rules)
    value = F.col("_status.value")
    return known.select(
        F.col("row_index").cast("long").alias("row_index"),
        F.when(F.col("_country") == fv.HOME_COUNTRY, "us").otherwise("foreign").alias("section"),
        F.struct(*CURATED_HEADERS.values()).alias("raw"),
        F.col("number").alias("raw_number"),
        F.col("_key").alias("normalized_number"),
        F.col("_country").alias("country"),
        F.when(F.col("_unkeyed"), "foreign").otherwise(F.col("n_patent_type")).alias("patent_type"),
        F.col("n_is_placeholder").alias("is_placeholder"),
        F.col("_status").alias("status"),
        "title",
        "filing_date",
        F.col("issue_date").alias("grant_date"),
        "expiration_date",
        "model",
        "product_line",
        F.col("link").alias("google_patents_link"),
        flags(
            placeholder_number=F.col("n_is_placeholder"),
            unknown_status=value == "unknown",
            missing_filing_date=F.col("filing_date").isNull(),
            missing_expiration_date=F.col("expiration_date").isNull() & value.isin("active", "pending"),
        ).alias("data_quality_flags"),
    )


def normalize_bulk(df: DataFrame, status_rules: StatusRules = fv.STATUS_RULES,
                   owner_rules: OwnerRules = fv.OWNER_RULES, exact_unicode: bool = True) -> DataFrame:
    """Normalise bulk rows. Rows without a number are dropped."""
    dates = ("filing_date", "granted_date")
    ruled = ("number", "current_assignee", "status")
    raw = with_clean(df, ruled).where(F.col("number").isNotNull())
    owned = with_owner(raw, "assignee", F.col("current_assignee"), owner_rules)
    numbered = with_number(owned, F.col("number"), prefix="n_", exact_unicode=exact_unicode)
    rest = [name for name in BULK_HEADERS.values() if name not in (*ruled, *dates)]
    numbered = with_clean(numbered, rest, dates)
    known = with_status(numbered, "_status", F.col("status"), F.col("n_is_placeholder"), status_rules)
    return known.select(
        F.col("row_index").cast("long").alias("row_index"),
        F.struct(*BULK_HEADERS.values()).alias("raw"),
        F.col("number").alias("raw_number"),
        F.col("n_normalized_number").alias("normalized_number"),
        F.col("n_country").alias("country"),
        F.col("n_patent_type").alias("patent_type"),
        F.col("n_is_placeholder").alias("is_placeholder"),
        F.col("_status").alias("status"),
        "assignee",
        "title",
        "abstract",
        F.col("claims").alias("claims_text"),
        "filing_date",
        F.col("granted_date").alias("grant_date"),
        split_names(F.col("inventors")).alias("inventors"),
        flags(
            unparseable_number=F.col("n_normalized_number").isNull(),
            assignee_needs_review=F.col("assignee.needs_review"),
            unknown_status=F.col("_status.value") == "unknown",
        ).alias("data_quality_flags"),
    )
