"""The master: curated and bulk records joined, each field with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.identifiers import record_seed, stable_id
from ..functions.text import no_strings
from .dedupe import KEY, NUMBER, TEXTS, absorb_duplicates, first_per_key, number_of, with_key

CURATED_FIELDS = (
    "row_index", "raw_number", "country", "patent_type", "is_placeholder", "status", "title",
    "filing_date", "grant_date", "expiration_date", "model", "product_line",
    "google_patents_link", "data_quality_flags",
)
BULK_FIELDS = (
    "row_index", "raw_number", "country", "patent_type", "is_placeholder", "status", "assignee",
    "title", "abstract", "claims_text", "filing_date", "grant_date", "inventors", "data_quality_flags",
)

# Emission order in one number: the bucket in the high bits, the row below it.
BUCKET_BITS = 60


def attributed(value: Column, source: Column | str) -> Column:
    return F.struct(
        value.alias("value"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        F.lit(False).alias("was_overridden"),
    )


def pick(primary: Column, fallback: Column, primary_source: str, fallback_source: str) -> Column:
    """Primary value unless null or empty; else the fallback, labelled as such
    even when it is null too."""
    usable = primary.isNotNull() & (primary.cast("string") != "")
    return attributed(F.when(usable, primary).otherwise(fallback),
                      F.when(usable, F.lit(primary_source)).otherwise(F.lit(fallback_source)))


def _side(df: DataFrame, mark: str, fields: tuple[str, ...]) -> DataFrame:
    have = set(df.columns)
    return df.select(KEY, *[F.col(name).alias(mark + name) for name in fields if name in have])


def join_sources(curated: DataFrame, bulk: DataFrame) -> DataFrame:
    """Full outer join of the two deduplicated sources on the number.

    Columns are led by ``c_`` and ``b_``. Each side is shuffled once, by the
    key its deduplication groups on; the join reuses that partitioning.
    """
    c = _side(first_per_key(with_key(curated, "c")), "c_", CURATED_FIELDS)
    b = _side(absorb_duplicates(with_key(bulk, "b")), "b_", BULK_FIELDS)
    return c.join(b, KEY, "full_outer").withColumn(NUMBER, number_of(F.col(KEY)))


def bulk_remainder(curated: DataFrame, bulk: DataFrame) -> DataFrame:
    """Bulk records whose number no curated record has."""
    numbers = first_per_key(with_key(curated, "c")).select(KEY)
    return absorb_duplicates(with_key(bulk, "b")).join(numbers, KEY, "left_anti")


def _status(curated: Column, bulk: Column, run_at: Column) -> Column:
    """Curated unless unknown, then bulk, then unknown."""
    use_c = F.col("c_status.value") != "unknown"
    use_c = F.coalesce(use_c, F.lit(False))
    has_b = F.col("b_row_index").isNotNull()

    def chosen(field: str, neither: Column) -> Column:
        return F.when(use_c, curated[field]).when(has_b, bulk[field]).otherwise(neither)

    return F.struct(
        chosen("value", F.lit("unknown")).alias("value"),
        chosen("sub_tag", F.lit(None).cast("string")).alias("sub_tag"),
        F.when(~use_c & has_b, F.lit(fv.BULK)).otherwise(F.lit(fv.CURATED)).alias("source"),
        curated["raw"].alias("raw_curated"),
        bulk["raw"].alias("raw_bulk"),
        run_at.alias("last_refreshed"),
        F.lit(None).cast("string").alias("override"),
    )


def _assignee(has_c: Column, has_b: Column, house: str) -> Column:
    owner = F.col("b_assignee")
    default = F.when(has_c, F.lit(house))
    return F.struct(
        owner["raw"].alias("raw"),
        F.coalesce(owner["normalized"], default).alias("normalized"),
        (has_c | F.coalesce(owner["is_confirmed_owner"], F.lit(False))).alias("is_confirmed_owner"),
        (~has_c & F.coalesce(owner["needs_review"], F.lit(False))).alias("needs_review"),
        F.when(has_b, F.lit(fv.BULK)).otherwise(F.lit(fv.CURATED)).alias("source"),
    )


def build_records(joined: DataFrame, run_at: Column, house_owner: str = fv.HOUSE_OWNER) -> DataFrame:
    """One attributed record per joined row. ``seq`` is its emission order. Without texts
    a record has its matching key in their place, for :func:`with_texts`."""
    has_c = F.col("c_row_index").isNotNull()
    has_b = F.col("b_row_index").isNotNull()
    number = F.col(NUMBER)
    bucket = (
        F.when(has_c & number.isNotNull(), 0).when(has_c, 1).when(number.isNotNull(), 2).otherwise(3)
    ).cast("long")
    row = F.coalesce("c_row_index", "b_row_index")
    raw_number = F.coalesce("c_raw_number", "b_raw_number")
    country = F.coalesce("c_country", "b_country")
    nothing = F.lit(None).cast("string")

    def either(name: str) -> Column:
        return pick(F.col("c_" + name), F.col("b_" + name), fv.CURATED, fv.BULK)

    def only(column: str, source: str) -> Column:
        return attributed(F.col(column), source)

    return joined.select(
        (F.shiftleft(bucket, BUCKET_BITS) + row).alias("seq"),
        stable_id(record_seed(number, country, raw_number, row)).alias("id"),
        raw_number.alias("raw_number"),
        number.alias("normalized_number"),
        F.coalesce("c_patent_type", "b_patent_type", F.lit("unknown")).alias("patent_type"),
        country.alias("country"),
        (F.coalesce("c_is_placeholder", F.lit(False)) | F.coalesce("b_is_placeholder", F.lit(False))).alias("is_placeholder"),
        either("title").alias("title"),
        *([only("b_" + name, fv.BULK).alias(name) for name in TEXTS] if "b_" + TEXTS[0] in joined.columns else [F.col(KEY)]),
        either("filing_date").alias("filing_date"),
        either("grant_date").alias("grant_date"),
        attributed(F.lit(None).cast("date"), fv.BULK).alias("publication_date"),
        only("c_expiration_date", fv.CURATED).alias("expiration_date"),
        _status(F.col("c_status"), F.col("b_status"), run_at).alias("status"),
        _assignee(has_c, has_b, house_owner).alias("assignee"),
        attributed(F.coalesce("b_inventors", no_strings()), fv.BULK).alias("inventors"),
        only("c_product_line", fv.CURATED).alias("product_line"),
        only("c_model", fv.CURATED).alias("model"),
        attributed(no_strings(), fv.MANUAL).alias("technology_cluster"),
        attributed(no_strings(), fv.API).alias("cpc_codes"),
        only("c_google_patents_link", fv.CURATED).alias("google_patents_url"),
        attributed(nothing, fv.API).alias("forward_citations"),
        attributed(F.lit(""), fv.MANUAL).alias("notes"),
        F.array_union(F.coalesce("c_data_quality_flags", no_strings()),
                      F.coalesce("b_data_quality_flags", no_strings())).alias("data_quality_flags"),
        run_at.alias("last_refreshed"),
        F.array_compact(F.array(F.when(has_c, fv.CURATED), F.when(has_b, fv.BULK))).alias("_sources"),
        F.col("c_row_index").alias("_curated_row_index"),
        F.col("b_row_index").alias("_bulk_row_index"),
    )


def merge_sources(curated: DataFrame, bulk: DataFrame, run_at: Column,
                  house_owner: str = fv.HOUSE_OWNER) -> DataFrame:
    """Normalised curated and bulk rows to the master, families not yet set."""
    return build_records(join_sources(curated, bulk), run_at, house_owner)


def with_texts(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Records built without texts, with those of their key from :func:`folded_texts`."""
    found = records.join(texts, KEY, "left")
    in_place = {KEY: [attributed(F.col(name), fv.BULK).alias(name) for name in TEXTS]}
    return found.select(*[c for name in records.columns for c in in_place.get(name, [F.col(name)])])


def texts_of(master: DataFrame) -> DataFrame:
    """The texts of each matching key, from a master whose bookkeeping is gone: a key is the
    number, or follows from the bulk row that the emission order ends with."""
    bulk_row = (F.col("seq") - F.shiftleft(F.lit(3).cast("long"), BUCKET_BITS)).alias("row_index")
    loose = F.shiftright("seq", BUCKET_BITS) == 3
    keyed = master.where(F.col(NUMBER).isNotNull() | loose).select(NUMBER, bulk_row, *[F.col(f"{t}.value").alias(t) for t in TEXTS])
    return with_key(keyed, "b").select(KEY, *TEXTS).where(F.coalesce(*TEXTS).isNotNull())


def has_source(label: str) -> Column:
    return F.array_contains("_sources", label)


def only_source(label: str) -> Column:
    return has_source(label) & (F.size("_sources") == 1)
