"""Families: a home-country record and the curated foreign records that share
its title.

Everything here works on a narrow table of the master (:func:`family_input`),
one row per record. Families can be huge when a title is generic, so the
members are rows of a table, never one list per family, and each join that a
large family could overload is sliced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import title_key
from ..session import written
from .merge import has_source
from .numbering import BLOCK_BITS, with_dense_number
from .similar_titles import best_similar
from .skew import SLICE_ROWS, sliced_join

ORPHAN_FLAG = "missing_us_parent"
SIMILAR_FLAG = "similar_title_parent"
MEMBER_FIELDS = ("id", "normalized_number", "country", "status", "filing_date", "grant_date")


@dataclass
class Families:
    """``assignments``: one row per record (seq, family_no, is_parent,
    is_orphan, by_similarity, family_size); ``families``: one row per family."""

    assignments: DataFrame
    families: DataFrame


def family_id(number: Column) -> Column:
    return F.format_string(fv.FAMILY_ID_FORMAT, number)


def family_input(master: DataFrame) -> DataFrame:
    """The columns of the master that family building reads."""
    return master.select(
        "seq", "id", "normalized_number", "country", F.col("title.value").alias("title"),
        title_key(F.col("title.value")).alias("title_key"), has_source(fv.CURATED).alias("has_curated"))


def title_claims(founders: DataFrame) -> DataFrame:
    """(title_key, family_no): the first family to claim each title. Numbers follow
    emission order, so that is the smallest."""
    return founders.where(F.col("title_key").isNotNull()).groupBy("title_key").agg(F.min("family_no").alias("family_no"))


def _linked_by_similarity(linked: DataFrame, claims: DataFrame, percent: int, slice_rows: int) -> DataFrame:
    """Give records that found no equal title the family of the most similar one."""
    open_titles = linked.where("family_no IS NULL AND title_key IS NOT NULL").select(F.col("title_key").alias("title"))
    best = written(best_similar(open_titles, claims.withColumnRenamed("title_key", "title"), percent), "similar")
    best = best.select(F.col("title").alias("title_key"), F.col("family_no").alias("_similar_no"))
    # A title is looked up for open records only: others have their family.
    found = sliced_join(linked, best, "title_key", "seq", slice_rows=slice_rows)
    return found.select("seq", "country", F.coalesce("family_no", "_similar_no").alias("family_no"),
                        (F.col("family_no").isNull() & F.col("_similar_no").isNotNull()).alias("by_similarity"))


def build_families(records: DataFrame, block_bits: int = BLOCK_BITS, slice_rows: int = SLICE_ROWS,
                   similar_percent: int | None = None) -> Families:
    """Assign every record of a *written* :func:`family_input` to a family.

    Home-country and unknown-country records found families, numbered in
    emission order. A curated foreign record joins the first family with its
    title key; with ``similar_percent`` one without such a family joins that of
    the most similar title, if it is that similar. Every other foreign record founds
    an orphan family; those are numbered after the others.
    """
    at_home = F.col("country").isNull() | (F.col("country") == fv.HOME_COUNTRY)
    founders = with_dense_number(records.where(at_home).select("seq", "title_key", "country"), "seq", "family_no", block_bits)
    founders = written(founders, "founders")
    by_title = title_claims(founders)

    foreign = records.where(~at_home)
    searching = F.when(F.col("has_curated"), F.col("title_key"))
    foreign = foreign.select("seq", "country", searching.alias("title_key"))
    linked = written(sliced_join(foreign, by_title, "title_key", "seq", slice_rows=slice_rows)
                     .select("seq", "country", "title_key", "family_no"), "linked")
    if similar_percent is not None:
        linked = written(_linked_by_similarity(linked, by_title, similar_percent, slice_rows), "linked")
    else:
        linked = linked.select("seq", "country", "family_no", F.lit(False).alias("by_similarity"))

    orphans = with_dense_number(linked.where("family_no IS NULL").select("seq", "country"), "seq", "_no", block_bits)
    last_founder = founders.agg(F.count("*")).scalar()
    orphans = orphans.select("seq", "country", (F.col("_no") + last_founder).alias("family_no"))

    def marked(df: DataFrame, is_parent: bool, is_orphan: bool) -> DataFrame:
        similar = F.lit(False) if is_parent else F.col("by_similarity")
        return df.select("seq", "country", "family_no", F.lit(is_parent).alias("is_parent"),
                         F.lit(is_orphan).alias("is_orphan"), similar.alias("by_similarity"))

    placed = written(
        marked(founders, True, False)
        .unionByName(marked(linked.where("family_no IS NOT NULL"), False, False))
        .unionByName(marked(orphans, True, True)),
        "placed")

    # Founder first, then emission order.
    place = F.when(F.col("is_parent"), F.lit(-1).cast("long")).otherwise(F.col("seq"))
    per_country = placed.groupBy("family_no", "country").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    listed = F.array_sort(F.collect_list(F.when(F.col("country").isNotNull(), F.struct("place", "country"))))
    sizes = per_country.groupBy("family_no").agg(
        F.sum("n").alias("member_count"),
        F.transform(listed, lambda item: item["country"]).alias("countries"))

    parents = placed.where("is_parent").select("seq", "family_no", "is_orphan").join(
        records.select("seq", "id", "normalized_number", "title"), "seq")
    families = parents.join(sizes, "family_no").select(
        "family_no",
        family_id(F.col("family_no")).alias("family_id"),
        F.col("id").alias("parent_id"),
        F.col("normalized_number").alias("parent_number"),
        F.col("title").alias("parent_title"),
        "member_count",
        "countries",
        F.col("is_orphan").alias("orphan"),
        (F.col("member_count") > fv.OVERSIZED_ABOVE).alias("oversized"),
    )
    grown = written(families, "families")
    sized = sliced_join(
        placed, grown.select("family_no", F.col("member_count").alias("family_size")), "family_no", "seq", slice_rows=slice_rows)
    return Families(sized.select("seq", "family_no", "is_parent", "is_orphan", "by_similarity", "family_size"), grown)


def with_family(master: DataFrame, assignments: DataFrame) -> DataFrame:
    """Set the family of every record, flag orphans and records whose parent only has a
    similar title. One to one on ``seq``."""
    flagged = F.col("data_quality_flags")
    for test, flag in (("is_orphan", ORPHAN_FLAG), ("by_similarity", SIMILAR_FLAG)):
        flagged = F.when(F.col(test), F.array_union("data_quality_flags", F.array(F.lit(flag)))).otherwise(flagged)
    return (
        master.join(assignments, "seq")
        .withColumn("family_id", family_id(F.col("family_no")))
        .withColumn("data_quality_flags", flagged)
        .drop("by_similarity")
    )


def family_members(master: DataFrame) -> DataFrame:
    """One row per member of each family, with its place in the member order."""
    return master.select(
        "family_no",
        "family_id",
        F.when(F.col("is_parent"), F.lit(-1).cast("long")).otherwise(F.col("seq")).alias("place"),
        "id",
        "normalized_number",
        "country",
        F.col("status.value").alias("status"),
        F.col("filing_date.value").alias("filing_date"),
        F.col("grant_date.value").alias("grant_date"),
        "family_size",
        "seq",
    )


def _chunked(members: DataFrame, chunk_bits: int, *fields: str) -> DataFrame:
    """Members of each family in member order, as lists of bounded size.

    A chunk covers one range of ``2^chunk_bits`` emission numbers, so no list
    outgrows that. A family within one range is a single row besides its parent's.
    """
    chunk = F.when(F.col("place") < 0, F.lit(-1).cast("long")).otherwise(F.shiftright("place", chunk_bits))
    return members.groupBy("family_no", "family_id", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("place", *fields))).alias("members"))


def member_lists(master: DataFrame, chunk_bits: int = 13) -> DataFrame:
    """All members of every family, once per family: (family_id, chunk, members).

    This is what a record's view shows of its family, for families of any size;
    a list per record would repeat a family of n members n times.
    """
    chunks = _chunked(family_members(master), chunk_bits, *MEMBER_FIELDS)
    brief = F.transform("members", lambda m: F.struct(*[m[f].alias(f) for f in MEMBER_FIELDS]))
    return chunks.select("family_no", "family_id", "chunk", brief.alias("members"))


def member_chunks(master: DataFrame, chunk_bits: int = 13) -> DataFrame:
    """``member_ids`` per family for export, in chunks by member order."""
    return _chunked(family_members(master), chunk_bits, "id").select(
        "family_no", "family_id", "chunk", F.transform("members", lambda m: m["id"]).alias("member_ids"))


def siblings(master: DataFrame, ids: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Other members of the families of the records in ``ids`` (column ``id``).

    Meant for the records a user looks at: the result has a row per asked record
    and other member. A record is told from the others by ``seq``, as ids made from
    ordinals may collide across the sources.
    """
    asked = master.join(ids.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("of_id"), F.col("seq").alias("of_seq"), "family_no")
    found = sliced_join(family_members(master), asked, "family_no", "id", "inner", slice_rows)
    return found.where(F.col("seq") != F.col("of_seq")).drop("of_seq")


def id_collisions(master: DataFrame) -> DataFrame:
    """Ids that several records share, with their number."""
    return master.groupBy("id").agg(F.count("*").alias("records")).where("records > 1")


def with_family_header(records: DataFrame, families: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Append the struct ``family``, the header of each record's family."""
    header = families.select("family_id", F.struct(
        "parent_id", "parent_number", "parent_title", "member_count", "countries", "orphan", "oversized").alias("family"))
    return sliced_join(records, header, "family_id", "id", slice_rows=slice_rows)


def family_coverage(master: DataFrame) -> DataFrame:
    """Members per family and country."""
    return master.groupBy("family_id", "country").agg(F.count("*").alias("members"))
