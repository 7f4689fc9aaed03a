"""One row per number within each source.

Both operators pre-aggregate before their shuffle, so a number that holds a
large share of all rows leaves each map task as one row. Rows without a number
are never collapsed: each gets a key of its own, which spreads them evenly and
lets them take the same single pass as the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = "normalized_number"
KEY = "_key"
# Columns that are long. The build folds them apart and attaches them last.
TEXTS = ("abstract", "claims_text")

# Leads the key of a row without a number. Numbers never start with a space.
_LOOSE = " "


def with_key(df: DataFrame, side: str) -> DataFrame:
    """Append the matching key. ``side`` keeps unnumbered rows of different
    sources apart."""
    loose = F.concat(F.lit(_LOOSE + side), F.col("row_index").cast("string"))
    return df.withColumn(KEY, F.coalesce(NUMBER, loose))


def number_of(key: Column) -> Column:
    return F.when(~key.startswith(_LOOSE), key)


def first_per_key(df: DataFrame) -> DataFrame:
    """The row with the smallest ``row_index`` of each key.

    Spark limits each group to one row before the shuffle as well as after it
    (WindowGroupLimit), and the columns stay flat, so unused ones are pruned.
    """
    order = Window.partitionBy(KEY).orderBy("row_index")
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def _first(value: str, *, where: Column | None = None) -> Column:
    """Value of the earliest row, among those that satisfy ``where``."""
    order = F.col("row_index") if where is None else F.when(where, F.col("row_index"))
    return F.min_by(F.col(value), order)


def _names_in_order(df: DataFrame) -> DataFrame:
    """All distinct inventors of a key, by first appearance.

    Repeats are removed while they are still spread over the cluster, so the
    list built per key is never larger than the list in the result.
    """
    listed = df.select(KEY, "row_index", F.posexplode(F.array_distinct("inventors")).alias("place", "name"))
    met = listed.groupBy(KEY, "name").agg(
        F.min("row_index").alias("row"), F.min_by("place", "row_index").alias("place"))
    ordered = F.sort_array(F.collect_list(F.struct("row", "place", "name")))
    return met.groupBy(KEY).agg(F.transform(ordered, lambda item: item["name"]).alias("_names"))


def absorb_duplicates(df: DataFrame) -> DataFrame:
    """Fold the bulk rows of one key into its first row.

    The first row decides everything except: the first known status, the first
    confirmed owner and the first value of each gap-filled field win, and new
    inventors of later rows are appended in order. Texts are folded if present.
    """
    kept = ("raw_number", "country", "patent_type", "is_placeholder", "data_quality_flags", "inventors")
    gap_filled = [n for n in ("title", *TEXTS, "filing_date", "grant_date") if n in df.columns]
    known = F.col("status.value") != "unknown"
    confirmed = F.col("assignee.is_confirmed_owner")
    # The first row travels as one value: one ordering, not one per column.
    folded = df.withColumn("_first", F.struct(*kept, "status", "assignee")).groupBy(KEY).agg(
        F.min("row_index").alias("row_index"),
        _first("_first").alias("_first"),
        _first("status", where=known).alias("_known"),
        _first("assignee", where=confirmed).alias("_confirmed"),
        *[_first(name, where=F.col(name).isNotNull()).alias(name) for name in gap_filled],
    ).select(
        KEY, "row_index", *[F.col("_first")[name].alias(name) for name in kept],
        F.coalesce("_known", F.col("_first.status")).alias("status"),
        F.coalesce("_confirmed", F.col("_first.assignee")).alias("assignee"),
        *gap_filled,
    )
    first = F.col("inventors")
    later = F.array_except(F.coalesce("_names", F.array().cast("array<string>")), first)
    named = folded.join(_names_in_order(df), KEY, "left")
    return named.withColumn("inventors", F.concat(first, later)).drop("_names").withColumn(NUMBER, number_of(F.col(KEY)))


def folded_texts(df: DataFrame) -> DataFrame:
    """The first value of each text per key, as :func:`absorb_duplicates` would choose it.

    The one shuffle that moves texts: each map task leaves one row per key.
    """
    some = df.where(F.coalesce(*TEXTS).isNotNull())
    return some.groupBy(KEY).agg(*[_first(name, where=F.col(name).isNotNull()).alias(name) for name in TEXTS])
