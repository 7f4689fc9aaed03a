"""Comparing runs: differences, surviving a failed refresh, freshness, expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change, field, before, after) between two snapshots with unique keys.

    Added and removed records are one row with a null field; a changed record
    is one row per changed field.
    """
    before = old.select(key, F.lit(True).alias("_old"), *[F.col(f).alias("_o_" + f) for f in fields])
    after = new.select(key, F.lit(True).alias("_new"), *[F.col(f).alias("_n_" + f) for f in fields])

    def change(kind: str, field: str | None = None) -> Column:
        text = lambda side: F.col(f"{side}{field}").cast("string") if field else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("change"), F.lit(field).cast("string").alias("field"),
                        text("_o_").alias("before"), text("_n_").alias("after"))

    fields_changed = F.array_compact(F.array(*[
        F.when(~F.col("_o_" + f).eqNullSafe(F.col("_n_" + f)), change("changed", f)) for f in fields]))
    changes = (
        F.when(F.col("_old").isNull(), F.array(change("added")))
        .when(F.col("_new").isNull(), F.array(change("removed")))
        .otherwise(fields_changed)
    )
    return before.join(after, key, "full_outer").select(key, F.inline(changes))


def keep_good(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], failed: Column) -> DataFrame:
    """Values of a refresh, except that records it failed on or lost keep what
    was known before and are marked stale."""
    before = old.select(key, F.lit(True).alias("_old"), *[F.col(f).alias("_o_" + f) for f in fields])
    after = new.withColumn("_failed", F.coalesce(failed, F.lit(False))).select(
        key, "_failed", *[F.col(f).alias("_n_" + f) for f in fields])
    stale = F.coalesce("_failed", F.lit(True))
    keep = stale & F.col("_old").isNotNull()
    return before.join(after, key, "full_outer").select(
        key, *[F.when(keep, F.col("_o_" + f)).otherwise(F.col("_n_" + f)).alias(f) for f in fields], stale.alias("stale"))


def freshness(log: DataFrame, as_of: Column, sources: Sequence[str] = (),
              stale_after: int = fv.STALE_AFTER_DAYS) -> DataFrame:
    """Last refresh per source of a log (source, refreshed_at), and whether it
    is too old. Sources named but never refreshed are listed with nulls."""
    last = log.groupBy("source").agg(F.max("refreshed_at").alias("last_refresh"))
    if sources:
        named = log.sparkSession.createDataFrame([(s,) for s in sources], "source string")
        last = last.join(named, "source", "full_outer")
    return last.withColumn("stale", F.datediff(as_of, F.col("last_refresh")) > stale_after)


def expiry_band(expires: Column, as_of: Column) -> Column:
    """``expired``, ``12_months``, ``24_months`` or ``later``; null if unknown."""
    return (
        F.when(expires < as_of, "expired")
        .when(expires <= F.add_months(as_of, 12), "12_months")
        .when(expires <= F.add_months(as_of, 24), "24_months")
        .when(expires.isNotNull(), "later")
    )


def remaining_days(expires: Column, as_of: Column) -> Column:
    """Days left, 0 once expired; null if the date is unknown."""
    return F.when(expires.isNotNull(), F.greatest(F.datediff(expires, as_of), F.lit(0)))
