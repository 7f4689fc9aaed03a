"""Manual corrections: the latest entry per record and field wins at display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

OVERRIDE_FIELDS = ("status", "product_line", "technology_cluster", "assignee_confirmed", "exclude", "notes")
OVERRIDE_SCHEMA = (
    "id string, field string, value string, reason string, applied_by string, applied_at timestamp")


def latest_overrides(log: DataFrame, tie: str | None = None) -> DataFrame:
    """One row per record, one column per field, from an append-only log.

    One shuffle, pre-aggregated. ``tie`` orders entries of the same instant.
    """
    order = F.struct("applied_at", *([tie] if tie else []))
    return log.groupBy("id").agg(*[
        F.max_by("value", F.when(F.col("field") == field, order)).alias(field) for field in OVERRIDE_FIELDS])


def _true(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("true", "1", "yes"), F.lit(False))


def apply_overrides(master: DataFrame, log: DataFrame, tie: str | None = None) -> DataFrame:
    """Master with the corrections applied. Excluded records are hidden."""
    latest = latest_overrides(log, tie).select("id", *[F.col(f).alias("_o_" + f) for f in OVERRIDE_FIELDS])
    joined = master.join(latest, "id", "left").where(~_true(F.col("_o_exclude")))

    def corrected(field: str, value: Column) -> Column:
        manual = F.struct(value.alias("value"), F.lit(fv.MANUAL).alias("source"), F.lit(True).alias("was_overridden"))
        return F.when(F.col("_o_" + field).isNotNull(), manual).otherwise(F.col(field))

    status = F.col("_o_status")
    sure = F.col("_o_assignee_confirmed").isNotNull()
    clusters = F.filter(F.transform(F.split("_o_technology_cluster", ","), lambda t: F.trim(t)), lambda t: t != "")
    return joined.withColumns({
        "product_line": corrected("product_line", F.col("_o_product_line")),
        "notes": corrected("notes", F.col("_o_notes")),
        "technology_cluster": corrected("technology_cluster", clusters),
        "status": F.when(status.isNotNull(), F.col("status")
                         .withField("value", status)
                         .withField("sub_tag", F.lit(None).cast("string"))
                         .withField("source", F.lit(fv.MANUAL))
                         .withField("override", status)).otherwise(F.col("status")),
        "assignee": F.when(sure, F.col("assignee")
                           .withField("is_confirmed_owner", _true(F.col("_o_assignee_confirmed")))
                           .withField("needs_review", F.lit(False))
                           .withField("source", F.lit(fv.MANUAL))).otherwise(F.col("assignee")),
    }).drop(*["_o_" + f for f in OVERRIDE_FIELDS])
