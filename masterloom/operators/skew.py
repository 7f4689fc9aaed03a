"""Equi-joins that stay balanced when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 1_000_000


def sliced_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "left",
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Left or inner join on ``key``, which may be hot on the left.

    A key with more than ``slice_rows`` left rows is cut into slices by a hash
    of the column ``spread``, and its right rows are repeated once per slice.
    Only hot keys are listed, so the broadcast list has at most
    ``rows / slice_rows`` entries; all other rows stay in slice 0.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > slice_rows).select(
        key, F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices"))
    # A row without a key matches nothing; its hash keeps such rows spread out.
    slices = F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(F.coalesce("_slices", F.lit(1)))
    sliced = left.join(F.broadcast(hot), key, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(spread), slices).cast("int")).drop("_slices")
    last = F.coalesce("_slices", F.lit(1)) - 1
    repeated = right.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), last))).drop("_slices")
    return sliced.join(repeated, [key, "_slice"], how).drop("_slice")


# Rows of one key that meet in one task of a tiled join, on either side.
TILE_ROWS = 20_000


def tiled_join(left: DataFrame, right: DataFrame, key: str, left_spread: str, right_spread: str,
               tile_rows: int = TILE_ROWS) -> DataFrame:
    """Inner join of two *written* tables on ``key``, which may be hot on both sides.

    A key with more than ``tile_rows`` rows on a side is cut on that side by a hash of its
    ``spread`` column; every part meets every part of the other side, each pair of parts in a
    task of its own. Only hot keys are listed, so the broadcast list has at most
    ``rows / tile_rows`` entries; all others meet once.
    """
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) > tile_rows)

    hot = counts(left, "_nl").join(counts(right, "_nr"), key, "full_outer").select(
        key, *[F.ceil(F.coalesce(n, F.lit(1)) / tile_rows).cast("int").alias(parts) for n, parts in (("_nl", "_pl"), ("_nr", "_pr"))])

    def cut(df: DataFrame, spread: str, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        parts = df.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")
        last = F.coalesce(other_parts, F.lit(1)) - 1
        return parts.withColumns({
            own: F.pmod(F.xxhash64(spread), F.coalesce(own_parts, F.lit(1))).cast("int"),
            other: F.explode(F.sequence(F.lit(0), last))}).drop("_pl", "_pr")

    return cut(left, left_spread, "_l", "_pl", "_r", "_pr").join(
        cut(right, right_spread, "_r", "_pr", "_l", "_pl"), [key, "_l", "_r"]).drop("_l", "_r")
