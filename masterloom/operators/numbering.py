"""Dense numbering 1, 2, 3, ... in the order of a unique long, without a
global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 16


def with_dense_number(df: DataFrame, seq: str, name: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Append the rank of each row by ``seq``, a unique non-negative long.

    ``seq`` is cut into blocks of ``2^block_bits`` values and groups of that
    many blocks. Rows are ranked inside their block, blocks are offset inside
    their group, groups are offset by the groups before them. No task sees
    more than ``2^block_bits`` rows or blocks; the ordered list of groups, the
    only part kept in one task, has one entry per ``2^(2 * block_bits)``
    values. ``df`` is read twice, so it should be a written table.
    """
    block = F.shiftright(F.col(seq), block_bits)
    blocks = (
        df.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
        .withColumn("_group", F.shiftright(F.col("_block"), block_bits))
    )
    groups = blocks.groupBy("_group").agg(F.sum("_n").alias("_n"))

    def before(*partition: str, order: str):
        window = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
        return F.coalesce(
            F.sum("_n").over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    group_starts = groups.select("_group", before(order="_group").alias("_group_start"))
    block_starts = (
        blocks.select("_group", "_block", before("_group", order="_block").alias("_block_start"))
        .join(group_starts, "_group")
        .select("_block", (F.col("_group_start") + F.col("_block_start")).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(seq))
    ranked = df.withColumn("_block", block).withColumn("_inside", inside)
    return (
        ranked.join(block_starts, "_block")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_block", "_inside", "_start")
    )
