"""Landing delimited files: every cell as text, plus the row's ordinal.

Duplicate handling and family numbers follow the order of the rows in the
files, so landing gives each row its ordinal, ``row_index``, once; everything
later reads the landed table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.skew import sliced_join
from ..session import written
from .schemas import BULK_HEADERS, CURATED_HEADERS


# Runs of rows whose offsets are broadcast: some 10 MB.
BROADCAST_RUNS = 100_000


def trimmed_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def by_header(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Pick the known columns by header; one the file lacks is null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{header}`") if header in have else F.lit(None)).cast("string").alias(name)
        for header, name in headers.items()], *[c for c in df.columns if c.startswith("_land_")])


def with_row_index(df: DataFrame) -> DataFrame:
    """Replace the ``_land_`` marks by ``row_index``, 0, 1, 2, ... in file order.

    A file, or the block of a file one task reads, is a run of rows with
    consecutive ids. The offsets of the runs come from one row per run, and a
    row's ordinal is its run's offset plus its place in the run.
    """
    marked = df.withColumn("_land_run", F.concat_ws("#", "_land_file", F.lpad(F.col("_land_block").cast("string"), 19, "0")))
    runs = marked.groupBy("_land_run").agg(F.count("*").alias("n"), F.min("_land_id").alias("first"))
    # In one task: one row per file, or per block of a split file.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_land_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(runs.select(
        "_land_run", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_land_shift")), "landing-runs")
    # One row per file or block: few enough to go to every task, the texts then
    # stay where they are; else the rows are joined by run.
    small = starts.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    return (
        (marked.join(F.broadcast(starts), "_land_run", "left") if small
         else sliced_join(marked, starts, "_land_run", "_land_id"))
        .withColumn("row_index", F.col("_land_id") + F.col("_land_shift"))
        .drop("_land_file", "_land_block", "_land_id", "_land_shift", "_land_run")
    )


def read_delimited(spark: SparkSession, path: str, headers: Mapping[str, str], multi_line: bool = True) -> DataFrame:
    """Read CSV files with a header by column name, quoted line breaks included.

    The cells are written to the scratch folder once, with the marks from
    which ordinals follow, so that a repeated read cannot renumber them.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    cells = trimmed_headers(raw)
    known = [F.when(~F.col(f"`{c}`").isin(*fv.MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in cells.columns]
    marked = cells.select(
        *known,
        F.col("_metadata.file_path").alias("_land_file"),
        F.col("_metadata.file_block_start").alias("_land_block"),
        F.monotonically_increasing_id().alias("_land_id"),
    )
    return with_row_index(written(by_header(marked, headers), "landing"))


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, BULK_HEADERS)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, CURATED_HEADERS)
