"""What several operators of this package share."""

from __future__ import annotations

import gc
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trimmed(text: Column) -> Column:
    """Text without white space at either end; null becomes empty."""
    return F.coalesce(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    inside = trimmed(text)
    return F.when(inside == "", F.lit(0)).otherwise(F.size(F.split(inside, SPACE))).cast("long")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input, whatever
    their names, can't clash with those an operator makes. Missing ones are null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names])


def freed(spark: SparkSession) -> None:
    """Let go of what finished jobs left behind. Spark removes shuffle files and status data once the
    driver's garbage collector finds no plan that refers to them, which a driver with
    little to do may not come to for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
