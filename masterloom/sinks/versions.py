"""Publishing a set of tables at once.

Every refresh writes its tables to a folder of its own, ``versions/<number>-<id>``, and ends
with an empty file there, the mark. A version counts from its mark on: readers take the
newest marked version and stay with it, so they see all tables of one refresh or of the one
before, never some of each, and a refresh that dies leaves what was there before. The last
``KEEP`` marked versions are kept; older ones go, with folders without a mark that are
older still. Tables that people edit lie beside the versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import exists, mark, names, remove
from .tables import replace

MARK = "_PUBLISHED"
KEEP = 4


def versions_folder(out: str) -> str:
    return f"{out.rstrip('/')}/versions"


def published_versions(spark: SparkSession, out: str) -> list[str]:
    """Names of the versions that count, oldest first."""
    folder = versions_folder(out)
    return [v for v in names(spark, folder) if exists(spark, f"{folder}/{v}/{MARK}")]


class Publication:
    """A version that is being written."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark = spark
        self.out = out.rstrip("/")
        taken = [int(v.split("-")[0]) for v in names(spark, versions_folder(out))]
        # The id keeps two refreshes apart that begin at once.
        self.version = f"{max(taken, default=0) + 1:010d}-{uuid.uuid4().hex[:8]}"

    def path(self, name: str) -> str:
        return f"{versions_folder(self.out)}/{self.version}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write a table and return it as it is stored."""
        replace(df, self.path(name), partition_by=partition_by)
        return self.spark.read.parquet(self.path(name))

    def publish(self, keep: int = KEEP) -> str:
        """Make this the version that counts, then remove what is too old."""
        mark(self.spark, self.path(MARK))
        folder = versions_folder(self.out)
        kept = published_versions(self.spark, self.out)[-keep:]
        for version in names(self.spark, folder):
            # One without a mark may be a refresh under way, unless it is older than all kept.
            if version < kept[0]:
                remove(self.spark, f"{folder}/{version}")
        return self.version

    def abandon(self) -> None:
        remove(self.spark, f"{versions_folder(self.out)}/{self.version}")
