"""Reading the published outputs, whole or by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.versions import published_versions, versions_folder


# Tables that people edit or that outlive a version.
LASTING = ("taxonomy_product_lines", "taxonomy_models", "overrides", "runs")


class Published:
    """The tables of one version under a folder: the newest one, if none is named.

    A reader stays with its version while newer ones come; ask again to see those.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str | None = None) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        known = published_versions(spark, folder)
        self.version = version or (known[-1] if known else "")
        if self.version not in known:
            raise FileNotFoundError(f"no published version {self.version or 'at all'} in {folder}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}" if name in LASTING else f"{versions_folder(self.folder)}/{self.version}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def master(self) -> DataFrame:
        return self.read("master")

    def families(self) -> DataFrame:
        return self.read("families")

    def exceptions(self) -> DataFrame:
        return self.read("exceptions")

    def refresh_log(self) -> DataFrame:
        return self.read("refresh_log")

    def overrides(self) -> DataFrame:
        return self.read("overrides")

    def runs(self) -> DataFrame:
        """Every refresh so far, failed ones included, one row per source."""
        return self.read("runs")

    def taxonomy(self) -> tuple[DataFrame, DataFrame]:
        """Product lines and models."""
        return self.read("taxonomy_product_lines"), self.read("taxonomy_models")


def read_json(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """JSON lines with the columns and types of ``like``; nothing is inferred."""
    return spark.read.schema(like.schema).json(path)


def record_by_id(master: DataFrame, record_id: str) -> DataFrame:
    """The record with this id, or no row. The test reaches the file scan."""
    return master.where(F.col("id") == record_id)


def family_by_id(families: DataFrame, family_id: str) -> DataFrame:
    return families.where(F.col("family_id") == family_id)
