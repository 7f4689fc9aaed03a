"""Folders on whatever file system a path names, through the one Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, sorted; nothing if there is none."""
    files, place = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file, which must not exist yet."""
    files, place = _at(spark, path)
    files.create(place, False).close()
