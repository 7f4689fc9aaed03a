"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .sinks.files import remove

# Settings the engine relies on; a cluster's own values are left alone.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A one-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("masterloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        # Compile generated methods of any size; executors of a cluster want
        # the same in spark.executor.extraJavaOptions.
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders of local sessions that name none, by application.
_local_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``, or
    set on the running context.

    Only a local session that names none gets a folder of its own; on a
    cluster a machine-local folder would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="masterloom-")
    return _local_folders[application]


# Folders of the runs under way, innermost last, by application.
_runs: dict[str, list[str]] = {}


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go to a folder of their own, which is removed at the end,
    whatever the end. Results that outlive the run must be stored elsewhere."""
    runs = _runs.setdefault(spark.sparkContext.applicationId, [])
    folder = os.path.join(scratch_dir(spark), "masterloom", f"run-{uuid.uuid4().hex}")
    runs.append(folder)
    try:
        yield
    finally:
        runs.remove(folder)
        remove(spark, folder)


# The JVM interprets for ever a method of more bytecode than this.
COMPILED_BYTES = 8000
_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Steps run inside whose generated method the JVM would not compile, such as long lists of
    ``CASE`` expressions, run on Spark's expressions in small methods instead."""
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, min(int(before), COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_LIMIT, before)


def written(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write a frame that several steps read to the scratch folder and read it
    back: the lineage ends there, and every reader scans only its columns.
    With ``outlive`` the table belongs to what encloses the innermost run, and stays when that ends."""
    spark = df.sparkSession
    runs = _runs.get(spark.sparkContext.applicationId, [])
    runs = runs[:-1] if outlive else runs
    folder = runs[-1] if runs else os.path.join(scratch_dir(spark), "masterloom")
    path = os.path.join(folder, f"{name}-{uuid.uuid4().hex}")
    with compiled(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer tasks than cores to all of them.

    For inputs that cannot be split, such as one small file or one quoted CSV.
    A scan of many splits is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
