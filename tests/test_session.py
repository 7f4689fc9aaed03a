from types import SimpleNamespace

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from masterloom import session
from masterloom.sinks.tables import replace


def fake(master, conf=None, checkpoint=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app-" + master, getCheckpointDir=lambda: checkpoint))


def test_scratch_folder():
    assert session.scratch_dir(fake("yarn", conf="hdfs://a/b")) == "hdfs://a/b"
    assert session.scratch_dir(fake("yarn", checkpoint="hdfs://c")) == "hdfs://c"
    with pytest.raises(ValueError):
        session.scratch_dir(fake("yarn"))
    local = session.scratch_dir(fake("local[2]"))
    assert session.scratch_dir(fake("local[2]")) == local


def test_written_cuts_lineage(spark):
    df = session.written(spark.range(5).selectExpr("id", "id * 2 AS twice"), "t")
    assert sorted(map(tuple, df.collect())) == [(i, 2 * i) for i in range(5)]
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_written_by_methods_the_jvm_compiles(spark, monkeypatch, tmp_path):
    """While a table is written, larger generated methods are off; afterwards the setting is as before."""
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    spread_out = " ".join(f"WHEN id % 997 = {i} THEN concat('a', id, 'b{i}')" for i in range(300))
    df = spark.range(2000).selectExpr("id", f"CASE {spread_out} END AS t")
    for name in ("parquet", "save"):
        plain = getattr(DataFrameWriter, name)
        monkeypatch.setattr(DataFrameWriter, name, lambda *a, plain=plain, **k: seen.append(int(spark.conf.get(limit))) or plain(*a, **k))
    before = spark.conf.get(limit)
    stored = session.written(df, "wide")
    replace(df, str(tmp_path / "wide"))
    assert seen == [session.COMPILED_BYTES] * 2 and spark.conf.get(limit) == before
    assert sorted(stored.collect()) == sorted(spark.read.parquet(str(tmp_path / "wide")).collect()) == sorted(df.collect(), key=lambda r: r.id)
    spark.conf.set(limit, 500)
    try:
        session.written(df.limit(1), "lower")
        assert seen[-1] == 500 and spark.conf.get(limit) == "500"
    finally:
        spark.conf.set(limit, before)


def test_spread_leaves_split_scans_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert session.spread(wide) is wide
    assert session.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
