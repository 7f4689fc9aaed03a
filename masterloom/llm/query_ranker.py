"""op13: the quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table
from .ranker import score, train, with_label


def op13_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs, with_label(table(spark, sf_dir, "labels"), "quality"), ~held_out)
    return score(docs.withColumn("held_out", held_out), model).select(
        "doc_id", "held_out", F.col("quality_score").alias("score"), F.col("good").cast("int").alias("predicted"))
