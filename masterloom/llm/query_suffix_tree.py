"""op7: language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table
from .suffix_tree import score_texts


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
