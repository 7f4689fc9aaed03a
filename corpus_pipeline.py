"""A corpus pipeline: documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame; the table is written as Parquet between stages. All but the last
return the columns of ``docs``. Where a stage finds nothing to do it returns all rows.

1. ``language``: documents whose language is rejected go.
2. ``near_duplicates``: one document of each group of near copies stays.
3. ``repeated_passages``: runs of 20 words that also start earlier are taken out of the text.
4. ``mix``: documents are repeated or left out so that sources come near their targets.
5. ``pieces``: texts become SentencePiece ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masterloom.llm.common import table
from masterloom.llm.langid import labelled, predict, train
from masterloom.llm.minhash import deduplicated
from masterloom.llm.mixing import emitted, mix
from masterloom.llm.pieces import encode, load_model
from masterloom.llm.query_pieces import MODEL
from masterloom.llm.substrings import dedup_substrings
from masterloom.session import scratch_dir


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """The documents with all but the columns ``used`` under reserved names, so that what a
    stage adds can't replace a column of theirs."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in used else f"_own_{i}") for i, c in enumerate(docs.columns)])


def _restored(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`" if c in used else f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with enough confidence."""
    model = train(labelled(docs), F.lit(True))
    return _restored(predict(_apart(docs, "text"), model).where("accepted"), docs, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group."""
    return deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out; other texts stay as they are. ``n_chars`` follows."""
    used = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    found = dedup_substrings(_apart(docs, *used))
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return _restored(found.withColumns(changed), docs, *used)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents."""
    return emitted(docs, mix(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts; the ids take their place."""
    encoded = encode(docs, load_model(MODEL))
    return encoded.drop("text").withColumn("n_pieces", F.size("piece_ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mixed),
    ("pieces", pieces),
]

# Signatures, training and pieces can't be expressed in SQL; the tests check each
# stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table between them."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark).rstrip('/')}/masterloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
