"""op2: fingerprints of all documents, of their edited texts and how near they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table
from .fingerprints import fingerprints, lexicon, likeness, signatures, with_next, written_out


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    words = lexicon(docs)
    rows = with_next(fingerprints(docs, words), "doc_id", ["text", "signs"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signs", "next_signs")
    rows = signatures(rows, "edited", words, "edited_signs")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written_out(F.col("signs")).alias("fingerprint"), written_out(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"))
