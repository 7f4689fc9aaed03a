"""op3: all documents encoded to pieces and decoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table
from .pieces import MARK, decode, encode, load_model

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """The ids of every whole text; ``round_trip`` tells whether they decode to it."""
    model = load_model(model_path)
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    back = decode(encode(docs, model), model)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return back.select("doc_id", F.size("piece_ids").alias("n_pieces"), same.alias("round_trip"), "piece_ids")
