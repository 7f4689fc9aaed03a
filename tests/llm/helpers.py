"""Small inputs with everything that can go wrong in them."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def odd_documents():
    """Nulls in each column, empty and long texts, ties, repeated rows."""
    prose = " ".join(f"wordy{i % 37}x{i % 11} and" for i in range(60))
    long = " ".join(f"t{i * i % 9973}" for i in range(30_000))
    rows = [
        (1, prose, "en", "a", 1), (2, prose, "en", "a", 1), (3, None, "en", "a", None), (4, "", "de", None, 0),
        (5, " \t\n ", None, "b", 4), (6, "short text", "en", "b", 10), (6, "short text", "en", "b", 10),
        (None, "no id at all", "en", None, 12), (7, long, None, "c", len(long)), (8, long + " tail", "de", "c", 0),
        (9, "### 123 %%%", "fr", "", 11), (10, prose + " ende", "en", "a", 3), (6, "other text of the same id", "en", "b", 1),
        (11, "Grün çà \U0001f600 ▁mark <|im_end|>", "de", "é", 5), (-5, "negative id " + prose, "en", "a", 0),
    ]
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """With extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in (
        "id", "key", "size", "copies", "score", "words", "tag", "doc", "n", "row", "host", "component_id", "n_words", "piece_ids", "mark")})
