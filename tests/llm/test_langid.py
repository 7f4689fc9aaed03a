import pytest
from pyspark.sql import functions as F

from masterloom.llm.common import table
from masterloom.llm.langid import fit, labelled, predict, train
from masterloom.llm.query_langid import op1_language_id

from .helpers import clashing, frame, odd_documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op1_language_id(spark, sf)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert len(rows) == 1000 and len(held) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = [r for r in rows if r["lang_pred"] != "und"]
    assert sum(r["accepted"] for r in kept) / len(kept) > 0.97


def test_training_repeats(spark):
    docs = labelled(table(spark, "/root/testdata/sf0.001", "documents"))
    a, b = (train(docs.repartition(n), F.lit(True)) for n in (1, 5))
    assert a.labels == b.labels and a.temperature == b.temperature and (a.embeddings == b.embeddings).all()


def test_odd_rows(spark):
    docs = clashing(frame(spark, odd_documents()))
    model = train(labelled(docs), F.lit(True))
    got = predict(docs, model)
    rows = got.collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        else:
            assert r["lang_pred"] in model.labels and 0 <= r["score"] <= 1
    assert predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], ["en"]])
def test_few_labels(spark, labels):
    rows = [(1, "some words", x, "s", 1) for x in labels] or [(1, "some words", None, "s", 1)]
    model = train(labelled(frame(spark, rows)), F.lit(True))
    got = predict(frame(spark, rows), model).first()
    assert (got["lang_pred"], got["score"]) == (("en", 1.0) if labels else ("und", 0.0))


def test_fit_of_nothing():
    assert fit([], []).labels == ()


def test_numerals_are_no_letters(spark):
    model = train(labelled(frame(spark, [(1, "some words", "en", "s", 1), (2, "andere Worte", "de", "s", 1)])), F.lit(True))
    texts = ["½ ²", "①Ⅷ", "½ a", "²ß", "७ 3"]
    got = predict(frame(spark, [(i, t, None, "s", 1) for i, t in enumerate(texts)]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, False, False, True]
