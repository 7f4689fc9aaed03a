import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from masterloom.llm.common import table
from masterloom.llm.query_ranker import op13_quality_ranker
from masterloom.llm.ranker import CLASSES, SIZE, features, fit, score, train, weighted_quantile, with_label

from .helpers import clashing, frame, odd_documents

LABELS = "doc_id long, label int"


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    got = op13_quality_ranker(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(table(spark, sf, "labels"), "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    good = np.array([r["score"] for r in held if r["quality"] == 1])
    bad = np.array([r["score"] for r in held if r["quality"] == 0])
    assert len(bad) > 80 and (good[:, None] > bad[None, :]).mean() > 0.98
    assert (good >= 0.7).mean() > 0.97 and (bad >= 0.7).mean() < 0.1


def plain_score(model, text):
    """The score of a text letter by letter."""
    data = text.encode()
    kind = lambda b: next((k for k, c in enumerate(CLASSES) if b in c), len(CLASSES))
    total = 0.0
    size = len(CLASSES) + 1
    counts = {}
    for k in range(len(data) - 2):
        key = (kind(data[k]) * size + kind(data[k + 1])) * size + kind(data[k + 2])
        counts[key] = counts.get(key, 0) + 1
    for key, n in counts.items():
        total += model.weights[key] * math.sqrt(n / (len(data) - 2))
    words, lines = data.split(), data.split(b"\n")
    own = [math.log(1 + len(data)) / 10, len(set(words)) / (len(words) or 1), len(set(lines)) / len(lines),
           min(30, len(data) / (len(words) or 1)) / 10]
    total += sum(w * v for w, v in zip(model.weights[-4:], own))
    return 1 / (1 + math.exp(-(model.sharpness * (total - model.offset) + model.shift)))


def test_scores_equal_a_plain_computation(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, with_label(table(spark, sf, "labels"), "quality"), F.lit(True))
    rows = score(docs.withColumn("own", F.col("text")), model).limit(60).collect()
    for r in rows:
        assert r["quality_score"] == pytest.approx(plain_score(model, r["own"] or ""), abs=1e-4)


def test_training_repeats(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), with_label(table(spark, sf, "labels"), "quality")
    a, b = (train(docs.repartition(n), labels.repartition(n), F.lit(True)) for n in (1, 5))
    assert (a.weights == b.weights).all() and (a.offset, a.sharpness) == (b.offset, b.sharpness)


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("t%d", "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("label"))
    import masterloom.llm.ranker as ranker

    seen = []
    real = ranker.fit
    ranker.fit = lambda x, y, *more: seen.append((len(x), int(y.sum()), more[0])) or real(x, y, *more)
    try:
        ranker.train(docs, labels, F.lit(True), per_label=100)
    finally:
        ranker.fit = real
    assert seen == [(200, 100, (2571, 429))]


def test_odd_rows(spark):
    docs = clashing(frame(spark, odd_documents())).withColumn("quality_score", F.lit("x"))
    labels = frame(spark, [(1, 1), (2, 1), (9, 0), (4, 0), (None, 1), (7, None), (99, 0), (6, 1), (6, 0), (10, 5)], LABELS)
    model = train(docs, labels, F.lit(True))
    rows = score(docs.withColumn("own", F.col("text")), model).collect()
    assert len(rows) == len(odd_documents()) and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert len({r["quality_score"] for r in rows if not r["own"]}) == 1
    assert score(docs.limit(0), model).count() == 0
    empty = train(docs.limit(0), labels, F.lit(True))
    assert empty.score(features(b"")) == 0.5


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_few_labels(spark, labels, want):
    docs = frame(spark, odd_documents())
    model = train(docs, frame(spark, labels, LABELS), F.lit(True))
    assert {r["quality_score"] for r in score(docs, model).collect()} == {want}


def test_long_texts_are_read_whole():
    text = b"ab. " * 700_000
    assert np.allclose(features(text)[:-4], features(text[:400_000])[:-4], atol=1e-3)
    tail = features(text + b"!" * 2_000_000)[:-4].astype(float)
    assert abs((tail ** 2).sum() - 1) < 1e-4 and abs(tail.max() ** 2 - 2_000_000 / 4_800_000) < 1e-4


def test_quantile_and_order():
    values = np.array([1.0, 2, 3, 4])
    assert weighted_quantile(values, np.ones(4), 0.5) == 2.5 and weighted_quantile(values, np.array([3.0, 1, 1, 1]), 0.5) == 1.5
    x = np.zeros((40, SIZE), np.float32)
    x[:20, 5] = 1
    model = fit(x, np.repeat([1, 0], 20), (300, 100))
    assert model.score(x[0]) > 0.7 > model.score(x[-1])


def test_all_labelled_texts_take_part(spark, monkeypatch):
    import masterloom.llm.ranker as ranker

    monkeypatch.setattr(ranker, "PER_LABEL", 100)
    docs = spark.range(1800).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.format_string("Plain words, no. %d.", "id"))
                                    .otherwise(F.format_string("### %d %%%%", "id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("label"))
    seen = []
    real = ranker._fit_in_parts
    monkeypatch.setattr(ranker, "_fit_in_parts", lambda texts, totals, *more: seen.append((texts.count(), totals)) or real(texts, totals, *more))
    a, b = (ranker.train(docs.repartition(n), labels.repartition(n), F.lit(True)) for n in (1, 5))
    assert seen == [(1800, (900, 900))] * 2
    assert (a.weights == b.weights).all() and (a.offset, a.sharpness) == (b.offset, b.sharpness)
    good = {(r["doc_id"] % 2, r["good"]) for r in score(docs, a).collect()}
    assert good == {(0, True), (1, False)}


def test_scarce_label_reaches_every_part(spark, monkeypatch):
    import masterloom.llm.ranker as ranker

    monkeypatch.setattr(ranker, "PER_LABEL", 50)
    docs = spark.range(603).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "!!! 1 2 3 !!!").otherwise(F.lit("calm words")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") >= 3).cast("int").alias("label"))
    model = ranker.train(docs, labels, F.lit(True))
    assert model.score(features(b"calm words")) > model.score(features(b"!!! 1 2 3 !!!"))
    # Labels whose texts are missing leave one label.
    assert ranker.train(docs.where("doc_id >= 3"), labels, F.lit(True)).fixed == 1.0


@pytest.mark.parametrize("gathered", [0, 3, 1000])
def test_quantile_of_a_table(spark, gathered):
    from masterloom.llm.ranker import spread_quantile

    rng = np.random.default_rng(3)
    marks = np.round(rng.normal(size=400), 2)
    labels = rng.integers(0, 2, 400)
    order = np.lexsort((labels, marks))
    table_ = spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, marks)], "label int, mark double")
    for share in (0.02, 0.5, 0.97, 1.0):
        own = np.where(labels == 1, 2.0, 0.5)
        want = weighted_quantile(marks[order], own[order], share)
        assert spread_quantile(table_, (0.5, 2.0), share, gathered) == pytest.approx(want)
