import hashlib

from pyspark.sql import functions as F

from masterloom.llm import query_fingerprints
from masterloom.llm.common import table
from masterloom.llm.fingerprints import fingerprints, with_next

from .helpers import SF, clashing, frame, odd_documents


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    rows = query_fingerprints.op2_imatch(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == ids
    prints = {}
    for r in rows:
        text = texts[r["doc_id"]]
        half = len(text) // 2
        edited = text[:len(text) - half] + texts[after[r["doc_id"]]][:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if edited in texts.values():
            assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    assert mean("near_edited") > 3 * mean("near_next")
    assert len(set(prints.values())) > 0.95 * len(prints)


def test_odd_rows(spark):
    rows = fingerprints(clashing(frame(spark, odd_documents()))).collect()
    assert len(rows) == len(odd_documents())
    same = {}
    for r in rows:
        assert same.setdefault(r["text"], r["signs"]) == r["signs"] and r["signs"][0] is not None
    assert fingerprints(frame(spark, [])).count() == 0


def test_next_of_every_row(spark):
    ids = [None, -(1 << 62), 5, 5, 7, 1000, 1 << 40, 8]
    df = frame(spark, [(x, f"t{i}") for i, x in enumerate(ids)], "doc_id long, text string")
    order = sorted(((-(1 << 63) if x is None else x), f"t{i}") for i, x in enumerate(ids))
    texts = [t for _, t in order]
    expected = dict(zip(texts, texts[1:] + texts[:1]))
    got = {r["text"]: r["next_text"] for r in with_next(df, "doc_id", ["text"], buckets=3).collect()}
    assert got == expected
    one = with_next(df.where(F.col("doc_id") == 7), "doc_id", ["text"]).first()
    assert one["next_text"] == one["text"]


def test_native_plan(spark):
    df = query_fingerprints.op2_imatch(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
