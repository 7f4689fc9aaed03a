from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from masterloom.llm.common import table
from masterloom.llm.query_pieces import MODEL

from . import test_minhash, test_mixing, test_substrings
from .helpers import SF, clashing, frame, odd_documents, words

STAGE = dict(corpus_pipeline.STAGES)


def test_stages_and_columns():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mix", "pieces"]


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_rows(spark, kind):
    docs = clashing(frame(spark, odd_documents() if kind == "odd" else []))
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")] + ["lang_pred", "accepted", "n_removed", "kept_text"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in own})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns), name
        # What a document has under a name that a stage uses itself stays as it is.
        kept = out.select(F.count("*"), *[F.count_if(F.col(c) == f"own {c}") for c in own]).first()
        assert set(kept) == {kept[0]} and (kept[0] > 0) == (kind == "odd"), name
    STAGE["pieces"](spark, docs, SF).collect()


def test_each_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}

    kept = {r["doc_id"] for r in STAGE["language"](spark, docs, SF).collect()}
    lettered = {i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    assert kept <= lettered and len(kept) > 0.98 * len(lettered)

    alone = {r["doc_id"] for r in STAGE["near_duplicates"](spark, docs, SF).collect()}
    assert alone == {i for i, c in test_minhash.expected_components([(i, r["text"]) for i, r in rows.items()]) if i == c}

    want = {int(i): (gone, text) for i, _, gone, text in test_substrings.expected([(i, r["text"]) for i, r in rows.items()])}
    for r in STAGE["repeated_passages"](spark, docs, SF).collect():
        gone, text = want[r["doc_id"]]
        assert r["text"] == (text if gone else rows[r["doc_id"]]["text"]) and r["n_chars"] == len(r["text"])

    sized = [(i, r["source"], len(words(r["text"]))) for i, r in rows.items()]
    sizes = test_mixing.sized(sized)
    copies = {i: n for i, _, _, n in test_mixing.expected_copies(sized, test_mixing.expected_targets(sizes), sizes)}
    assert Counter(r["doc_id"] for r in STAGE["mix"](spark, docs, SF).collect()) == Counter({i: n for i, n in copies.items() if n})

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in STAGE["pieces"](spark, docs, SF).collect():
        assert r["piece_ids"] == library.encode(rows[r["doc_id"]]["text"] or "")


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert {"doc_id", "lang", "source", "n_chars", "piece_ids", "n_pieces"} == set(out.columns) and rows
    again = Counter((r["doc_id"], r["n_pieces"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert again == Counter((r["doc_id"], r["n_pieces"]) for r in rows)
