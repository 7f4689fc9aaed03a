import numpy as np
import pytest

from masterloom.llm.substrings import dedup_substrings
from masterloom.llm.tokens import run_hashes

from .helpers import clashing, frame, odd_documents, words

LOWEST = -(1 << 63)


def expected(rows, edge=20):
    """Every window against all windows; ids are unique or texts of an id equal."""
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - edge + 1):
            at = (LOWEST if doc_id is None else doc_id, i)
            key = tuple(w[i:i + edge])
            first[key] = min(first.get(key, at), at)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - edge + 1):
            if first[tuple(w[i:i + edge])] < (LOWEST if doc_id is None else doc_id, i):
                gone.update(range(i, i + edge))
        out.append((str(doc_id), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def check(spark, rows, **options):
    docs = clashing(frame(spark, rows, "doc_id long, text string"))
    found = dedup_substrings(docs, **options)
    assert found.columns == [*(c for c in docs.columns if c != "n_words"), "n_words", "n_removed", "kept_text"]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()) == expected(rows, options.get("edge", 20))


@pytest.mark.parametrize("seed,kinds", [(1, 3), (2, 40), (3, 400)])
def test_random_passages(spark, seed, kinds):
    rng = np.random.default_rng(seed)
    passages = [[f"p{rng.integers(kinds)}" for _ in range(int(rng.integers(10, 70)))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(int(rng.integers(0, 6))):
            w += passages[rng.integers(8)] if rng.random() < 0.6 else [f"u{rng.integers(1 << 30)}" for _ in range(int(rng.integers(0, 30)))]
        rows.append((int(rng.integers(1 << 40)) - (1 << 39), " ".join(w)))
    rows += [(1 << 50, " ".join(["la"] * 500)), ((1 << 50) + 1, " ".join(["la"] * 19)), ((1 << 50) + 2, " ".join(["la"] * 20))]
    check(spark, rows)


def test_small_edges(spark):
    rng = np.random.default_rng(9)
    check(spark, [(i, " ".join(rng.choice(list("abc"), 30))) for i in range(20)], edge=7, anchor=3)


def test_odd_rows(spark):
    check(spark, [(r[0], r[1]) for r in odd_documents() if r[1] != "other text of the same id"])
    assert dedup_substrings(frame(spark, [], "doc_id long, text string")).count() == 0


def test_runs_of_the_same_words_hash_alike():
    x = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    for length in (1, 5, 6, 20):
        h = run_hashes(x, length)
        seen = {}
        assert len(h) == 500 - length + 1
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(tuple(x[i:i + length]), v) == v
        assert len(set(h.tolist())) == len(seen)


def test_cutting_holds_a_chunk_at_a_time():
    """Texts of a batch aren't objects all at once, and arrays of a chunk are few."""
    import tracemalloc

    import pyarrow as pa

    from masterloom.llm import substrings

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 1_000)) for _ in range(2_500)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(np.zeros(len(texts), np.int32)), pa.array(texts)], names=["doc", "tag", "text"])
    del texts
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in substrings.cut_paths(np.empty(0, np.uint64))(iter([batch]))) > 0
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.nbytes > 3 * substrings.CHUNK_CHARS and peak < 22 * substrings.CHUNK_CHARS, peak
