from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from masterloom.llm import minhash
from masterloom.llm.minhash import bag, deduplicated, near_documents, signatures, weighted_jaccard

from .helpers import clashing, frame, odd_documents, words


def shingles(text):
    w = words(text)
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def expected_components(texts, similar=0.8):
    bags = [shingles(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            shared = sum((a & bags[j]).values())
            if a and (texts[i][1] == texts[j][1] or shared >= similar * (sum(a.values()) + sum(bags[j].values()) - shared)):
                x, y = root(i), root(j)
                up[x] = up[y] = min(x, y, key=lambda k: texts[k][0])
    return sorted((texts[i][0], min(texts[j][0] for j in range(len(texts)) if root(j) == root(i))) for i in range(len(texts)))


def check(spark, texts):
    docs = clashing(frame(spark, texts, "doc_id long, text string"))
    got = sorted((r["doc"], r["component_id"]) for r in near_documents(docs).collect())
    assert got == expected_components(texts)
    return docs


def edited(rng, tokens, share):
    return [t if rng.random() > share else f"e{rng.integers(1 << 40)}" for t in tokens]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_about_the_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    texts = []
    for g in range(6):  # groups whose members are linked to some of the others only
        first = [f"g{g}w{i}" for i in range(int(rng.integers(40, 200)))]
        for _ in range(25):
            texts.append(" ".join(edited(rng, first, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05]))))
    texts += [" ".join(f"h{i % 3}" for i in range(n)) for n in (30, 32, 60, 5000)] + ["one two", "one two", "one two three"]
    check(spark, list(enumerate(texts)))


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_documents() if r[0] is not None and r[0] != 6]
    docs = check(spark, rows)
    assert sorted(r["doc_id"] for r in deduplicated(docs).collect()) == sorted({i for i, c in expected_components(rows) if i == c})


def test_repeated_ids_and_rows(spark):
    rows = odd_documents()
    docs = clashing(frame(spark, rows))
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert got.count(("6", "short text")) == 1 and ("6", "other text of the same id") in got
    assert len([x for x in got if "wordy" in x[1]]) == 1 and ("None", "no id at all") in got
    assert deduplicated(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    a = {int(x): int(n) for x, n in zip(rng.integers(1, 1 << 60, 60), rng.choice([1, 1, 2, 5, 9, 40], 60))}
    b = {x: max(1, n + int(rng.integers(-3, 4))) for x, n in list(a.items())[10:]}
    pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[x] for x in sorted(d)]))
    truth = weighted_jaccard(pack(a), pack(b))
    s = signatures([pack(a), pack(b)], slots=4096)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - truth) < 4 * (truth * (1 - truth) / 4096) ** 0.5
    alone = signatures([pack(b)], slots=4096)
    assert (alone[0] == s[1]).all()  # other texts of a batch don't matter


def test_one_shingle_fills_all_slots():
    assert np.isfinite(signatures([bag(np.array([5], np.uint64)), bag(np.arange(9, dtype=np.uint64))])).all()


def test_a_band_that_agrees_in_bytes_only_does_not_hide_the_bucket():
    """Two documents with equal slot bytes everywhere, whose bucket hashes first agree in band 3."""
    hashes = np.arange(2 * minhash.BANDS, dtype=np.uint64).reshape(2, minhash.BANDS)
    hashes[1, 3:] = hashes[0, 3:]
    columns = ["bucket", "left", "right", "side", "id", "component", "sketch", "wide", "hashes"]
    found = {}
    for band in (3, 4):
        bucket = int(hashes[0, band])
        rows = [(bucket, 0, 0, 0, i, i, bytes(minhash.SLOTS), bytes(minhash.WIDE), h.tobytes()) for i, h in enumerate(hashes, 1)]
        batch = pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in rows])
        found[band] = [(x["a"], x["b"]) for out in minhash._all(0.8)(iter([batch])) for x in out.to_pylist()]
    assert found == {3: [(1, 2)], 4: []}


def test_tiles_hold_each_pair_of_components_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE", 3)
    component = {i: 0 if i < 20 else 20 + i % 4 for i in range(31)}
    members = frame(spark, [(7, i) for i in component] + [(8, i) for i in range(20)], "bucket long, id long")
    labels = frame(spark, list(component.items()), "id long, component long")
    sketches = frame(spark, [(i, bytes([i])) for i in component], "id long, sketch binary")
    tiles = {}
    for r in minhash._tiles(minhash._mixed_up(members, labels), sketches).collect():
        assert r["bucket"] == 7 and r["component"] == component[r["id"]] and r["sketch"] == bytes([r["id"]])
        tiles.setdefault((r["left"], r["right"]), ([], []))[r["side"]].append(r["id"])
    met = Counter()
    for (left, right), (a, b) in tiles.items():
        pairs = [(x, y) for x in a for y in a if x < y] if left == right else [(x, y) for x in a for y in b]
        met.update((min(p), max(p)) for p in pairs if component[p[0]] != component[p[1]])
    assert met == Counter({(x, y): 1 for x in component for y in component if x < y and component[x] != component[y]})
