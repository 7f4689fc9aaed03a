import hashlib
import math
from collections import defaultdict

import pytest

from masterloom.llm.common import table
from masterloom.llm.mixing import emitted, mix
from masterloom.llm.query_mixing import op4_mix_sources

from .helpers import SF, clashing, frame, odd_documents, words


def expected_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The excess of full sources is shared again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def expected_copies(rows, targets, sizes):
    """Copies by walking each source's documents in order."""
    out = []
    by_source = defaultdict(list)
    for doc_id, source, size in rows:
        by_source[source].append((-size, hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest(), doc_id or 0, doc_id))
    for source, docs in by_source.items():
        key = "n" if source is None else "a" + source
        offset = int(hashlib.md5(("mix" + key).encode()).hexdigest()[:8], 16) / 2 ** 32
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        for i, (size, _, _, doc_id) in enumerate(sorted(docs), 1):
            out.append((doc_id, source, -size, math.floor(i * rate + offset) - math.floor((i - 1) * rate + offset)))
    return out


def sized(rows):
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    return sizes


@pytest.mark.parametrize("kind", ["odd", "table"])
def test_against_brute_force(spark, kind):
    docs = clashing(frame(spark, odd_documents())) if kind == "odd" else table(spark, SF, "documents")
    rows = [(r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.collect()]
    sizes = sized(rows)
    targets = expected_targets(sizes)
    got = mix(docs).collect()
    order = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["doc_id"], r["source"], r["size"], r["copies"]) for r in got], key=order) == sorted(
        expected_copies(rows, targets, sizes), key=order)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]


def test_bounds(spark):
    rows = op4_mix_sources(spark, "/root/testdata/sf0.01").collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6


def test_emitted_copies(spark):
    docs = clashing(frame(spark, odd_documents()))
    copies = mix(docs)
    got, out = copies.collect(), emitted(docs, copies)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == sum(r["copies"] for r in got)
    per_source = defaultdict(int)
    for r in rows:
        per_source[r["source"]] += len(words(r["text"]))
    for source in {r["source"] for r in got}:
        assert per_source[source] == sum(r["copies"] * r["size"] for r in got if r["source"] == source)


def test_empty(spark):
    docs = frame(spark, [])
    assert mix(docs).count() == 0 and emitted(docs, mix(docs)).count() == 0
