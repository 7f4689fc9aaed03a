import math

import numpy as np
import pytest

from masterloom.llm.common import table
from masterloom.llm import vectors
from masterloom.llm.vectors import near_vectors

from .helpers import SF, clashing, frame

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for x, (a, v) in enumerate(good) for y, (b, w) in enumerate(good)
             if x != y and len(v) == len(w) and v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= cosine]
    up = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return sorted((i, sum(a == i for a, _ in links), up[i]) for i, _ in rows)


def check(spark, rows, **options):
    got = near_vectors(frame(spark, [(i, v, 0) for i, v in rows], SCHEMA), **options)
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect())
    assert found == expected(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())


def planted(dims, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dims) for _ in range(n)]
    for i in range(n // 2):  # chains and groups about the threshold
        rows.append(rows[i] + rng.normal(size=dims) * rng.choice([0.1, 0.35, 0.45, 0.5]))
    rows += [rows[0]] * 3 + [rows[1] * 7]
    return [(i * 3 + 1, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("dims,options", [(64, {}), (64, {"slice_rows": 16}), (5, {"slice_rows": 10}), (33, {"width": 4, "slice_rows": 20})])
def test_against_all_pairs(spark, dims, options):
    check(spark, planted(dims, 60), **options)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]),
                  (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.1]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1e30, 1e29]), (13, [1e-30, 1e-31])])


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    check(spark, rows)


def test_empty(spark):
    assert near_vectors(frame(spark, [], SCHEMA)).count() == 0


def test_null_and_repeated_ids(spark):
    """Rows without an id link like any other; a component of such rows alone has no number."""
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.05]), (None, [-1.0, 0.0]), (None, [-1.0, 0.01]), (None, [0.0, 1.0]), (9, [0.0, -1.0]),
            (9, [0.0, -1.0]), (None, None)]
    df = clashing(frame(spark, [(i, v, 0) for i, v in rows], SCHEMA))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (None, 1, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True),
                          (9, 1, 9, True), (9, 1, 9, True), (None, 0, None, True)], key=str)


def test_a_vector_goes_to_a_bounded_number_of_tiles(spark, monkeypatch):
    """However many rows a slice might hold at least, and each pair of vectors of a length meets in one tile."""
    classes = spark.createDataFrame([(i, 1, [float(i + 1)] * (2 if i % 3 else 5)) for i in range(300)], "id long, copies long, vector array<float>")
    rows = vectors.tiles(classes, 1)
    assert rows.groupBy("id").count().agg({"count": "max"}).first()[0] == vectors.MOST_SLICES
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, ["dims", "left", "right"]).where("a.id < b.id AND (a.left = a.right OR a.side <> b.side)")
    pairs = met.selectExpr("a.id AS x", "b.id AS y").collect()
    assert len(pairs) == len(set(pairs)) == 100 * 99 // 2 + 200 * 199 // 2
    monkeypatch.setattr(vectors, "LARGEST", 2)
    assert vectors.tiles(classes, 1).agg({"right": "max"}).first()[0] == 99


@pytest.mark.parametrize("rows,columns,pairs", [(256, 1024, 50_000), (7, 5, 3)])
def test_candidates_of_a_tile(monkeypatch, rows, columns, pairs):
    """In parts of any size, each pair within budget in some block comes once, from a large group of near copies too."""
    for name, value in (("ROWS_AT_ONCE", rows), ("COLUMNS_AT_ONCE", columns), ("PAIRS_AT_ONCE", pairs)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(3)
    middle, other = rng.normal(size=64), rng.normal(size=64)
    x = vectors._unit(np.array([(middle if i % 3 else other) + rng.normal(size=64) * 0.3 for i in range(90)] + [rng.normal(size=64) for _ in range(10)]))
    x = (x @ vectors.rotation(64)).astype(np.float32)
    cuts = vectors.blocks_of(64)
    budgets = [0.2 / 4 + vectors.SLACK] * 4
    for y, same in ((x, True), (x[20:75], False)):
        within = vectors._passing(np.repeat(x, len(y), 0), np.tile(y, (len(x), 1)), cuts, budgets).any(axis=1).reshape(len(x), len(y))
        expected = sorted(zip(*(z.tolist() for z in np.nonzero(np.triu(within, 1) if same else within))))
        got = sorted((u, v) for s, t in vectors._candidates(x, y, cuts, budgets, same) for u, v in zip(s.tolist(), t.tolist()))
        assert got == expected and len(got) > 1000


def test_forest_spans_what_is_linked():
    forest = vectors._Forest(7)
    assert forest.join(np.array([1, 2, 1, 5]), np.array([2, 3, 3, 6])) == [0, 2, 3] and forest.join(np.array([3]), np.array([1])) == []
    assert forest.join(np.array([6, 0, 2]), np.array([2, 4, 5])) == [1, 0] and forest.least.tolist() == [0, 1, 1, 1, 0, 1, 1]
