"""The similarity join against all pairs, and families that use it."""

import random
import re

import pytest

from masterloom.operators import families as fam
from masterloom.operators.similar_titles import _short, best_similar, similar_titles
from masterloom.operators.skew import tiled_join
from masterloom.session import written


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def titles(seed, n):
    """Variants of a few titles; many share their grams, some are very short or repeat themselves."""
    rng, shared = random.Random(seed), random.Random(0)
    words = ["flush", "valve", "sensor", "faucet", "auto", "wave", "a", "b2", "basin"]
    bases = [" ".join(shared.choice(words) for _ in range(shared.randrange(1, 9))) for _ in range(25)]
    out = {"", "a", "ab", "abc", "abcd", "abce", "abcde", "abcdf", "aaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaaaab", "valve valve valve", "valve valve valv"}
    while len(out) < n:
        base = rng.choice(bases)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(base) + 1)
            base = rng.choice([base[:k] + rng.choice("ab ev3") + base[k:], base[:k] + base[k + 1:], base[:k] + "x" + base[k + 1:]])
        out.add(base)
    return sorted(out)


@pytest.mark.parametrize("percent", [90, 80, 70])
def test_equals_all_pairs(spark, percent):
    left, right = titles(1, 150), titles(2, 150) + ["left out"]
    got = similar_titles(spark.createDataFrame([(t,) for t in left] + [(None,), (left[-1],)], "title string"),
                         spark.createDataFrame([(t, i) for i, t in enumerate(right)], "title string, family_no long"), percent, tile_rows=7)
    rows = [(r.title, r.other, r.distance, r.family_no) for r in got.collect()]
    want = {(a, b, distance(a, b), i) for a in left for i, b in enumerate(right)
            if a != b and distance(a, b) * 100 <= (max(len(a), len(b)) * (100 - percent) // 100) * 100}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 60


def test_short_titles():
    assert _short(90) == 0 and _short(80) == 5


def test_bounds(spark):
    none = spark.createDataFrame([], "title string, family_no long")
    assert best_similar(none, none).count() == 0
    with pytest.raises(ValueError):
        similar_titles(none, none, 60)


def test_best_is_most_similar_then_first(spark):
    left = spark.createDataFrame([("automatic faucet one",), ("nothing like it",)], "title string")
    right = spark.createDataFrame([("automatic faucet onex", 9), ("automatic faucet on", 3), ("automatic faucet xne", 4), ("automatic faucxx one", 1)],
                                  "title string, family_no long")
    # One edit of 21 is more similar than one of 20.
    assert [tuple(r) for r in best_similar(left, right).collect()] == [("automatic faucet one", 9, "automatic faucet onex", 1)]
    tied = right.where("family_no IN (3, 4)")
    assert best_similar(left, tied).first().family_no == 3


def test_tiled_join(spark):
    rng = random.Random(3)
    left = [(i, rng.choice(["hot", "hot", f"k{rng.randrange(30)}", None])) for i in range(400)]
    right = [(i, rng.choice(["hot", f"k{rng.randrange(60)}", None])) for i in range(300)]
    ldf = written(spark.createDataFrame(left, "i long, k string"), "l")
    rdf = written(spark.createDataFrame(right, "j long, k string"), "r")
    got = sorted(map(tuple, tiled_join(ldf, rdf, "k", "i", "j", tile_rows=9).select("i", "j", "k").collect()))
    assert got == sorted(map(tuple, ldf.join(rdf, "k").select("i", "j", "k").collect()))


def test_no_cross_join_and_two_title_shuffles(spark):
    a = spark.createDataFrame([("automatic faucet one",)], "title string")
    b = spark.createDataFrame([("automatic faucet on", 1)], "title string, family_no long")
    plan = similar_titles(a, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)


def test_families_by_similar_titles(spark):
    record = "seq long, id string, normalized_number string, country string, title string, title_key string, has_curated boolean"
    rows = [(1, "a", "n1", "US", "x", "automatic faucet one", True), (2, "b", "n2", None, "x", "automatic faucet two", True),
            (3, "c", "n3", "DE", "x", "automatic faucet one", True), (4, "d", "n4", "DE", "x", "automatic faucet tw", True),
            (5, "e", "n5", "FR", "x", "automatic faucet on", False), (6, "f", "n6", "FR", "x", None, True), (7, "g", "n7", "FR", "x", "unlike", True)]
    df = written(spark.createDataFrame(rows, record), "records")
    exact, similar = fam.build_families(df), fam.build_families(df, similar_percent=90)

    def placed(built):
        return {r.seq: (r.family_no, r.is_orphan, r.by_similarity) for r in built.assignments.collect()}

    assert placed(exact) == {1: (1, False, False), 2: (2, False, False), 3: (1, False, False), 4: (3, True, False),
                             5: (4, True, False), 6: (5, True, False), 7: (6, True, False)}
    # Bulk-only records and those without a title still stand alone.
    assert placed(similar) == {1: (1, False, False), 2: (2, False, False), 3: (1, False, False), 4: (2, False, True),
                               5: (3, True, False), 6: (4, True, False), 7: (5, True, False)}
    master = df.selectExpr("seq", "array('f') AS data_quality_flags")
    flags = {r.seq: r.data_quality_flags for r in fam.with_family(master, similar.assignments).collect()}
    assert flags[4] == ["f", "similar_title_parent"] and flags[5] == ["f", "missing_us_parent"] and flags[3] == ["f"]
