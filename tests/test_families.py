"""Numbering, sliced joins and families against plain-Python models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from masterloom.operators import families as fam
from masterloom.operators.numbering import with_dense_number
from masterloom.operators.skew import sliced_join
from masterloom.session import written

RECORD = "seq long, id string, normalized_number string, country string, title string, title_key string, has_curated boolean"


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_dense_number(spark, bits):
    rng = random.Random(bits)
    seqs = rng.sample(range(5000), 700) + [(2 << 60) + s for s in rng.sample(range(300), 100)]
    rng.shuffle(seqs)
    got = with_dense_number(spark.createDataFrame([(s,) for s in seqs], "seq long"), "seq", "n", bits).collect()
    assert {r.seq: r.n for r in got} == {s: i + 1 for i, s in enumerate(sorted(seqs))}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_sliced_join(spark, how):
    rng = random.Random(5)
    left = [(i, rng.choice(["hot", "hot", f"k{rng.randrange(40)}", None])) for i in range(900)]
    right = [(f"k{i}", i) for i in range(0, 40, 2)] + [("hot", -1), ("hot", -2), (None, 7)]
    ldf, rdf = spark.createDataFrame(left, "i long, k string"), spark.createDataFrame(right, "k string, v long")
    got = sorted(map(tuple, sliced_join(ldf, rdf, "k", "i", how, slice_rows=50).select("i", "k", "v").collect()), key=str)
    assert got == sorted(map(tuple, ldf.join(rdf, "k", how).select("i", "k", "v").collect()), key=str)
    spread = sliced_join(ldf.where("k = 'hot'"), rdf, "k", "i", how, slice_rows=50)
    assert spread.count() == 2 * sum(k == "hot" for _, k in left)


def model(records):
    families, claims, place = {}, {}, {}
    home = [r for r in records if r["country"] in (None, "US")]
    away = [r for r in records if r["country"] not in (None, "US")]
    for r in home:
        no = len(families) + 1
        families[no] = {"members": [r], "orphan": False}
        if r["title_key"]:
            claims.setdefault(r["title_key"], no)
    for r in away:
        no = claims.get(r["title_key"]) if r["has_curated"] and r["title_key"] else None
        if no:
            families[no]["members"].append(r)
        else:
            families[len(families) + 1] = {"members": [r], "orphan": True}
    return families


def random_records(n):
    rng = random.Random(n)
    seqs = sorted(rng.sample(range(4 * n), n // 2)) + [(2 << 60) + s for s in sorted(rng.sample(range(4 * n), n // 2))]
    rows = []
    for s in seqs:
        title = rng.choice(["flush valve", "flush valve", f"t {rng.randrange(n // 8)}", None])
        rows.append(dict(seq=s, id=f"id{s}", normalized_number=rng.choice([None, f"n{s}"]), country=rng.choice(["US", None, "DE", "FR", "DE"]),
                         title=title, title_key=title, has_curated=s < 1 << 60))
    return rows


def test_families_match_model(spark):
    rows = random_records(400)
    want = model(rows)
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    df = written(spark.createDataFrame([tuple(r[c] for c in ("seq", "id", "normalized_number", "country", "title", "title_key", "has_curated")) for r in shuffled], RECORD), "records")
    built = fam.build_families(df, block_bits=4, slice_rows=10)
    got = {r.family_no: r for r in built.families.collect()}
    assert set(got) == set(want)
    for no, f in want.items():
        countries = list(dict.fromkeys(m["country"] for m in f["members"] if m["country"]))
        head = f["members"][0]
        row = got[no]
        assert (row.family_id, row.parent_id, row.parent_number, row.parent_title) == (
            f"FAM-{no:05d}", head["id"], head["normalized_number"], head["title"])
        assert (row.member_count, row.countries, row.orphan, row.oversized) == (
            len(f["members"]), countries, f["orphan"], len(f["members"]) > 20)
    assert max(len(f["members"]) for f in want.values()) > 20
    placed = {r.seq: r for r in built.assignments.collect()}
    for no, f in want.items():
        for i, m in enumerate(f["members"]):
            assert (placed[m["seq"]].family_no, placed[m["seq"]].is_parent, placed[m["seq"]].family_size) == (no, i == 0, len(f["members"]))


def test_no_cross_join_and_no_global_window(spark):
    df = written(spark.createDataFrame([(1, "a", "n", "US", "t", "t", True)], RECORD), "records")
    built = fam.build_families(df)
    plan = built.assignments._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)


def test_family_number_past_five_digits(spark):
    df = spark.createDataFrame([(7,), (123456,)], "n long")
    assert sorted(r[0] for r in df.select(fam.family_id(F.col("n"))).collect()) == ["FAM-00007", "FAM-123456"]


def test_members(spark):
    from workload.queries import mastered
    m = mastered(spark, "/root/testdata/sf0.001").master
    rows = m.collect()
    by_family = {}
    for r in sorted(rows, key=lambda r: (not r.is_parent, r.seq)):
        by_family.setdefault(r.family_no, []).append(r)
    lists = {}
    for r in sorted(fam.member_lists(m, chunk_bits=3).collect(), key=lambda r: (r.family_no, r.chunk)):
        assert len(r.members) <= 8
        lists.setdefault(r.family_no, []).extend((x.id, x.normalized_number, x.country, x.status) for x in r.members)
    assert lists == {no: [(o.id, o.normalized_number, o.country, o.status.value) for o in members] for no, members in by_family.items()}
    sizes = {len(members) for members in by_family.values()}
    assert max(sizes) > 5 and 1 in sizes
    chunks = {}
    for r in sorted(fam.member_chunks(m, chunk_bits=5).collect(), key=lambda r: (r.family_no, r.chunk)):
        chunks.setdefault(r.family_no, []).extend(r.member_ids)
    assert chunks == {no: [r.id for r in members] for no, members in by_family.items()}
    one = next(r for r in rows if r.family_size > 5)
    asked = spark.createDataFrame([(one.id,)], "id string")
    assert {r.id for r in fam.siblings(m, asked, slice_rows=3).collect()} == {r.id for r in by_family[one.family_no]} - {one.id}


def test_records_that_share_an_id(spark):
    rows = [(1, 7, "x", True), (2, 7, "x", False), (3, 7, "y", False)]
    df = spark.createDataFrame(rows, "seq long, family_no long, id string, is_parent boolean").selectExpr(
        "*", "'F' AS family_id", "'n' AS normalized_number", "'US' AS country", "named_struct('value', 'active') AS status",
        "named_struct('value', DATE '2000-01-01') AS filing_date", "named_struct('value', DATE '2000-01-01') AS grant_date", "3L AS family_size")
    found = fam.siblings(df, df.where("id = 'x'")).select("of_id", "seq").collect()
    assert sorted(tuple(r) for r in found) == [("x", 1), ("x", 2), ("x", 3), ("x", 3)]
    assert [tuple(r) for r in fam.id_collisions(df).collect()] == [("x", 2)]
