"""Search against an exact approximate-substring computation; table view."""

import math
import random

from pyspark.sql import functions as F

from masterloom.functions import fixed_values as fv
from masterloom.operators import pages
from masterloom.operators import search as s
from masterloom.operators import view
from masterloom.plans.view import view as table_view

ROW = ("seq long, title string, normalized_number string, raw_number string, inventors array<string>, product_line string, "
       "model string, assignee string, status string, country string, filing_date date, patent_type string")


def substring_errors(pattern, text):
    """Fewest edits between the pattern and any substring of the text."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for ch in text:
        above, column[0] = column[0], 0
        for i, p in enumerate(pattern, 1):
            above, column[i] = column[i], min(above + (p != ch), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def rows(n=250):
    rng = random.Random(3)
    words = ["Flush", "valve", "sensor", "faucet", "automatic", "hand", "dryer", "vlave", "sens0r", "water"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    return [(i, rng.choice([None, "", text(4)]), f"US{rng.randrange(10**7)}", None, rng.choice([None, [], ["Ann Lee", text(1)]]),
             rng.choice([None, "Faucet"]), None, "Owner", "active", rng.choice(["US", None, "DE"]), None, "utility") for i in range(n)]


def test_pieces_are_a_necessary_condition():
    for n in range(1, 33):
        chunk = "abcdefghijklmnopqrstuvwxyz012345"[:n]
        edits = math.floor(fv.SEARCH_THRESHOLD * n)
        parts = s.pieces(chunk, edits)
        assert "".join(parts) == chunk and len(parts) == edits + 1


def test_fewest_errors_at_any_length():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [text(rng.randrange(0, 90)) for _ in range(60)] + ["", "a" * 500]
    for n in (1, 5, 31, 32, 33, 34, 70):
        query = text(n)
        assert s.fewest_errors(texts, query).tolist() == [substring_errors(query, t) for t in texts]


def test_search_is_exact(spark):
    data = rows()
    df = spark.createDataFrame(data, ROW)
    queries = ["valve", "flsh valv", "automtic sensr", "US12", "ann le", "x", "zz", "hand dryer water faucet automatic sensor", "VLAVE  "]
    for query in queries:
        wanted, edits = query.lower(), math.floor(fv.SEARCH_THRESHOLD * len(query))

        def hits(r):
            fields = [r[1], r[2], r[3], *(r[4] or []), r[5], r[6], r[7]]
            return any(f is not None and substring_errors(wanted, f.lower()) <= edits for f in fields)

        assert {r.seq for r in s.search(df, query).select("seq").collect()} == {r[0] for r in data if hits(r)}, query
        ranked = s.search(df, query, ranked=True).collect()
        assert all(0 <= r["rank"] <= fv.SEARCH_THRESHOLD for r in ranked)


def test_blank_query_matches_all(spark):
    df = spark.createDataFrame(rows(20), ROW)
    assert s.search(df, "  ").count() == 20


def test_facets_sorting_paging(spark):
    df = spark.createDataFrame(rows(130), ROW)
    got = table_view(df, countries=("US",), sort_key="title", descending=False).collect()
    assert [r.seq for r in got] == [r[0] for r in sorted((r for r in rows(130) if r[9] == "US"), key=lambda r: (r[1] or "", r[0]))]
    down = view.sorted_rows(df, "country", descending=True)
    order = [r[0] for r in sorted(sorted(rows(130), key=lambda r: r[0]), key=lambda r: r[9] or "", reverse=True)]
    assert [r.seq for r in down.collect()] == order
    assert [r.seq for r in view.page(down, 2).collect()] == order[100:150]
    assert tuple(view.page_count(df).first()) == (130, 3) and tuple(view.page_count(df.limit(0)).first()) == (0, 1)
    assert view.filtered(df, product_lines=("Faucet",)).where("product_line IS NULL").count() == 0
    plan = view.page(down, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_keyset_pages_are_the_pages(spark):
    df = spark.createDataFrame(rows(130), ROW)
    for key, down in (("country", True), ("title", False)):
        ordered = view.sorted_rows(df, key, down)
        value, seq, seen = None, None, []
        while page := view.page_after(df, value, seq, key, down).collect():
            seen += [r.seq for r in page]
            value, seq = page[-1][key], page[-1].seq
        assert seen == [r.seq for r in ordered.collect()]


def test_pages_by_number_are_the_pages(spark):
    df = spark.createDataFrame(rows(330), ROW).repartition(5)
    for key, down, size in (("country", True, 50), ("title", False, 7)):
        ordered = [r.seq for r in view.sorted_rows(df, key, down).collect()]
        bounds = pages.page_bounds(df, key, down, range_rows=20).cache()
        assert sorted(r.before for r in bounds.collect()) == list(range(0, 330, 20))
        assert {r.before: r.seq for r in bounds.collect()} == {i: ordered[i] for i in range(0, 330, 20)}
        for number in (0, 1, 5, 330 // size, 1000):
            got = pages.page_by_number(df, bounds, number, key, down, size)
            assert [r.seq for r in got.collect()] == ordered[number * size:(number + 1) * size]
    none = df.limit(0)
    assert pages.page_by_number(none, pages.page_bounds(none), 0).count() == 0
