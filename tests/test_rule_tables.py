"""Rules as tables against the rules in the plan and plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from masterloom.functions.rules import with_owner, with_status
from masterloom.operators import rule_tables as rt

TEXTS = [None, "", "  ", "nan", "NaN ", "Sloan Valve Company", " SLOAN  VALVE co", "Solan Valve", "William E. Sloan", "E Sloan William",
         "Sloan Transportation Products", "Sloan Water Technology Ltd", "Stone and Steel Systems", "Arichell Technologies Inc",
         "Recurrent Solutions", "Haldex Midland Brake", "Bauer Industries / Sloan Valve", "Tooshlights", "water", "va", "Nobody known"]


def owners(df):
    return {r["i"]: tuple(r["o"]) for r in df.select("i", "o").collect()}


def test_fixed_rules_decide_alike(spark):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS * 3)], "i long, t string, needle string")
    by_table = rt.with_owner_of_table(df, "o", "t", "i", rt.fixed_owner_rules(spark), rt.fixed_non_owners(spark))
    assert by_table.columns == ["i", "t", "needle", "o"]
    assert owners(by_table) == owners(with_owner(df, "o", F.col("t")))


def test_fixed_statuses_decide_alike(spark):
    values = [None, "", "Active", " expired - lifetime ", "Not in force", "what", "GRANTED"]
    df = spark.createDataFrame([(i, t, i % 4 == 0) for i, t in enumerate(values * 4)], "i long, t string, p boolean")
    by_table = rt.with_status_of_table(df, "o", "t", "i", F.col("p"), rt.fixed_status_rules(spark))
    assert owners(by_table) == owners(with_status(df, "o", F.col("t"), F.col("p")))


def test_ten_thousand_rules(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdehlmnoprt") for _ in range(rng.randrange(3, 7)))
    words = [word() for _ in range(3000)]
    rules = []
    for i in range(10_000):
        a, b = rng.choice(words), rng.choice(words)
        kind = i % 3
        rules.append((rng.randrange(1 << 40), a.upper() if kind == 0 else a, None if kind < 2 else rf"\b{a}\s+{b}", f"Owner {i}", i % 2 == 0))
    texts = [" ".join(rng.choice(words) for _ in range(3)).title() for _ in range(300)]
    texts += [f"{r[1]}  {r[2].split('+')[1]}" for r in rules if r[2]][:50] + ["xx", "zzzz qqqq", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = owners(rt.with_owner_of_table(df, "o", "t", "i", spark.createDataFrame(rules, rt.OWNER_SCHEMA), rt.fixed_non_owners(spark)))
    ordered = sorted(rules)
    for i, t in enumerate(texts):
        hit = t and next((r for r in ordered if r[1].lower() in t.lower() and (r[2] is None or re.search(r[2], t, re.I))), None)
        assert got[i][1:3] == ((hit[3], hit[4]) if hit else (t, False)), t
    assert sum(x[1] != t for x, t in zip((got[i] for i in range(len(texts))), texts)) > 100


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([(1, "Sloan Valve")], "i long, t string")

    def size(n):
        rules = spark.range(n).select(F.col("id").alias("priority"), F.concat(F.lit("needle"), "id").alias("needle"), F.lit(None).cast("string").alias("pattern"),
                                      F.lit("x").alias("normalized"), F.lit(True).alias("is_confirmed_owner"))
        out = rt.with_owner_of_table(df, "o", "t", "i", rules, rt.fixed_non_owners(spark))
        return len(re.sub(r"#\d+|[0-9a-f]{32}|\d+", "", out._jdf.queryExecution().optimizedPlan().toString()))

    assert abs(size(10) - size(2000)) < 50


def test_odd_rules(spark):
    df = spark.createDataFrame([(1, "Acme"), (2, None)], "i long, t string")
    none = spark.createDataFrame([], rt.OWNER_SCHEMA)
    names = spark.createDataFrame([("ACME",)], "needle string")
    assert owners(rt.with_owner_of_table(df, "o", "t", "i", none, names)) == {1: ("Acme", "Acme", False, True, True), 2: (None, None, False, True, False)}
    assert rt.with_owner_of_table(df.limit(0), "o", "t", "i", rt.fixed_owner_rules(spark), names).count() == 0
    for bad in ([(1, "ab", None, "x", True)], [(1, "abc", None, "x", True), (1, "abd", None, "y", True)], [(1, None, "p", "x", True)]):
        with pytest.raises(ValueError):
            rt.with_owner_of_table(df, "o", "t", "i", spark.createDataFrame(bad, rt.OWNER_SCHEMA), names)
