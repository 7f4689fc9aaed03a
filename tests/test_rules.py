"""Number, status and owner rules."""

import uuid

import pytest
from pyspark.sql import functions as F

from masterloom.functions import fixed_values as fv
from masterloom.functions.decomposition import _tables
from masterloom.functions.identifiers import stable_id, with_number
from masterloom.functions.rules import with_owner, with_status

# --- fixed values: number cases (raw, number, type, placeholder) ---------------

NUMBERS = [
    ("7320146", "US7320146", "utility", False),
    ("US 11828449 B2", "US11828449", "utility", False),
    ("US11907242B2", "US11907242", "utility", False),
    ("US-6019131-A", "US6019131", "utility", False),
    ("US-977562-A", "US977562", "utility", False),
    ("D644719", "USD644719", "design", False),
    ("D1105354", "USD1105354", "design", False),
    ("USD844750S1", "USD844750", "design", False),
    ("USD424169S", "USD424169", "design", False),
    ("RE45373", "USRE45373", "reissue", False),
    ("US20240328133A1", "US20240328133A1", "publication", False),
    ("US20250103607A1", "US20250103607A1", "publication", False),
    ("PRO", None, "provisional", True),
    ("ORD", None, "nonprovisional_filed", True),
    ("CON", None, "continuation", True),
    ("D", None, "design_placeholder", True),
    ("AR11160881", "AR11160881", "foreign", False),
    ("AU2007217354", "AU2007217354", "foreign", False),
    ("AU2018285022C1", "AU2018285022", "foreign", False),
    ("WO2024049848A1", "WO2024049848", "foreign", False),
    ("WO 2021/250645", "WO2021250645", "foreign", False),
    ("EP3009202", "EP3009202", "foreign", False),
    ("CA2846529", "CA2846529", "foreign", False),
    (None, None, "unknown", True),
    ("nan", None, "unknown", True),
    ("", None, "unknown", True),
]

# --- fixed values: status cases (raw, status) ----------------------------------

STATUSES = [
    ("Granted", "active"),
    ("granted", "active"),
    ("Active", "active"),
    ("Active - Reinstated", "active"),
    ("Pending", "pending"),
    ("Published", "pending"),
    ("Filed", "pending"),
    ("Allowed", "pending"),
    ("Unfiled", "pending"),
    ("Expired", "expired"),
    ("Expired - Lifetime", "expired"),
    ("Expired - Fee Related", "expired"),
    ("Abandoned", "dead"),
    ("Withdrawn", "dead"),
    ("Ceased", "dead"),
    ("Not-in-force", "dead"),
    (None, "unknown"),
    ("nan", "unknown"),
]

# --- fixed values: owner cases (raw, name, confirmed) --------------------------

OWNERS = [
    ("Sloan Valve Co", "Sloan Valve Company", True),
    ("Sloan Valve Company", "Sloan Valve Company", True),
    ("SOLAN VALVE Co", "Sloan Valve Company", True),
    ("Sloan Water Technology Ltd", "Sloan Water Technology", True),
    ("Stone And Steel Systems LLC", "Stone And Steel Systems", True),
    ("Arichell Technologies, Inc.", "Arichell Technologies", True),
    ("Recurrent Solutions LP", "Recurrent Solutions", True),
    ("Bauer Industries, Inc.", "Bauer Industries, Inc.", False),
    ("Mitsubishi Electric Corp", "Mitsubishi Electric Corp", False),
    (None, None, False),
]

# (raw, hint, number, country, type, placeholder)
HINTED = [
    ("5452", "AE", "AE5452", "AE", "foreign", False),
    ("US123456", "DE", "DE123456", "DE", "foreign", False),
    ("US", "DE", "DEUS", "DE", "foreign", False),
    ("D123", "FR", "USD123", "US", "design", False),
    ("RE123", "FR", "USRE123", "US", "reissue", False),
    ("ZL201630470916.3", "CN", "CNZL201630470916.3", "CN", "foreign", False),
    ("298563-001", "IN", "IN298563001", "IN", "foreign", False),
    ("7320146B2", None, "US7320146B2", "US", "utility", False),
    ("7320146", "US", "US7320146", "US", "utility", False),
    ("US1234P2", None, "US1234", "US", "utility", False),
    ("US1234P3", None, "US12343", "US", "utility", False),
    ("US12AB2", None, "US12", "US", "utility", False),
    ("USABC", None, "USAB", "US", "foreign", False),
    ("EPA1", None, "EPA1", None, "unknown", False),
    ("EPA1", "JP", "JPEPA1", "JP", "foreign", False),
    ("ABC", None, "ABC", None, "unknown", False),
    ("USREX", None, "USRE", "US", "foreign", False),
    ("RE", None, "RE", None, "unknown", False),
    ("US20240328133", None, "US20240328133A1", "US", "publication", False),
    (" pro ", "DE", None, "US", "provisional", True),
    (" - / ", "DE", None, None, "unknown", True),
    (" EP 1 ", None, "EP1", "EP", "foreign", False),
    ("ＵＳ１２", None, "US12", "US", "utility", False),
    ("CN1876976.3", None, "CN1876976.3", "CN", "foreign", False),
    ("1.5", None, "US1.5", "US", "utility", False),
]


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)


def test_number_cases(spark):
    df = with_number(frame(spark, [(r[0],) for r in NUMBERS], "raw string"), F.col("raw"), prefix="n_")
    got = [tuple(r) for r in df.orderBy("i").select("n_normalized_number", "n_patent_type", "n_is_placeholder").collect()]
    assert got == [r[1:] for r in NUMBERS]


@pytest.mark.parametrize("exact", [False, True])
def test_number_with_hint(spark, exact):
    df = frame(spark, [r[:2] for r in HINTED], "raw string, hint string")
    df = with_number(df, F.col("raw"), F.col("hint"), "n_", exact_unicode=exact)
    got = df.orderBy("i").select("n_normalized_number", "n_country", "n_patent_type", "n_is_placeholder").collect()
    for row, case in zip(got, HINTED):
        assert tuple(row) == case[2:], case


def test_exact_unicode_decomposes(spark):
    df = with_number(frame(spark, [("№ 12",), ("12",)], "raw string"), F.col("raw"), prefix="n_")
    assert [r.n_normalized_number for r in df.orderBy("i").collect()] == ["NO12", "US12"]


def test_number_filter_stays_above(spark):
    def plan(exact):
        df = with_number(frame(spark, [("EP1",)], "raw string"), F.col("raw"), prefix="n_", exact_unicode=exact).where("n_country = 'EP'")
        assert df.count() == 1
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert len(plan(False)) < 20_000
    # The tables of the exact form stand in the plan once.
    assert plan(True).count("translate(") == 1 and len(plan(True)) < 20_000 + 3 * sum(map(len, _tables().values()))


def test_status_cases(spark):
    df = with_status(frame(spark, [(r[0],) for r in STATUSES], "raw string"), "s", F.col("raw"), F.lit(False))
    assert [r[0] for r in df.orderBy("i").select("s.value").collect()] == [r[1] for r in STATUSES]


def test_status_of_placeholder_and_tags(spark):
    rows = [(raw, ph) for raw in [*fv.STATUS_RULES, None] for ph in (True, False)]
    df = with_status(frame(spark, rows, "raw string, ph boolean"), "s", F.col("raw"), F.col("ph"))
    for row in df.collect():
        want = ("pending", "pre_publication") if row.ph else fv.STATUS_RULES.get(row.raw, ("unknown", None))
        assert (row.s.value, row.s.sub_tag, row.s.raw) == (*want, row.raw)


def test_owner_cases(spark):
    df = with_owner(frame(spark, [(r[0],) for r in OWNERS], "raw string"), "o", F.col("raw"))
    got = [tuple(r) for r in df.orderBy("i").select("o.normalized", "o.is_confirmed_owner").collect()]
    assert got == [r[1:] for r in OWNERS]


def test_owner_order_review_and_own_rules(spark):
    rows = [("x Haldex Midland Brake",), ("Sloan Transportation / Recurrent Solutions",), ("mysloan valve",), (" ",)]
    df = with_owner(frame(spark, rows, "raw string"), "o", F.col("raw")).orderBy("i")
    got = [tuple(r) for r in df.select("o.normalized", "o.is_confirmed_owner", "o.needs_review", "o.known_non_owner").collect()]
    assert got == [
        ("x Haldex Midland Brake", False, True, True),
        ("Sloan Transportation Products", False, True, False),
        ("mysloan valve", False, True, False),
        (None, False, True, False),
    ]
    own = with_owner(frame(spark, [("acme",)], "raw string"), "o", F.col("raw"), rules=[("^ac", "Acme", True)], non_owners=[])
    assert own.select("o.normalized").first()[0] == "Acme"


def test_stable_id(spark):
    seeds = ["US7320146", "NA-NO_NUMBER-3", "CN-ZLé-1"]
    got = [r[0] for r in frame(spark, [(s,) for s in seeds], "s string").orderBy("i").select(stable_id(F.col("s"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, fv.ID_SEED_PREFIX + s)) for s in seeds]
    assert got[0] == "c2a2f280-2271-5a8a-bd77-b524a169c645"
