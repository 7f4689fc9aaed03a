import random
import unicodedata
from datetime import date

from pyspark.sql import functions as F

from masterloom.functions import display, text
from masterloom.functions.decomposition import nfkd


def values(spark, inputs, make, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_clean(spark):
    inputs = [" a b ", " x\x1f", "", "  ", "NaN", " NaT", "none ", "None!", "nano", None]
    assert values(spark, inputs, text.clean) == ["a b", "x", None, None, None, None, None, "None!", "nano", None]


def test_dates(spark):
    inputs = ["2001-02-03", "2/3/2001", "25/12/2001", "2001-02-03 00:00:00", "2001/2/3", "20010203", "Feb 3, 2001",
              "February 3, 2001", "3 Feb 2001", "soon", "13/13/2001", "2001-02-30", None, "5", "May 3, 2001", "2/3/01", "2/3/99"]
    d = date(2001, 2, 3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, d string")
    got = [r.d for r in text.with_clean(df, [], ["d"]).orderBy("i").collect()]
    assert got == [d, d, date(2001, 12, 25), d, d, d, d, d, d, None, None, None, None, None, date(2001, 5, 3), d, date(1999, 2, 3)]


def test_typed_dates_pass(spark):
    df = spark.createDataFrame([(date(2001, 2, 3),)], "d date")
    assert text.with_clean(df, [], ["d"]).first().d == date(2001, 2, 3)


def test_absent_column_is_null(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert text.with_clean(df, ["a", "b"], ["d"]).select("a", "b", "d").first() == ("x", None, None)


def test_names_and_titles(spark):
    assert values(spark, ["a, b,, c ", None, " , "], text.split_names) == [["a", "b", "c"], [], []]
    assert values(spark, ["Flush-Valve  (new)", "--", None, "A1"], text.title_key) == ["flush valve new", None, None, "a1"]


def test_display(spark):
    assert values(spark, ["Sink/IOT", "Faucet", "/ A / / B/C", ""], lambda c: F.to_json(display.split_line(c))) == [
        '{"primary":"Sink","secondary":["IOT"]}', '{"primary":"Faucet","secondary":[]}',
        '{"primary":"A","secondary":["B","C"]}', '{"secondary":[]}']
    assert values(spark, ["active", "dead", "x", None], display.status_label) == ["Active", "Dead", "Unknown", "Unknown"]
    lists = [["a"], ["a", "b", "c"], ["a", "b", "c", "d", "e"], []]
    assert values(spark, lists, display.short_list, "v array<string>") == ["a", "a, b, c", "a, b, c +2", ""]
    dates = [date(1999, 3, 7), None]
    assert values(spark, dates, display.format_date, "v date") == ["Mar 7, 1999", "—"]
    assert values(spark, dates, display.decade, "v date") == ["1990s", None]
    link = values(spark, ["CN Z(1)'*!~/é"], lambda c: display.external_link(F.lit(None).cast("string"), c))
    assert link == ["https://patents.google.com/patent/CN%20Z(1)'*!~%2F%C3%A9"]


def test_decomposition_of_all_characters(spark):
    """Every character alone, and random runs of marks and characters that decompose."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    rng = random.Random(6)
    marks = [c for c in chars if unicodedata.combining(c)]
    hard = [c for c in chars if unicodedata.normalize("NFKD", c) != c]
    texts = ["\n".join(chars[k:k + 60]) for k in range(0, len(chars), 60)]
    texts += ["".join(rng.choice([rng.choice(marks), rng.choice(marks), rng.choice(hard), "a"]) for _ in range(12)) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string").select("t", nfkd(F.col("t")).alias("plain")).collect()
    assert [r.t for r in rows if r.plain != (None if r.t is None else unicodedata.normalize("NFKD", r.t))] == []


def test_normalisation_stays_out_of_python(spark):
    from masterloom.operators.normalize import normalize_bulk, normalize_curated

    row = spark.createDataFrame([(1, "ＥＰ１２３é")], "row_index long, number string")
    for df in (normalize_bulk(row), normalize_curated(row)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert normalize_bulk(row).first().normalized_number.startswith("EP123")
