"""Landing files, publishing a refresh, reading it back."""

import csv
import glob
import zipfile

import pytest
from pyspark.sql import functions as F

from masterloom.operators import view
from masterloom.operators.families import member_lists
from masterloom.operators.normalize import normalize_curated
from masterloom.plans.overview import merge_shape
from masterloom.plans.refresh import refresh
from masterloom.sinks.tables import BOOKKEEPING, export_csv, export_json, seed
from masterloom.sources import landing
from masterloom.sources.published import Published, family_by_id, read_json, record_by_id
from masterloom.sources.workbook import read_workbooks
from workload.frames import bulk_rows, curated_rows

SF = "/root/testdata/sf0.001"


def test_bulk_files_in_order(spark, tmp_path):
    head = "Patent Number, Title ,Abstract,Status\n"
    (tmp_path / "a.csv").write_text(head + 'US1,"two\nlines, ""quoted""",x,\nNA,b,,Active\n')
    (tmp_path / "b.csv").write_text(head + "".join(f"US{i},t{i},,\n" for i in range(2, 30)))
    df = landing.read_bulk(spark, str(tmp_path)).orderBy("row_index")
    rows = df.collect()
    assert [r.row_index for r in rows] == list(range(30))
    assert (rows[0].title, rows[1].number, rows[1].status, rows[2].number) == ('two\nlines, "quoted"', None, "Active", "US2")
    assert rows[29].title == "t29" and rows[0].claims is None and "inventors" in df.columns


def sheet(path, rows):
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v.startswith("#"):
            return f'<c r="{ref}" t="s"><v>{v[1:]}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(r)) + "</row>"
                   for i, r in enumerate(rows, 1) if r)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Gra</t><r><t>nted</t></r></si></sst>")


def test_workbooks(spark, tmp_path):
    head = ["IP Status", "Country", "Product Line ", "Patent/Publication No.", "Filing Date"]
    sheet(tmp_path / "a.xlsx", [head, ["#0", "US", "Sink", 7320146, 36526], [], ["Filed", "DE", None, "12", "soon"]])
    sheet(tmp_path / "b.xlsx", [head, ["Filed", "FR", "Faucet", "PRO", "2001-02-03"]])
    rows = normalize_curated(read_workbooks(spark, str(tmp_path))).orderBy("row_index").collect()
    got = [(r.row_index, r.normalized_number, r.status.value, r.product_line, r.filing_date and r.filing_date.isoformat()) for r in rows]
    # The blank row between the two records takes an ordinal of its own.
    assert got == [(0, "US7320146", "active", "Sink", "2000-01-01"), (2, "DE12", "pending", None, None),
                   (3, "FRPRO", "pending", "Faucet", "2001-02-03")]


def test_workbook_whose_first_tab_is_not_the_first_file(spark, tmp_path):
    head = ["IP Status", "Country", "Product Line ", "Patent/Publication No.", "Filing Date"]
    sheet(tmp_path / "a.xlsx", [head, ["Filed", "XX", None, "1", None]])
    other = tmp_path / "other.xlsx"
    sheet(other, [head, ["Filed", "DE", "N/A", "12", "null"]])
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(other) as z, zipfile.ZipFile(tmp_path / "a.xlsx", "a") as book:
        book.writestr("xl/worksheets/sheet2.xml", z.read("xl/worksheets/sheet1.xml"))
        book.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="' + rel
                      + '"><sheets><sheet name="b" sheetId="2" r:id="r9"/><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
                      '<Relationship Id="r9" Target="worksheets/sheet2.xml"/></Relationships>')
    other.rename(tmp_path / "other.kept")
    (row,) = read_workbooks(spark, str(tmp_path)).collect()
    assert (row.country, row.product_line, row.filing_date, row.number) == ("DE", None, None, "12")


def test_empty_first_sheet(spark, tmp_path):
    sheet(tmp_path / "a.xlsx", [])
    sheet(tmp_path / "b.xlsx", [["Country"], ["FR"]])
    assert [r.country for r in read_workbooks(spark, str(tmp_path)).collect()] == ["FR"]


def test_landing_leaves_texts_in_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Patent Number,Title\nUS1,t\n")
    plan = landing.read_bulk(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    return refresh(spark, curated_rows(spark, SF), bulk_rows(spark, SF), str(tmp_path_factory.mktemp("out")))


def test_refresh_outputs(spark, published):
    master, families = published.master(), published.families()
    assert not set(BOOKKEEPING) & set(master.columns)
    log = published.refresh_log().first()
    assert log.merge.total_records == master.count() and log.merge.families == families.count()
    assert log.exceptions_summary["missing_tech_cluster"] == master.count() and log.errors == []
    assert log.bulk.total_rows >= log.bulk.unique_normalized > 0 and log.bulk.by_country_top10["US"] > 0
    assert tuple(merge_shape(published.refresh_log()).first()) == (log.merge.matched, log.merge.curated_only, log.merge.bulk_only)
    assert published.exceptions().where("category = 'missing_tech_cluster'").count() == master.count()
    assert published.read("owner_rules").count() == 18
    lines, models = published.taxonomy()
    assert lines.count() > 0 and models.count() > 0 and published.read("overrides").count() == 0
    row = master.where("family_id IS NOT NULL").first()
    assert record_by_id(master, row.id).count() == 1 and record_by_id(master, "none").count() == 0
    assert family_by_id(families, row.family_id).count() == 1
    plan = record_by_id(master, row.id)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id," in plan
    assert published.read("family_members").count() == master.count()


def test_refresh_keeps_ids_and_edited_taxonomy(spark, published):
    before = {r.id for r in published.master().select("id").collect()}
    path = published.path("taxonomy_product_lines")
    n = spark.read.parquet(path).count()
    seed(spark.createDataFrame([("x",)], "name string"), path)
    assert spark.read.parquet(path).count() == n and "count" in spark.read.parquet(path).columns
    again = refresh(spark, curated_rows(spark, SF), bulk_rows(spark, SF), published.folder)
    assert {r.id for r in Published(spark, again.folder).master().select("id").collect()} == before


def test_json_round_trip(spark, published, tmp_path):
    full = published.master()
    export_json(full, str(tmp_path / "json"))
    back = read_json(spark, str(tmp_path / "json"), full)
    assert back.schema == full.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, full.collect()))
    lists = published.read("member_lists")
    assert lists.columns == member_lists(published.master()).columns
    assert lists.selectExpr("sum(size(members))").first()[0] == full.count()


def test_csv_export(spark, published, tmp_path):
    rows = spark.createDataFrame(
        [(1, 'a "quoted", title', ["x", "y"], None, True), (2, "two\nlines", [], None, False)],
        "seq long, title string, inventors array<string>, filing_date date, is_confirmed_owner boolean")
    for name in ("id", "normalized_number", "status", "status_sub_tag", "country", "patent_type", "product_line", "model",
                 "assignee", "family_id"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    for name in ("grant_date", "expiration_date"):
        rows = rows.withColumn(name, F.lit(None).cast("date"))
    rows = rows.withColumn("flags", F.array(F.lit("f"), F.lit("g"))).coalesce(1)
    export_csv(rows.orderBy("seq"), str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out" / "part-*.csv"))
    text = open(part, newline="").read()
    assert text.splitlines()[0].startswith("id,patent_number,title,status,sub_status")
    first, second = list(csv.DictReader(open(part, newline="")))
    assert (first["title"], first["inventors"], first["flags"], first["filing_date"], first["confirmed_owner"]) == (
        'a "quoted", title', "x; y", "f; g", "", "true")
    assert second["title"] == "two\nlines" and ',"a ""quoted"", title",' in text and '""' not in text.split("\n")[2]
