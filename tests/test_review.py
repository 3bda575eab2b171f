import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import review as V
from tallyfold.plans import catalog
from tallyfold.plans import review as queries
from tallyfold.sources.exports import as_records
from tallyfold.sources.workbooks import read_export

SF = "/root/testdata/sf0.001"
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_workbook(spark, tmp_path):
    cell = lambda r, t: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
    sheet = f'<worksheet {NS}><sheetData><row>{cell("A1", "Export")}</row><row>{cell("A2", " Full Name ")}<c r="B2" t="s"><v>0</v></c></row><row>{cell("A3", "Asha")}<c r="B3"><v>45000</v></c></row><row><c r="B4"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "crm.XLSX", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/no.xml"/><Relationship Id="r2" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Joi</t><t>ned</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", sheet)
    rows = read_export(spark, str(tmp_path / "crm.XLSX")).orderBy("_row_ord")
    assert [(r["header"], r["cells"], r["native"]) for r in rows.collect()] == [(["Full Name", "Joined"], ["Asha", "45000"], [False, True]), (["Full Name", "Joined"], [None, "7"], [False, True])]
    assert [tuple(r) for r in as_records(rows, {"Joined": "hire_date"}).select("hire_date").collect()] == [("45000",), ("7",)]
    with pytest.raises(ValueError):
        read_export(spark, "x.parquet")


def test_fixed_cases(spark):
    df = spark.createDataFrame([("2m59.5s",), ("350ms",), ("1h2m",), ("soon",), ("",), (None,)], "d string")
    assert [r[0] for r in df.select(V.duration_seconds(F.col("d"))).collect()] == [179.5, 0.35, 3720.0, None, None, None]
    before = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k long, v string, at long")
    new = spark.createDataFrame([(1, "n", 1), (2, "n", 4), (3, "n", 9), (3, "m", 9)], "k long, v string, at long")
    assert sorted(r["k"] for r in V.upsert(before, new, ["k"], "at").collect()) == [1, 2, 3]
    assert {r["k"]: r["v"] for r in V.upsert(before, new.where("k < 3"), ["k"], "at").collect()} == {1: "n", 2: "b"}
    assert {r["k"]: r["v"] for r in V.insert_new(before, new, ["k"]).collect()} == {1: "a", 2: "b", 3: "m"}
    asked = spark.createDataFrame([(1, "R1"), (2, "R2"), (2, "R2")], "k long, rule string")
    failing = spark.createDataFrame([(2, "R2"), (3, "R3")], "k long, rule string")
    assert sorted(map(tuple, V.requestion(asked, failing, ["k", "rule"]).collect())) == [(1, "R1", "superseded"), (2, "R2", "stays"), (3, "R3", "new")]


@pytest.mark.parametrize("name", [n for n, f in catalog.QUERIES.items() if f.__module__ == queries.__name__])
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "events", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    cols = sorted(want.columns)
    plain = lambda rows: sorted(repr([round(float(x), 6) if x is not None and not isinstance(x, (str, bool)) else x for x in r]) for r in rows)
    assert plain(want.select(*cols).fetchall()) == plain(map(tuple, catalog.QUERIES[name](spark, SF).select(*cols).collect()))
