import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import fuzzy, text, values
from tallyfold.operators import records as R
from tallyfold.operators.graph import connected_components
from tallyfold.operators.pairs import candidate_pairs
from tallyfold.plans import catalog

SF = "/root/testdata/sf0.001"


def test_dates(spark):
    got = {r["v"]: (r["p"]["value"], r["p"]["ambiguous"]) for r in spark.createDataFrame([(x,) for x in ("03/04/2024", "25/12/2024", "12/25/2024", "03-04-2024", "45000", "1700000000", " 3  apr 2024 ", "", "x")], "v string").select("v", values.parse_date(F.col("v")).alias("p")).collect()}
    d = datetime.date
    assert got["03/04/2024"] == (None, True)
    assert got["25/12/2024"] == (d(2024, 12, 25), False)
    assert got["12/25/2024"] == (None, False)
    assert got["03-04-2024"] == (d(2024, 4, 3), False)
    assert got["45000"] == (d(2023, 3, 15), False)
    assert got["1700000000"] == (d(2023, 11, 14), False)
    assert got[" 3  apr 2024 "] == (d(2024, 4, 3), False)
    assert got[""] == got["x"] == (None, False)
    row = spark.range(1).select(*[values.parse_date(F.lit(x))["value"] for x in ("03-APR-2024", "3-apr-2024", "2024-4-3", "2024/04/03")]).first()
    assert set(row) == {d(2024, 4, 3)}


def test_text(spark):
    rows = spark.createDataFrame([(" Ａ\t b ", "+91 (98765) 43210"), ("", "0123"), (None, None)], "s string, p string").select(text.clean_string(F.col("s")), text.clean_phone(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("A b", "+919876543210"), (None, None), (None, None)]


def test_ratio(spark):
    rows = spark.createDataFrame([("smith", "smtih"), ("", ""), ("a", "")], "a string, b string").select(fuzzy.ratio("a", "b")).collect()
    assert [round(r[0], 6) for r in rows] == [0.8, 1.0, 0.0]


def test_numbers_and_enums(spark):
    rows = spark.createDataFrame([("$100",), ("usd 100",), ("€100",), ("USD 9,396",)], "v string").select(values.clean_number(F.col("v")).alias("n")).collect()
    assert [(None if r["n"]["amount"] is None else float(r["n"]["amount"]), r["n"]["currency"]) for r in rows] == [(100.0, "INR"), (None, "USD"), (None, "INR"), (9396.0, "USD")]
    row = spark.createDataFrame([("emale",)], "v string").select(values.coerce_enum(F.col("v"), ("male", "female"))).first()[0]
    assert tuple(row) == ("male", 1, "male")


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    star = [(0, k) for k in range(1, 40)] + [(39, 50), (50, 51), (60, 61)]  # a centre whose edges are dealt out apart
    for hot in (4, 1):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(star, "src long, dst long"), hot=hot).collect()}
        assert got == {**{i: 0 for i in [*range(40), 50, 51]}, 60: 60, 61: 60}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pairs_of_copies(spark):
    rows = [(i, "", "ann", "lee", f"abcde{i % 7}@x.com", "", "") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, employee_id string, first_name string, last_name string, work_email string, phone string, date_of_birth string")
    found = {(r["a_id"], r["b_id"]): r["score"] for r in candidate_pairs(df).collect()}
    copies = {(i % 7, i): 1.0 for i in range(7, 60)}  # each with the first of its kind
    assert found == copies | {(a, b): 0.85 for b in range(7) for a in range(b)}


@pytest.mark.parametrize("name", ["issues_grouped", "parse_date_all", "queue_cards", "components", "map_scores", "push_summary"])
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    cols = sorted(want.columns)
    plain = lambda rows: sorted(repr([round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)
    assert plain(want.select(*cols).fetchall()) == plain(map(tuple, catalog.QUERIES[name](spark, SF).select(*cols).collect()))
