"""Queries against their SQL on keys beyond those of the small tables."""

import duckdb
import pytest

from tallyfold.llm import passages
from tallyfold.llm.simhash import links
from tallyfold.operators.pairs import candidate_pairs, near_values
from tallyfold.plans import catalog, desk  # noqa: F401 (desk adds its queries)


@pytest.mark.parametrize(
    ("name", "keys"),
    [
        ("generator_scalars", [0, 1, 12, 127, 1_263, 12_628, 126_278, 126_279, 899_999, 12_627_857]),  # 1 to 12 digits once multiplied
        ("phone_pairs", [*range(1, 40), *range(75_961, 76_000), *range(151_921, 151_930)]),  # copies come again after 75,960 keys
    ],
)
def test_against_oracle(spark, tmp_path, name, keys):
    con = duckdb.connect()
    con.sql(f"copy (select unnest({keys})::bigint as c_custkey, 'BUILDING' as c_mktsegment) to '{tmp_path}/customer.parquet'")
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    plain = lambda rows: sorted(tuple(float(x) if c == "score" else x for c, x in zip(want.columns, r, strict=True)) for r in rows)
    assert len(got) > 0 and plain(got) == plain(want.fetchall())


def test_no_broadcast_of_variants(spark):
    values = spark.range(50).selectExpr("'b' as block", "concat('sharma', id) as value")  # small, but not its variants
    plan = near_values(values)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_names_of_people_with_phones_are_not_paired(spark):
    fields = "id long, employee_id string, first_name string, last_name string, work_email string, phone string, date_of_birth string"
    rows = [(k, "", "ann", "lee", "", f"+91{(k * 2_654_435_761 + k * k * 9_700_417) % 10**10:010d}" if k else "", "") for k in range(40)]
    got = {(r["a_id"], r["b_id"], r["score"]) for r in candidate_pairs(spark.createDataFrame(rows, fields)).collect()}
    assert got == {(0, k, 1.0) for k in range(1, 40)}  # who has no phone goes by name with all others


def test_no_broadcast_of_fingerprint_variants(spark):
    nodes = spark.range(50).selectExpr("id as fp", "id as node")
    plan = links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_passages_in_parts(spark, monkeypatch):
    docs, found, shuffled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), [], []
    real = passages.materialize
    monkeypatch.setattr(passages, "materialize", lambda df, name: (shuffled.append(name), real(df, name))[1])
    for n in (1, 3):
        monkeypatch.setattr(passages, "_PARTS", n)
        found.append(sorted(map(tuple, passages.repeated_passages(docs).collect())))
    assert len(found[0]) > 10 and found[0] == found[1]
    assert shuffled.count("cut") == shuffled.count("passages") == 4  # one table a part: its shuffles are released before the next
