"""Pairs and clusters against all pairs of every block, on records that reach every tier of the similarity."""

import random

from pyspark.sql import functions as F

from tallyfold.functions.fuzzy import blocking_key, similarity
from tallyfold.operators import pairs as P
from tallyfold.operators import records as R

SCHEMA = "id long, employee_id string, first_name string, last_name string, work_email string, phone string, date_of_birth string, block string, value string"


def people(n=260, seed=3):
    rng = random.Random(seed)
    pick = lambda xs: rng.choice(xs)
    rows = []
    for i in range(n):
        key = pick(["", "", None, "E1", "E12", "E123", "e1", "F7", f"G{i % 9}"])
        first, last = pick(["asha", "Ash", "aisha", " ravi ", "", None]), pick(["sharma", "Sharmaa", "sharmas", "sherma", "", None])
        mail = pick(["", None, "", "ravi1@x.com", "ravi12@x.com", "ravi123@y.com", "RAVI1@z.com", "ravi@x.com", "@x", "ravis9@x.com"])
        phone = pick(["", None, "", "+919876543210", "+919876543211", "+919876543299", "+918876543210"])
        born = pick(["", None, "1990-01-01", "1991-01-01"])
        rows.append((i, key, first, last, mail, phone, born, "x", "y"))
    rows += [(n + k, *r[1:]) for k, r in enumerate(rows[:40])]  # copies
    return rows


def brute(df):
    whole = F.struct("employee_id", "first_name", "last_name", "work_email", "phone", "date_of_birth")
    side = df.select("id", whole.alias("p"), blocking_key(F.col("work_email"), F.col("first_name"), F.col("last_name"), F.col("phone")).alias("b"))
    both = side.select(F.col("id").alias("a_id"), F.col("p").alias("a"), F.col("b").alias("block")).join(side.select(F.col("id").alias("b_id"), F.col("p").alias("q"), F.col("b").alias("block")), "block")
    rows = both.where("a_id < b_id").withColumnRenamed("q", "b").select("a_id", "b_id", similarity("a", "b").alias("score")).where("score > 0").collect()
    return {(r["a_id"], r["b_id"]): round(r["score"], 9) for r in rows}


def parts(nodes, edges):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def test_pairs(spark):
    rows = people()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(df)
    identity = lambda r: tuple((x or "").strip().lower() for x in r[1:7])
    first = {}
    for r in rows:
        first.setdefault(identity(r), r[0])
    copy = {r[0]: first[identity(r)] for r in rows}
    listed = {p: s for p, s in want.items() if all(copy[x] == x for x in p) or copy[p[1]] == p[0]}
    for chunk in (2_000, 1):
        got = {(r["a_id"], r["b_id"]): round(r["score"], 9) for r in P.candidate_pairs(df, chunk=chunk).collect()}
        assert got == listed
    tiers = {s for s in listed.values()}
    assert {1.0, 0.85} < tiers and any(0 < s < 0.85 for s in tiers)
    for above in (0.9, 0.8):
        edges = [(r["src"], r["dst"]) for r in P.merge_edges(df, above).collect()]
        ids = [r[0] for r in rows]
        assert parts(ids, edges) == parts(ids, [p for p, s in want.items() if s >= above])
    assert P.candidate_pairs(df.limit(0)).count() == 0 == P.merge_edges(df.limit(0), 0.9).count()


def test_every_copy(spark, monkeypatch):
    rows = people(120) + [(900 + k, "", "asha", "iyer", "", f"+91987654321{k % 3}", "") + ("x", "y") for k in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(df)
    for few, most in ((P._FEW, P._LIST), (1, 2)):  # values of more identities, identities of more copies than a row holds
        monkeypatch.setattr(P, "_FEW", few)
        monkeypatch.setattr(P, "_LIST", most)
        pairs = P.candidate_pairs(df, every_copy=True)
        got = [(r["a_id"], r["b_id"], round(r["score"], 9)) for r in pairs.collect()]
        assert len(got) == len(set(got)) and {(a, b): s for a, b, s in got} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]  # what becomes pairs of copies is not dealt out again


def test_cluster_chain(spark):
    rows = [(0, "K1", "a", "b", "", "", ""), (1, "K1", "", "", "lena77@x.com", "", ""), (2, "", "", "", "lena77@y.com", "", ""), (3, "K9", "", "", "", "+919876543210", ""), (4, "", "", "", "", "+919876543210", ""), (5, "Z", "q", "r", "", "", "")]
    df = spark.createDataFrame(rows, "id long, employee_id string, first_name string, last_name string, work_email string, phone string, date_of_birth string")
    found = lambda **kw: {r["id"]: r["cluster_id"] for r in R.cluster(df, **kw).collect()}
    assert found() == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert found(approved=spark.createDataFrame([(2, 4)], "a_id long, b_id long")) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}
