"""A run from exports to a delivered data set; sinks; schema and policy documents; small operators at their edges."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyfold import config
from tallyfold.functions import text, values
from tallyfold.operators import delivery as V
from tallyfold.operators import desk as D
from tallyfold.operators import records as R
from tallyfold.plans.lifecycle import Run, run_status
from tallyfold.sources import sinks
from tallyfold.sources.exports import read_csv

SCHEMA = """
version: 1
entity: employee
natural_key: employee_id
fields:
  employee_id: {type: string, required: true, pattern: "^[A-Z0-9-]{3,20}$"}
  work_email: {type: email, required: true, unique: true}
  phone: {type: phone, format: e164, default_region: GB}
  status: {type: enum, values: [a, b], default: a, material: true}
  manager_employee_id: {type: string, references: employee_id}
cross_field_rules:
  - {id: R5, rule: "manager_employee_id != employee_id"}
"""
POLICY = """
version: 1
mapping: {auto_accept_min_confidence: 0.8, ambiguous_top2_margin: 0.1, unmapped_below: 0.5}
values: {auto_accept_min_confidence: 0.8, enum_auto_max_edit_distance: 2, enum_escalate_max_edit_distance: 3}
dates: {accepted_formats: ["%Y-%m-%d", "%d-%b-%Y", excel_serial], escalate_when_multiple_formats_parse_to_different_dates: false}
dedupe: {auto_merge_above: 0.9, escalate_band: [0.72, 0.9], llm_auto_separate_min_confidence: 0.75, llm_judge_max_pairs: 10}
cross_source: {precedence: [crm], escalate_conflicts_only_on_material_fields: true}
push: {max_retries: 2, backoff_base_ms: 100, jitter: true, retry_on: [500], escalate_on: [422], offer_rollback_above_failure_rate: 0.5}
"""


def test_documents():
    schema = config.load_schema(SCHEMA)
    assert (schema.natural_key, schema.rules[0][0], len(schema.fields)) == ("employee_id", "R5", 5)
    assert schema.field("phone").region == "GB" and schema.field("work_email").unique and schema.field("status").default == "a" and schema.field("none") is None
    with pytest.raises(TypeError):
        config.load_schema(SCHEMA.replace("unique: true", "uniq: true"))
    for old, new in (("type: email", "type: e"), ("id: R5", "id: R9"), ("values: [a, b], ", "")):
        with pytest.raises(ValueError):
            config.load_schema(SCHEMA.replace(old, new))
    policy = config.load_policy(POLICY)
    assert policy.date_formats == ("yyyy-M-d", "d-MMM-yyyy") and not policy.ask_dates and policy.retries == 2 and policy.precedence == ("crm",) and policy.judge_most == 10


def test_values(spark):
    row = spark.range(1).select(
        values.clean_number(F.lit("  ")).alias("blank"), values.native_number(F.lit(12.5)).alias("number"), values.native_date(F.lit(45000.7)).alias("day"),
        values.coerce_enum(F.lit("ＡＣＴＩＶＥ"), ("active",)).alias("wide"), values.coerce_enum(F.lit("\tactive\n"), ("active",)).alias("tabs"), values.coerce_enum(F.lit(" "), ("active",)).alias("none"),
        text.local_time(F.lit("2024-03-01T20:00:00+00:00")).alias("t1"), text.local_time(F.lit("2024-03-01T20:00:00")).alias("t2"), text.local_time(F.lit("soon")).alias("t3"), text.local_time(F.lit(None).cast("string")).alias("t4"),
        values.date_readings(F.lit("03/04/2024")).alias("r1"), values.date_readings(F.lit("25/12/2024")).alias("r2"),
    ).first()
    assert tuple(row["blank"]) == (None, "INR") and float(row["number"]["amount"]) == 12.5 and row["day"] == datetime.date(2023, 3, 15)
    assert row["wide"]["value"] == row["tabs"]["value"] == "active" and tuple(row["none"]) == (None, 0, None)
    assert row["t1"] == row["t2"] == "02 Mar 2024, 01:30" and row["t3"] == "soon" and row["t4"] == ""
    assert tuple(row["r1"]) == ("3 April 2024", "4 March 2024") and row["r2"] is None


def test_plans(spark):
    check = D.literal_check(spark)
    field = next(f for f in config.SCHEMA if f.name == "employment_status")
    date = next(f for f in config.SCHEMA if f.name == "hire_date")
    assert D.checked_plan({"action": "set_all", "value": "active"}, field, check)[0]["value"] == "active"
    assert D.checked_plan({"action": "set_all", "value": "gone"}, field, check) == (None, "not an allowed value")
    assert D.checked_plan({"action": "set_all", "value": "18-09-2026"}, date, check)[0]["value"] == "2026-09-18"
    assert D.checked_plan({"action": "set_all", "value": "03/04/2024"}, date, check) == (None, "two different dates")
    assert D.checked_plan({"action": "replace", "replacements": {"x": "active"}}, field, check)[0]["replacements"] == {"x": "active"}
    assert D.checked_plan({"action": "replace", "replacements": {"x": "y"}}, field, check)[0] is None
    assert D.checked_plan({"action": "replace", "replacements": {}}, field, check) == (None, "no replacements were named")
    assert D.checked_plan({"action": "drop"}, field, check)[0] is None and D.checked_plan({}, None, check)[0] is None


def test_field_messages(spark):
    fields = tuple(f for f in config.SCHEMA if f.name in ("employee_id", "work_email", "gender"))
    rows = spark.createDataFrame([("E-1", "a@b.c", None), ("?", "x", "q"), (None, None, None)], "employee_id string, work_email string, gender string")
    got = [[tuple(x) for x in r[0]] for r in rows.select(R.field_messages(fields, strict=True)).collect()]
    assert got[0] == [] and [x[0] for x in got[1]] == ["employee_id", "work_email", "gender"] and got[2] == [("employee_id", "field required"), ("work_email", "field required")]


def test_sinks(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a")], "id long, name string")
    assert sinks.read_table(spark, folder, "records") is None
    sinks.write_stage(rows, folder, "records", "r1", "cleaning")
    sinks.write_stage(rows, folder, "records", "r1", "cleaning")  # again: its own rows are replaced
    sinks.write_stage(rows.withColumn("more", F.lit(2)), folder, "records", "r2", "cleaning")
    got = sinks.read_table(spark, folder, "records")
    assert sorted((r["run_id"], r["more"]) for r in got.collect()) == [("r1", None), ("r2", 2)]
    sinks.write_stage(rows, folder, "llm_cache", "r1", "all")
    assert sinks.truncate_all(spark, folder) == {"records": 2} and sinks.read_table(spark, folder, "llm_cache").count() == 1
    changes = spark.createDataFrame([("e1", "name", 'say "hi", you', None), ("e0", "name", None, "x\ny")], "entity_id string, field string, before string, after string")
    audit = sinks.audit_rows(changes, "human", F.lit("t"), stage="pushed")
    assert tuple(audit.columns) == sinks.AUDIT
    sinks.export_csv(audit, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv" / "*.csv")).orderBy("_row_ord").collect()
    assert tuple(back[0]["header"]) == sinks.AUDIT and back[0]["cells"][5] == "e0" and back[1]["cells"][7] == 'say "hi", you' and back[0]["cells"][8] == "x\ny"
    sinks.export_json(audit, str(tmp_path / "json"), "entity_id")
    lines = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert [x["entity_id"] for x in lines] == ["e0", "e1"] and lines[0]["before"] is None
    frames = sinks.frames(spark.range(50).select(F.col("id").alias("o"), F.lit("tick").alias("kind"), F.lit("s").alias("stage"), F.lit("m").alias("message"), F.create_map(F.lit("k"), F.lit("v")).alias("detail")).repartition(4), "r", 10, "o")
    assert sorted(r["seq"] for r in frames.collect()) == list(range(11, 61))


def test_delivery(spark):
    rows = spark.range(300).select("id", F.lit("E1").alias("e"), F.lit(None).cast("string").alias("n"))
    reply = V.target_reply(F.col("e"), F.col("n"), F.col("n"), F.col("n"), F.lit("1990-01-01"))
    tries = V.attempts(rows, "id", reply, rate_500=0.5, rate_429=0.1)
    by = {}
    for r in tries.orderBy("id", "attempt_number").collect():
        by.setdefault(r["id"], []).append(r["status_code"])
    assert len(by) == 300 and all(c in (500, 429) for x in by.values() for c in x[:-1]) and max(map(len, by.values())) == 5
    assert all(x[-1] == 200 for x in by.values() if len(x) < 5)
    assert V.attempts(rows.limit(0), "id", reply).count() == 0
    left, gone = V.rolled_back(rows, tries, "id")
    assert left.count() + gone.count() == 300


def _exports(spark):
    hris = [(f"E-{k:03}", f"ann{k}", "lee", f"person{k}@x.com", "2020-01-05", "active", "full_time", "Ops", "Director", "1990-02-03", "CC-100") for k in range(30)]
    hris[3] = (*hris[3][:5], "Activ", *hris[3][6:])
    hris[4] = (*hris[4][:5], "terminated", *hris[4][6:])  # without a date
    hris[5] = (*hris[5][:10], "CC-999")
    names = "employee_id first_name last_name work_email hire_date employment_status employment_type department designation date_of_birth cost_center"
    crm = [("", "ann7", "lee", "person7@y.com", "Sales"), ("", "zoe", "kay", "zoe@x.com", "Ops")]
    return {
        "legacy_hris.csv": spark.createDataFrame(hris, ", ".join(f"{n} string" for n in names.split())),
        "crm_contacts.csv": spark.createDataFrame(crm, "employee_id string, first_name string, last_name string, work_email string, dept string"),
    }


def test_run(spark, tmp_path):
    run = Run(spark, str(tmp_path / "store"), "r1")
    asked = run.import_(_exports(spark)).collect()
    assert [(r["reason_code"], r["scope_key"]) for r in asked] == [("MAP_AMBIGUOUS", "crm_contacts.csv:dept")] or {r["scope_key"] for r in asked} == {"crm_contacts.csv:dept"}
    with pytest.raises(RuntimeError):
        run.resume()
    answers = spark.createDataFrame([(r["signature"], "edit", "department") for r in asked], "signature string, action string, value string")
    questions = {(r["reason_code"], r["scope_key"]): r["rows_affected"] for r in run.resume(answers).collect()}
    assert questions[("LOGIC_CONTRADICTION", "record:R2")] == 1
    assert questions[("CONFLICT_ACROSS_SOURCES", "department:crm_contacts.csv|legacy_hris.csv")] == 1
    assert run.table("merges").count() == 1
    people = run.survivors()
    assert people.count() == 31 and people.where("blocked").count() == 1
    counts = run.push().first()
    assert (counts["created"], counts["incomplete"], counts["pushed"], counts["rejected"]) == (29, 1, 28, 1) and not counts["offer_rollback"]
    again = Run(spark, str(tmp_path / "store"), "r2")
    again.import_(_exports(spark))
    again.resume(answers)
    counts = again.push().first()
    assert (counts["unchanged"], counts["refused_unchanged"], counts["created"]) == (28, 1, 0)
    audit = run.audit("2026-01-01T00:00:00+00:00")
    assert audit.where("field = 'department' and after = 'Ops'").count() == 1 and audit.where("after = 'merged'").count() == 1
    assert run.rollback() == 28 and run._state().count() == 0
    assert run_status(2, 0, 0)[1] and run_status(0, 3, 0) == ("reconciling", True, "3 questions are open") and not run_status(0, 0, 5)[1]


def test_synthetic(spark, tmp_path):
    from tallyfold.sources import synthetic as G

    people = G.canonical(spark, 3000)
    files = G.exports(people)
    truth = G.manifest(people)
    hris = files["legacy_hris_employees.csv"]
    n = {r["anomaly"]: r["n"] for r in truth.groupBy("anomaly").agg(F.count("*").alias("n")).collect()}
    assert hris.count() == 3000 + n["twin"] and 0.85 < files["payroll_dump.csv"].count() / 3000 < 0.97 and 0.6 < files["crm_contacts_export.xlsx"].count() / 3000 < 0.8
    assert hris.where("mgr_code = emp_code and not emp_code like '%-D%'").count() == n["self_manager"]
    assert files["payroll_dump.csv"].where("annual_salary like 'USD%'").count() > 0.2 * 2700
    assert G.canonical(spark, 3000).exceptAll(people).count() == 0  # a rerun gives them again
    assert D.twins(hris, "emp_code").count() == n["twin"]
    (tmp_path / "m.json").write_text('{"anomalies": [\n {"anomaly": "a", "ids": ["1", "2"]}, {"anomaly": "b", "ids": []}]}')
    assert sorted(tuple(r) for r in G.read_manifest(spark, str(tmp_path / "m.json")).collect()) == [("a", "1"), ("a", "2")]
