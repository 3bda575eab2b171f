"""Synthetic exports with known anomalies, made by hashes of row numbers: any size, and a rerun gives them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.review import COST_CENTERS, DESIGNATIONS

_FIRST = ("Asha", "Ravi", "Meera", "John", "Priya", "Arjun", "Neha", "Omar", "Lena", "Kiran", "Sara")
_LAST = ("Sharma", "Iyer", "Patel", "Smith", "Reddy", "Khan", "Gupta", "Jones", "Nair", "Bose", "Rao")
_DEPARTMENTS = ("Engineering", "Sales", "Finance", "Operations", "Legal", "Marketing", "People", "Support")
#: Anomalies of the exports and the share of rows that have each.
RATES = {"self_manager": 0.005, "dangling_manager": 0.01, "early_end": 0.005, "end_missing": 0.01, "blank_birth": 0.02, "serial_birth": 0.015, "slash_hired": 0.025, "typo_department": 0.03, "damaged_name": 0.05, "mixed_currency": 0.3, "twin": 0.01}
PAYROLL, CRM = 0.92, 0.70


def _roll(*salt: object) -> Column:
    """A number from 0 to 1 by the row's number k and the salt."""
    return (F.xxhash64("k", *[F.lit(str(s)) for s in salt]).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


def _pick(values: tuple[str, ...], salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(_roll(salt) * len(values)) + 1).cast("int"))


def indian_grouping(n: Column, to_crores: bool = False) -> Column:
    """Digits with the last three apart and the others in twos: 12,34,567. to_crores: digits before the comma of crores stay together."""
    digits = n.cast("string")
    twos = r"(?<=\d)(?=(\d\d){1,2}$)" if to_crores else r"(?<=\d)(?=(\d\d)+$)"
    rest = F.regexp_replace(F.substr(digits, F.lit(1), F.char_length(digits) - 3), twos, ",")
    return F.when(F.char_length(digits) <= 3, digits).otherwise(F.concat(rest, F.lit(","), F.right(digits, F.lit(3))))


def excel_serial(day: Column) -> Column:
    return F.date_diff(day, F.lit("1899-12-30").cast("date"))


def mobile(digits: Column, template: Column) -> Column:
    """One of four ways to write a number: +91 and digits, a trunk 0, bare, or +91 in groups of three."""
    grouped = F.concat(F.lit("+91-"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 99))
    return F.when(template == 0, F.concat(F.lit("+91 "), digits)).when(template == 1, F.concat(F.lit("0"), digits)).when(template == 2, digits).otherwise(grouped)


def typo(word: Column, kind: Column, at: Column) -> Column:
    """The word with its character `at` (from 1; neither first nor last) dropped (0), swapped with the next (1) or doubled (2); short words backwards."""
    part = lambda a, n: F.substr(word, a, n)
    head, ch, tail = part(F.lit(1), at), part(at + 1, F.lit(1)), F.substr(word, at + 2)
    swapped = F.concat(head, part(at + 2, F.lit(1)), ch, F.substr(word, at + 3))
    return F.when(F.char_length(word) < 3, F.reverse(word)).when(kind == 0, F.concat(head, tail)).when(kind == 1, swapped).otherwise(F.concat(head, ch, ch, tail))


def damaged(name: Column, kind: Column) -> Column:
    """Upper case (0), lower case (1), padded (2), or inner spaces doubled (3)."""
    return F.when(kind == 0, F.upper(name)).when(kind == 1, F.lower(name)).when(kind == 2, F.concat(F.lit("  "), name, F.lit("  "))).otherwise(F.replace(name, F.lit(" "), F.lit("  ")))


def money(amount: Column, foreign: Column) -> Column:
    """Rupees in Indian grouping, or dollars at 83 to one where `foreign`."""
    dollars = F.round(amount.cast("double") / 83).cast("long")
    return F.when(foreign, F.concat(F.lit("USD "), F.format_number(dollars, 0))).otherwise(F.concat(F.lit("₹ "), indian_grouping(amount)))


def canonical(spark: SparkSession, n: int, rates: dict[str, float] = RATES) -> DataFrame:
    """n people, and a boolean column for each anomaly that their rows in the exports have."""
    day = lambda start, span, salt: F.date_add(F.lit(start).cast("date"), F.floor(_roll(salt) * span).cast("int"))
    rows = spark.range(n).withColumnRenamed("id", "k")
    rows = rows.select(
        "k", F.concat(F.lit("EMP"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("employee_id"), _pick(_FIRST, "f").alias("first_name"), _pick(_LAST, "l").alias("last_name"),
        day("1960-01-01", 14_000, "b").alias("born"), day("2005-01-01", 6_000, "h").alias("hired"), _pick(_DEPARTMENTS, "d").alias("department"), _pick(DESIGNATIONS, "t").alias("designation"),
        _pick(COST_CENTERS, "c").alias("cost_center"), F.element_at(F.array(F.lit("A"), F.lit("A"), F.lit("A"), F.lit("L"), F.lit("T")), (F.floor(_roll("s") * 5) + 1).cast("int")).alias("state"),
        (300_000 + F.floor(_roll("m") * 2_000_000)).cast("long").alias("salary"), (6_000_000_000 + F.floor(_roll("p") * 3_999_999_999)).cast("long").cast("string").alias("digits"),
        F.concat(F.lit("EMP"), F.lpad(((F.col("k") + 1 + F.floor(_roll("g") * max(1, n - 1))) % n).cast("string"), 6, "0")).alias("manager"),  # somebody else
    )
    rows = rows.withColumn("email", F.lower(F.concat("first_name", F.lit("."), "last_name", F.col("k").cast("string"), F.lit("@example.com"))))
    flags = {a: _roll("anomaly", a) < rate for a, rate in rates.items()}
    ended = F.col("state") == "T"
    return rows.withColumns({**flags, "early_end": flags["early_end"] & ended, "end_missing": flags["end_missing"] & ended & ~flags["early_end"]})


def exports(people: DataFrame) -> dict[str, DataFrame]:
    """The three exports of canonical(): text columns as a source system writes them."""
    dmy = lambda c: F.date_format(c, "dd-MM-yyyy")
    blank = F.lit("")
    born = F.when(F.col("blank_birth"), blank).when(F.col("serial_birth"), excel_serial(F.col("born")).cast("string")).otherwise(dmy("born"))
    ended = F.when(F.col("state") != "T", blank).when(F.col("end_missing"), blank).when(F.col("early_end"), dmy(F.date_sub("hired", 100))).otherwise(dmy(F.date_add("hired", 900)))
    manager = F.when(F.col("self_manager"), F.col("employee_id")).when(F.col("dangling_manager"), F.concat(F.lit("EMP9"), F.substring("employee_id", 5, 5))).otherwise(F.col("manager"))
    kind = F.floor(_roll("kind") * 3)
    department = F.when(F.col("typo_department"), typo(F.col("department"), kind, (1 + F.floor(_roll("at") * 3)).cast("int"))).otherwise(F.col("department"))
    name = F.when(F.col("damaged_name"), damaged(F.col("first_name"), F.floor(_roll("damage") * 4))).otherwise(F.col("first_name"))
    hris = people.select(
        F.col("employee_id").alias("emp_code"), name.alias("fname"), F.col("last_name").alias("lname"), born.alias("dob"), F.when(F.col("slash_hired"), F.date_format("hired", "dd/MM/yyyy")).otherwise(dmy("hired")).alias("doj"),
        department.alias("dept_nm"), F.col("designation").alias("desig"), manager.alias("mgr_code"), F.col("salary").cast("string").alias("ctc_annual"), F.col("state").alias("status_flag"), ended.alias("term_date"), "twin",
    )
    twins = hris.where("twin").withColumn("emp_code", F.concat("emp_code", F.lit("-D1"))).withColumn("dept_nm", typo(F.col("dept_nm"), F.lit(0), F.lit(1)))
    kinds = F.element_at(F.array(*map(F.lit, ("FT", "FT", "PT", "CON", "INT"))), (F.floor(_roll("e") * 5) + 1).cast("int"))
    payroll = people.where(_roll("payroll") < PAYROLL).select(F.col("employee_id").alias("id"), "email", money(F.col("salary"), F.col("mixed_currency")).alias("annual_salary"), F.col("cost_center").alias("cost_centre"), kinds.alias("type"), "department")
    crm = people.where(_roll("crm") < CRM).select(
        F.concat_ws(" ", "first_name", "last_name").alias("Full Name"), F.col("email").alias("Email"), mobile(F.col("digits"), F.floor(_roll("mobile") * 4)).alias("Mobile"),
        excel_serial(F.col("hired")).cast("string").alias("Date of Joining"), F.col("department").alias("Department"), F.col("designation").alias("Designation"),
    )
    return {"legacy_hris_employees.csv": hris.unionByName(twins).drop("twin"), "payroll_dump.csv": payroll, "crm_contacts_export.xlsx": crm}


def manifest(people: DataFrame, rates: dict[str, float] = RATES) -> DataFrame:
    """anomaly, id: the ground truth of the exports."""
    made = F.array(*[F.when(F.col(a), F.lit(a)) for a in rates])
    return people.select(F.col("employee_id").alias("id"), F.explode(F.array_compact(made)).alias("anomaly")).select("anomaly", "id")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's JSON, one document or one a line, of {"anomalies": [{"anomaly": ..., "ids": [...]}]}: anomaly, id."""
    raw = spark.read.schema("anomalies array<struct<anomaly:string,ids:array<string>>>").option("multiLine", "true").json(path)
    return raw.select(F.explode("anomalies").alias("x")).select("x.anomaly", F.explode("x.ids").alias("id"))
