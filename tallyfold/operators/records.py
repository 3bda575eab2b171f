"""Cleaning, rules, questions, records' status, delivery: the operators on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.config import REASONS, SCHEMA, Field, Policy
from tallyfold.functions.text import clean_email, clean_phone, clean_string
from tallyfold.functions.values import clean_number, coerce_enum, parse_date
from tallyfold.operators.graph import connected_components
from tallyfold.operators.pairs import merge_edges

#: The patterns of a valid e-mail and phone, of a number, of what looks like a date.
EMAIL, PHONE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"^\+[1-9]\d{7,14}$"
NUMERIC, DATE_LIKE = r"^[+-]?[\d,]*\.?\d+$", r"^\d{1,4}[-/][A-Za-z0-9]{1,4}[-/]\d{1,4}$"


def signature(code: Column, scope_key: Column) -> Column:
    return F.sha2(F.concat_ws(":", code, scope_key), 256)


#: One column builder for each cross-field rule; true: the record keeps it.
RULES = {
    "R1": lambda: F.coalesce(F.col("termination_date") >= F.col("hire_date"), F.lit(True)),
    "R2": lambda: F.coalesce(F.col("employment_status") != "terminated", F.lit(True)) | F.col("termination_date").isNotNull(),
    "R3": lambda: F.col("employment_status").eqNullSafe("terminated") | F.col("termination_date").isNull(),
    "R4": lambda: F.coalesce(F.col("date_of_birth") <= F.add_months("hire_date", -192), F.lit(True)),
    "R5": lambda: F.coalesce(F.col("manager_employee_id") != F.col("employee_id"), F.lit(True)),
}


def broken_rules(ids: tuple[str, ...] = tuple(RULES)) -> Column:
    return F.array_compact(F.array(*[F.when(~RULES[i](), F.lit(i)) for i in ids]))


def dangling_managers(records: DataFrame) -> DataFrame:
    """R6: records whose manager is nobody's employee_id."""
    known = records.select(F.col("employee_id").alias("manager_employee_id")).where("manager_employee_id is not null").distinct()
    return records.where("manager_employee_id is not null").join(known, "manager_employee_id", "left_anti")


def field_errors(fields: tuple[Field, ...], strict: bool = False) -> Column:
    """Names of the fields whose value isn't valid; strict: of required ones that are null too."""
    out = []
    for f in fields:
        c = F.col(f.name)
        bad = {"email": ~c.rlike(EMAIL), "phone": ~c.rlike(PHONE), "enum": ~c.isin(*f.values) if f.values else F.lit(False)}.get(f.kind, F.lit(False))
        if f.pattern:
            bad = bad | ~c.rlike(f.pattern)
        bad = F.coalesce(bad, F.lit(False))
        out.append(F.when(bad | c.isNull() if strict and f.required else bad, F.lit(f.name)))
    return F.array_compact(F.array(*out))


def clean_records(raw: DataFrame, fields: tuple[Field, ...] = SCHEMA, policy: Policy = Policy()) -> DataFrame:
    """raw: text columns named as fields, besides others, which stay. Adds `doubts`: array of reason, field, value."""
    doubt = lambda cond, code, name: F.when(cond, F.struct(F.lit(code).alias("reason_code"), F.lit(name).alias("field"), F.trim(F.col(name)).alias("raw")))
    values, doubts = {}, []
    for f in (f for f in fields if f.name in raw.columns):
        c = F.col(f.name)
        if f.kind == "date":
            parsed = parse_date(c, policy.date_formats)
            values[f.name] = parsed["value"]
            if policy.ask_dates:
                doubts.append(doubt(parsed["ambiguous"], "DATE_FORMAT_AMBIGUOUS", f.name))
        elif f.kind == "enum":
            near = coerce_enum(c, f.values, policy.enum_distance)
            values[f.name] = near["value"]
            doubts.append(doubt(near["distance"] > policy.enum_distance, "VALUE_LOW_CONFIDENCE", f.name))
        else:
            values[f.name] = {"email": clean_email, "phone": clean_phone, "decimal": lambda x: clean_number(x)["amount"]}.get(f.kind, clean_string)(c)
    if "annual_ctc" in values and "ctc_currency" in values:  # an amount tells its currency
        values["ctc_currency"] = F.coalesce(clean_number(F.col("annual_ctc"))["currency"], values["ctc_currency"])
    noted = F.array_compact(F.array(*doubts)) if doubts else F.array().cast("array<struct<reason_code:string,field:string,raw:string>>")
    return raw.select(*[values.get(c, F.col(c)).alias(c) for c in raw.columns], noted.alias("doubts"))


def field_messages(fields: tuple[Field, ...] = SCHEMA, strict: bool = False) -> Column:
    """An array of field, message for the fields of field_errors()."""
    said = {"email": "value is not a valid email", "phone": "value is not an E.164 phone number", "enum": "value is not allowed", "string": "value does not match the pattern"}
    kinds = F.create_map(*[F.lit(x) for f in fields for x in (f.name, said.get(f.kind, "value is not valid"))])
    missing = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.col(f.name).isNull())])
    text = lambda n: F.when(F.try_element_at(missing, n), F.lit("field required")).otherwise(F.try_element_at(kinds, n))
    return F.transform(field_errors(fields, strict), lambda n: F.struct(n.alias("field"), text(n).alias("message")))


def corrected(cleaned: DataFrame, key: str, fields: tuple[Field, ...] = SCHEMA, corrections: DataFrame | None = None) -> DataFrame:
    """cleaned after one attempt at correction, with `errors` left: these records are VALIDATE_TWICE.

    corrections: key, field, value (text) of a provider; only fields in error are touched, and of several values for
    one the least counts. None: no provider, and errors stay.
    """
    if corrections is None:
        return cleaned.withColumn("errors", field_errors(fields))
    named = corrections.groupBy(key, "field").agg(F.min("value").alias("value")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"))
    both = cleaned.withColumn("_bad", field_errors(fields)).join(named, key, "left")
    types = dict(cleaned.dtypes)
    new = lambda f: F.when(F.array_contains("_bad", f) & F.map_contains_key("_new", f), F.try_element_at("_new", F.lit(f)).try_cast(types[f])).otherwise(F.col(f))
    names = {f.name for f in fields}
    return both.select(*[new(c).alias(c) if c in names else F.col(c) for c in cleaned.columns]).withColumn("errors", field_errors(fields))


def twice(corrected_: DataFrame, key: str) -> DataFrame:
    """The VALIDATE_TWICE questions of corrected(): reason_code, scope_key, entity_id, signature."""
    code, scope = F.lit("VALIDATE_TWICE"), F.lit("")
    return corrected_.where(F.size("errors") > 0).select(code.alias("reason_code"), scope.alias("scope_key"), F.col(key).alias("entity_id"), signature(code, scope).alias("signature"))


def issues(cleaned: DataFrame, key: str, filename: str) -> DataFrame:
    """One row for each doubt and each broken rule: reason_code, scope_key, entity_id, signature."""
    column = F.when(F.col("d.reason_code") == "DATE_FORMAT_AMBIGUOUS", F.concat_ws(":", F.lit(filename), "d.field")).otherwise(F.concat_ws(":", "d.field", "d.raw"))
    doubts = cleaned.select(F.col(key).alias("entity_id"), F.explode("doubts").alias("d")).select(F.col("d.reason_code").alias("reason_code"), column.alias("scope_key"), "entity_id")
    rules = cleaned.select(F.col(key).alias("entity_id"), F.explode(broken_rules()).alias("rule"))
    rules = rules.select(F.lit("LOGIC_CONTRADICTION").alias("reason_code"), F.concat(F.lit("record:"), "rule").alias("scope_key"), "entity_id")
    return doubts.unionByName(rules).withColumn("signature", signature(F.col("reason_code"), F.col("scope_key")))


def grouped(found: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Questions: issues by reason and signature, without those that a learnt decision answers."""
    if decisions is not None:
        learnt = [c for c, (_, _, learn) in REASONS.items() if learn]
        answered = decisions.select("reason_code", "signature").distinct().where(F.col("reason_code").isin(learnt))
        found = found.join(answered, ["reason_code", "signature"], "left_anti")
    return found.groupBy("reason_code", "signature").agg(F.min("scope_key").alias("scope_key"), F.min("entity_id").alias("first_entity"), F.count("*").alias("rows_affected"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    w = Window.partitionBy("reason_code", "signature").orderBy(F.desc("created_at"))
    return decisions.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def source_rank(filename: Column, policy: Policy = Policy()) -> Column:
    out = F.lit(999)
    for k, prefix in reversed(list(enumerate(policy.precedence))):
        out = F.when(F.lower(filename).startswith(prefix), k).otherwise(out)
    return out


def cluster(records: DataFrame, approved: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """id, cluster_id: components of equal natural keys (each member to the first), of pairs above the merge score, of approved pairs.

    approved: a_id, b_id of the pairs that an answer or a verdict has joined, whatever their score.
    """
    key = F.col("employee_id")
    first = records.where(F.coalesce(key, F.lit("")) != "").groupBy("employee_id").agg(F.min("id").alias("src"))
    star = records.join(first, "employee_id").where("id <> src").select("src", F.col("id").alias("dst"))
    edges = star.unionByName(merge_edges(records, policy.merge_above))
    if approved is not None:
        edges = edges.unionByName(approved.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")))
    found = connected_components(edges)
    return records.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def survivorship(rows: DataFrame, fields: list[str], policy: Policy = Policy(), material: tuple[str, ...] = (), trusted: DataFrame | None = None, amount: tuple[str, str] | None = None) -> DataFrame:
    """cluster_id, field, value, source, sources, conflict, asks: the value that survives of each field of each cluster.

    rows: cluster_id, id, filename, fields as text. Of each file the first value by id counts; of files the one that
    comes first in precedence. Distinct values of a field across files conflict; material ones ask.
    trusted: signature, filename of answers to such a conflict; the named file's value then wins, does not ask, and
    is told by `by_answer`. amount: the names of an amount and its currency; amounts whose files name several
    currencies cannot be compared and do not ask.
    """
    long = rows.select("cluster_id", "id", "filename", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"))
    long = long.select("cluster_id", "id", "filename", "x.field", "x.value").where("value is not null and value <> ''")
    by_file = long.groupBy("cluster_id", "field", "filename").agg(F.min_by("value", "id").alias("value"), F.min("id").alias("id"))
    order = F.struct(source_rank(F.col("filename"), policy), "id")
    more = [F.map_from_entries(F.collect_list(F.struct("filename", "value"))).alias("_by")] if trusted is not None else []
    out = by_file.groupBy("cluster_id", "field").agg(
        F.min_by("value", order).alias("value"),
        F.min_by("filename", order).alias("source"),
        F.array_join(F.array_sort(F.collect_set("filename")), "|").alias("sources"),
        (F.count_distinct("value") > 1).alias("conflict"),
        *more,
    )
    out = out.withColumn("asks", F.col("conflict") & F.col("field").isin(*material) if material else F.lit(False))
    if amount is not None:
        name, currency = amount
        money = by_file.where(F.col("field") == currency).select("cluster_id", "filename", F.col("value").alias("currency"))
        mixed = by_file.where(F.col("field") == name).join(money, ["cluster_id", "filename"]).groupBy("cluster_id").agg((F.count_distinct("currency") > 1).alias("_mixed"))
        out = out.join(mixed, "cluster_id", "left").withColumn("asks", F.col("asks") & ~(F.coalesce("_mixed", F.lit(False)) & (F.col("field") == name))).drop("_mixed")
    if trusted is not None:
        sig = signature(F.lit("CONFLICT_ACROSS_SOURCES"), F.concat_ws(":", "field", "sources"))
        said = trusted.select("signature", F.col("filename").alias("_winner"))
        out = out.withColumn("signature", sig).join(said, "signature", "left")
        wins = F.coalesce(F.col("conflict") & F.map_contains_key("_by", F.coalesce("_winner", F.lit(""))), F.lit(False))
        out = out.select(
            "cluster_id", "field", F.when(wins, F.try_element_at("_by", F.col("_winner"))).otherwise(F.col("value")).alias("value"), F.when(wins, F.col("_winner")).otherwise(F.col("source")).alias("source"),
            "sources", "conflict", (F.col("asks") & ~wins).alias("asks"), wins.alias("by_answer"),
        )
    return out


def payload_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "true"}), 256)


def delta(payloads: DataFrame, pushed: DataFrame, refused: DataFrame, key: str = "employee_id") -> DataFrame:
    """payloads, pushed, refused: key, digest. Adds `outcome`: unchanged, refused_unchanged, created or changed."""
    before = pushed.select(key, F.col("digest").alias("before"))
    no = refused.select(key, F.col("digest").alias("refused"))
    outcome = F.when(F.col("digest") == F.col("before"), "unchanged").when(F.col("digest") == F.col("refused"), "refused_unchanged").when(F.col("before").isNull(), "created").otherwise("changed")
    return payloads.join(before, key, "left").join(no, key, "left").select(*payloads.columns, outcome.alias("outcome"))


def delivery_summary(attempts: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Of attempts (record_id, attempt_number, status_code): pushed, rejected, unreachable, retries, failure_rate, offer_rollback."""
    last = attempts.groupBy("record_id").agg(F.max_by("status_code", "attempt_number").alias("code"), F.max("attempt_number").alias("n"))
    ok, gone = F.col("code") == 200, F.col("code").isin(*policy.retry_on)
    counted = last.agg(F.count_if(ok).alias("pushed"), F.count_if(~ok & ~gone).alias("rejected"), F.count_if(gone).alias("unreachable"), F.sum(F.col("n") - 1).alias("retries"))
    rate = F.coalesce(F.try_divide(F.col("rejected").cast("double"), F.col("pushed") + F.col("rejected")), F.lit(0.0))
    return counted.withColumn("failure_rate", F.round(rate, 6)).withColumn("offer_rollback", rate > policy.rollback_above)


def profile(df: DataFrame, columns: list[str], samples: int = 20, cap: int = 10_000) -> DataFrame:
    """name, n, null_rate, distinct_count (capped), numeric_share, date_share, inferred_type of text columns, in one pass each."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    filled = F.when(F.coalesce("value", F.lit("")) != "", F.col("value"))
    out = long.groupBy("name").agg(
        F.count("*").alias("n"),
        F.round(1 - F.count(filled) / F.count("*"), 4).alias("null_rate"),
        F.least(F.count_distinct(filled), F.lit(cap + 1)).alias("distinct_count"),
        F.round(F.avg(F.regexp_replace(filled, " ", "").rlike(NUMERIC).cast("double")), 6).alias("numeric_share"),
        F.round(F.avg(F.trim(filled).rlike(DATE_LIKE).cast("double")), 6).alias("date_share"),
    )
    kind = F.when(F.col("date_share").isNull(), "empty").when(F.col("date_share") > 0.6, "date_like").when(F.col("numeric_share") > 0.6, "numeric").otherwise("text")
    return out.withColumn("inferred_type", kind)


def samples(df: DataFrame, columns: list[str], order: str, most: int = 20, votes: int = 200) -> DataFrame:
    """name, samples, inferred_type: the first distinct filled values of each column in row order, and a vote of the first filled ones.

    Both windows keep a bounded number of rows of a task before rows move.
    """
    long = df.select(F.col(order).alias("_ord"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("_ord", "x.*")
    filled = long.where("value <> ''")
    nth = lambda by: F.row_number().over(Window.partitionBy("name").orderBy(by, "value"))
    first = filled.groupBy("name", "value").agg(F.min("_ord").alias("_ord")).withColumn("nth", nth("_ord")).where(F.col("nth") <= most)
    shown = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]).alias("samples"))
    share = lambda hit: F.avg(hit.cast("double"))
    vote = filled.withColumn("nth", nth("_ord")).where(F.col("nth") <= votes).groupBy("name").agg(share(F.trim("value").rlike(DATE_LIKE)).alias("d"), share(F.regexp_replace("value", " ", "").rlike(NUMERIC)).alias("n"))
    kind = F.when(F.col("d").isNull(), "empty").when(F.col("d") > 0.6, "date_like").when(F.col("n") > 0.6, "numeric").otherwise("text")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    return names.join(shown, "name", "left").join(vote, "name", "left").select("name", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), kind.alias("inferred_type"))


def decide_mapping(scores: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """scores: header, field, field_ord, score, null_rate. header, target, confidence, runner_up, decision of each header."""
    w = Window.partitionBy("header").orderBy(F.desc("score"), "field_ord")
    top = scores.withColumn("nth", F.row_number().over(w)).where("nth <= 2").groupBy("header").agg(
        F.max(F.when(F.col("nth") == 1, F.col("field"))).alias("target"),
        F.round(F.max(F.when(F.col("nth") == 1, F.col("score"))), 4).alias("confidence"),
        F.round(F.max(F.when(F.col("nth") == 2, F.col("score"))), 4).alias("runner_up"),
        F.max("null_rate").alias("null_rate"),
    )
    low = F.col("confidence") < policy.unmapped_below
    unsure = (F.col("confidence") < policy.accept_mapping) | (F.col("confidence") - F.coalesce("runner_up", F.lit(0.0)) < policy.mapping_margin)
    decision = F.when(low & (F.col("null_rate") >= 0.99), "accept").when(low, "MAP_UNMAPPED").when(unsure, "MAP_AMBIGUOUS").otherwise("accept")
    return top.select("header", "target", "confidence", "runner_up", decision.alias("decision"))


def alternatives(scores: DataFrame, most: int = 3) -> DataFrame:
    """header, target, confidence, alternatives (field, confidence; the next `most`) of each header; ties in schema order."""
    w = Window.partitionBy("header").orderBy(F.desc("score"), "field_ord")
    top = scores.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most + 1)
    rest = F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.struct("nth", "field", F.round("score", 4).alias("confidence")))))
    first = lambda c: F.max(F.when(F.col("nth") == 1, c))
    out = top.groupBy("header").agg(first(F.col("field")).alias("target"), F.round(first(F.col("score")), 4).alias("confidence"), rest.alias("_rest"))
    return out.select("header", "target", "confidence", F.transform("_rest", lambda x: F.struct(x["field"].alias("field"), x["confidence"].alias("confidence"))).alias("alternatives"))
