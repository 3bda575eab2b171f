"""What stands behind the views of a run: joins of records, files, questions and answers, fills, and instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.config import REASONS, RULE_TEXTS, SCHEMA, Field, Policy
from tallyfold.functions.values import coerce_user_value
from tallyfold.operators.records import RULES, broken_rules, field_errors

#: Records that a push may take, that a fill may reach, and the states in which a run works or has ended.
PUSHABLE = ("merged_survivor", "clean")
FILLABLE = ("clean", "merged_survivor", "blocked", "incomplete")
ACTIVE, TERMINAL = ("running", "paused"), ("finished", "waiting", "failed")
#: The fields by which two records are held against each other.
COMPARED = ("employee_id", "first_name", "last_name", "work_email", "phone", "date_of_birth", "department", "designation")
#: Rows of a page of fills, examples of a card, samples of a profile.
PAGE, EXAMPLES = 500, 5


def records_with_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with their file's filename, by source_file_id; records of no known file are left out."""
    return records.join(files.select("source_file_id", "filename"), "source_file_id")


def mapped_columns(mappings: DataFrame, columns: DataFrame, files: DataFrame, only_mapped: bool = False) -> DataFrame:
    """column_id, filename, column_name, target_field, confidence of each mapping, in the order of files and columns.

    only_mapped: without those that have no target. Mappings of unknown columns or files are left out.
    """
    out = mappings.join(columns, "column_id").join(files, "source_file_id").select("column_id", "filename", "column_name", "target_field", "confidence")
    return (out.where("target_field is not null") if only_mapped else out).orderBy("filename", "column_name", "column_id")


def asked_records(records: DataFrame, escalations: DataFrame, code: str, signature: str, statuses: tuple[str, ...] = FILLABLE) -> DataFrame:
    """All records of the given statuses, with the open question of that reason and signature where there is one."""
    open_ = escalations.where((F.col("status") == "open") & (F.col("reason_code") == code) & (F.col("signature") == signature))
    open_ = open_.select(F.col("entity_id").alias("id"), F.col("id").alias("escalation_id"), "suggested")
    return records.where(F.col("status").isin(*statuses)).join(open_, "id", "left")


def joined_distinct(left: DataFrame, records: DataFrame, key: str, *columns: str) -> DataFrame:
    """The distinct given columns of the rows of left whose `key` is a record's id: pushed records, audited records."""
    return left.join(records.withColumnRenamed("id", key), key).select(*columns).distinct()


def twins(records: DataFrame, key: str) -> DataFrame:
    """key, twin: the key of each record whose key is another's with -D and more behind it, by the longest such other."""
    base = records.select(F.col(key).alias("twin"), F.regexp_extract(key, "^(.*)-D[^-]*$", 1).alias(key)).where(F.col(key) != "")
    return records.select(key).distinct().join(base, key).select(key, "twin")


def comparable(fields: tuple[str, ...] = COMPARED) -> Column:
    """A map of the fields that are filled, as text."""
    cells = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    return F.map_from_entries(F.filter(cells, lambda c: F.coalesce(c["value"], F.lit("")) != ""))


def field_names(a: Column, b: Column) -> Column:
    """The names in two maps, those of the first in their order and then what the second adds."""
    return F.array_union(F.map_keys(a), F.map_keys(b))


def conjunction(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every given value; a None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def search(df: DataFrame, query: str, columns: list[str], limit: int = 100) -> DataFrame:
    """Rows one of whose columns holds the query, in any case; % and _ in it are wildcards. The first by the first column, nulls first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).like(f"%{query.lower()}%"), F.lit(False))
    return df.where(hit).orderBy(F.asc_nulls_first(columns[0])).limit(limit)


def mapping_open(escalations: DataFrame) -> DataFrame:
    """One row: whether no question about a mapping is open, and how many are."""
    n = F.count_if(F.col("reason_code").startswith("MAP_") & (F.col("status") == "open"))
    return escalations.agg(n.alias("open_questions"), (n == 0).alias("passes"))


def normalised(values: DataFrame, answers: DataFrame) -> DataFrame:
    """values (field, raw and more) with `value`: the answer for (field, raw) where there is one, else null."""
    return values.join(answers.select("field", "raw", "value"), ["field", "raw"], "left")


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (model, prompt_hash and more) with the cached response, null where there is none, and `hit`."""
    kept = cache.select("model", "prompt_hash", "response").withColumn("hit", F.lit(True))
    return requests.join(kept, ["model", "prompt_hash"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_key(kind: str, *parts: Column) -> Column:
    """Kind and the hash of its parts: value_norm, dupe_judge, push_repair and the like."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.concat_ws("\u001f", *parts), 256))


def stable_id(*parts: Column) -> Column:
    """An id that a rerun gives again, from the run, the file and the place in it."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def pasted(fills: DataFrame, lines: DataFrame) -> DataFrame:
    """fills (employee_id, supplied and more) with blanks filled from pasted lines `id<,|tab|;>value`.

    Lines without a separator or a value are skipped; of several lines for an employee the first by `ord` counts; a
    value that is supplied stays.
    """
    part = F.split("line", r"[,\t;]", 2)
    named = lines.select(F.trim(part[0]).alias("employee_id"), F.trim(F.get(part, F.lit(1))).alias("pasted"), "ord").where("pasted <> ''")
    first = named.groupBy("employee_id").agg(F.min_by("pasted", "ord").alias("pasted"))
    supplied = F.coalesce(F.nullif(F.col("supplied"), F.lit("")), F.col("pasted"))
    return fills.join(first, "employee_id", "left").withColumn("supplied", supplied).drop("pasted")


def prefilled(rows: DataFrame, plan: dict) -> DataFrame:
    """rows (current, proposed) with `prefill` of a plan: set_all leaves alone what is proposed, replace maps current values."""
    if plan["action"] == "set_all":
        value = F.when(F.coalesce("proposed", F.lit("")) == "", F.lit(plan["value"]))
    else:
        named = F.create_map(*[F.lit(x) for pair in plan["replacements"].items() for x in pair])
        value = F.try_element_at(named, F.coalesce("current", F.lit("")))
    return rows.withColumn("prefill", F.coalesce(value, F.lit("")))


def fill_targets(records: DataFrame, escalations: DataFrame, code: str, signature: str, field: str, rule: str | None, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """The records behind one question, a page of them in the order of natural keys, and one row with their number.

    With a rule the question reaches every fillable record that breaks it, asked about or not; without one it
    reaches the records it was asked about.
    """
    if rule is not None:
        found = asked_records(records, escalations, code, signature).where(F.array_contains(broken_rules(tuple(r for r in RULES)), rule))
    else:
        found = asked_records(records, escalations, code, signature, tuple(s for s in (*FILLABLE, "excluded", "merged", "pending"))).where("escalation_id is not null")
    name = F.concat_ws(" ", F.nullif(F.col("first_name"), F.lit("")), F.nullif(F.col("last_name"), F.lit("")))
    rows = found.select("escalation_id", F.col("id").alias("record_id"), "employee_id", name.alias("name"), F.coalesce(F.col(field).cast("string"), F.lit("")).alias("current"), F.coalesce("suggested", F.lit("")).alias("proposed"))
    return rows.orderBy("employee_id", "record_id").limit(page), rows.agg(F.count("*").alias("remaining"))


def checked_plan(plan: dict, field: Field | None, check) -> tuple[dict | None, str]:
    """An instruction's reading, checked: (plan, "") or (None, why not).

    check(value, field) gives (canonical, why not) as coerce_user_value() does, for one literal. No value gets past
    the field's own rules, on either side of a replacement.
    """
    if field is None:
        return None, "not a field in the target schema"
    if plan.get("action") == "set_all":
        value, why = check(str(plan.get("value") or ""), field)
        return (None, why) if value is None else ({"field": field.name, "action": "set_all", "value": value, "replacements": {}}, "")
    if plan.get("action") == "replace":
        if not isinstance(plan.get("replacements"), dict) or not plan["replacements"]:
            return None, str(plan.get("reading") or "") or "no replacements were named"
        out = {}
        for old, new in plan["replacements"].items():
            value, why = check(str(new or ""), field)
            if value is None:
                return None, f"cannot replace {old!r}: {why}"
            out[str(old)] = value
        return {"field": field.name, "action": "replace", "value": None, "replacements": out}, ""
    return None, str(plan.get("reading") or "") or "that instruction could not be turned into a change"


def literal_check(spark, policy: Policy = Policy()):
    """check() of checked_plan() by the engine's own expressions."""

    def check(value: str, field: Field) -> tuple[str | None, str]:
        row = spark.range(1).select(coerce_user_value(F.lit(value), field, policy.date_formats).alias("x")).first()["x"]
        return row["value"], row["why"]

    return check


def accept_proposals(proposals: DataFrame, schema: tuple[Field, ...] = SCHEMA) -> DataFrame:
    """proposals (header, target, confidence) with `error` where the target is not a field; a null target is no error."""
    known = F.col("target").isNull() | F.col("target").isin(*[f.name for f in schema])
    return proposals.withColumn("error", F.when(~known, F.concat(F.lit("unknown field: "), "target")))


def apply_mapping(mappings: DataFrame, answers: DataFrame) -> DataFrame:
    """mappings (column_id, target_field, status) after answers (column_id, action, value).

    A rejection maps to nothing, an approval or edit with a value sets it, one without accepts the proposal.
    """
    kept = [c for c in mappings.columns if c not in ("target_field", "status")]
    both = mappings.join(answers.select("column_id", "action", F.col("value").alias("_value")), "column_id", "left")
    target = F.when(F.col("action") == "reject", None).when(F.col("action").isNull(), F.col("target_field")).otherwise(F.coalesce("_value", "target_field"))
    status = F.when(F.col("action") == "reject", "rejected").when(F.col("action").isNotNull(), "accepted").otherwise(F.col("status"))
    return both.select(*kept, target.alias("target_field"), status.alias("status"))


def decide_value(confidence: Column, field: Column, raw: Column, policy: Policy = Policy()) -> Column:
    """The scope of the question that a doubtful reading of a value raises, or null."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) < policy.accept_value, F.concat_ws(":", field, raw))


def read_values(values: DataFrame, cache: DataFrame, provider: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """field, raw, value, confidence, asks of each distinct value: as cached, else as the provider has it, else unread.

    values: field, raw. cache and provider: field, raw, value, confidence. What nobody reads has the confidence 0.
    """
    distinct = values.select("field", "raw").where("raw is not null").distinct()
    got = distinct.join(cache.select("field", "raw", F.col("value").alias("_v"), F.col("confidence").alias("_c")), ["field", "raw"], "left")
    if provider is None:
        provider = cache.limit(0)
    got = got.join(provider.select("field", "raw", F.col("value").alias("_w"), F.col("confidence").alias("_d")), ["field", "raw"], "left")
    held = F.col("_c").isNotNull()
    value, confidence = F.when(held, F.col("_v")).otherwise(F.col("_w")), F.coalesce("_c", "_d", F.lit(0.0))
    return got.select("field", "raw", value.alias("value"), confidence.alias("confidence"), decide_value(confidence, F.col("field"), F.col("raw"), policy).isNotNull().alias("asks"))


def judged(pairs: DataFrame, verdicts: DataFrame, most: int = 200) -> DataFrame:
    """pairs (a_id, b_id and more) with verdict and confidence; only `different` and `unsure` are verdicts.

    Of more than `most` pairs none is judged, which is a feature: so many doubts are the score's fault.
    """
    fit = verdicts.where(F.col("verdict").isin("different", "unsure")).select("a_id", "b_id", "verdict", "confidence")
    few = pairs.agg((F.count("*") <= most).alias("_few"))
    fit = fit.join(F.broadcast(few), F.lit(True)).where("_few").drop("_few")  # one row
    return pairs.join(fit, ["a_id", "b_id"], "left")


def merges(clusters: DataFrame) -> DataFrame:
    """survivor_id, absorbed_id of every absorbed record. clusters: id, cluster_id, rank; the least (rank, id) survives."""
    w = Window.partitionBy("cluster_id").orderBy("rank", "id")
    return clusters.select("id", F.first("id").over(w).alias("survivor_id")).where("id <> survivor_id").select("survivor_id", F.col("id").alias("absorbed_id"))


def card_examples(escalations: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The first examples of every open question, by entity."""
    w = Window.partitionBy("reason_code", "signature").orderBy("entity_id", "id")
    return escalations.where("status = 'open'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("reason_code", "signature", "entity_id", "place")


def totals(escalations: DataFrame) -> DataFrame:
    """One row: escalations, distinct questions, and both for codes asked by class and by single case."""
    classwise = F.col("reason_code").isin(*[c for c, (_, by_class, _) in REASONS.items() if by_class])
    question = F.struct("reason_code", "signature")
    return escalations.agg(
        F.count("*").alias("escalations"), F.count_distinct(question).alias("questions"),
        F.count_if(classwise).alias("class_rows"), F.count_distinct(F.when(classwise, question)).alias("class_questions"),
        F.count_if(~classwise).alias("case_rows"), F.count_distinct(F.when(~classwise, question)).alias("case_questions"),
    )


def anomaly_scores(injected: DataFrame, detected: DataFrame) -> DataFrame:
    """anomaly, injected, detected, hits, recall, precision, from (anomaly, id) rows; repeated rows count once."""
    both = injected.distinct().withColumn("i", F.lit(1)).join(detected.distinct().withColumn("d", F.lit(1)), ["anomaly", "id"], "full")
    out = both.groupBy("anomaly").agg(F.count("i").alias("injected"), F.count("d").alias("detected"), F.count_if(F.col("i").isNotNull() & F.col("d").isNotNull()).alias("hits"))
    return out.select("*", F.round(F.try_divide("hits", "injected"), 4).alias("recall"), F.round(F.try_divide("hits", "detected"), 4).alias("precision"))


def column_recall(affected: Column, injected: Column) -> Column:
    """Of a question about a whole column: the share of the injected cases that its affected rows can cover."""
    return F.round(F.try_divide(F.least(affected, injected).cast("double"), injected), 4)


def manifest_rates(rows: DataFrame, flags: list[str], eligible: Column) -> DataFrame:
    """anomaly, count, rate (of all rows), eligible_rate (of the eligible), from boolean columns."""
    long = rows.select(eligible.alias("_e"), F.explode(F.array(*[F.struct(F.lit(f).alias("anomaly"), F.col(f).alias("flag")) for f in flags])).alias("x")).select("_e", "x.*")
    n = F.count_if("flag")
    return long.groupBy("anomaly").agg(n.alias("count"), F.round(F.try_divide(n, F.count("*")), 6).alias("rate"), F.round(F.try_divide(n, F.count_if("_e")), 6).alias("eligible_rate"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows of each."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def choices(audit: DataFrame, *columns: str) -> DataFrame:
    """column, value: the distinct values of each column, for a filter's list, in order; nulls are none."""
    long = audit.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.where("value is not null").distinct().orderBy("column", "value")


def fill_verdicts(records: DataFrame, field: Field, rule: str | None, schema: tuple[Field, ...] = SCHEMA, policy: Policy = Policy()) -> DataFrame:
    """Records with a supplied value, judged: adds value (canonical), why (empty: accepted) and status after the fill.

    records: the schema's fields, status, supplied (text); rows without a supplied value are left out. A fill answers
    for what it breaks anew and for the rule it was to fix, not for other rules. An accepted record that was held back
    becomes clean if it is complete by then, and incomplete otherwise.
    """
    types = dict(records.dtypes)
    rows = records.where("supplied <> ''").withColumn("_x", coerce_user_value(F.col("supplied"), field, policy.date_formats)).withColumn("_before", broken_rules())
    filled = rows.withColumn("_old", F.col(field.name)).withColumn(field.name, F.when(F.col("_x.why") == "", F.col("_x.value").try_cast(types[field.name])).otherwise(F.col(field.name)))
    filled = filled.withColumns({"_after": broken_rules(), "_bad": field_errors((field,)), "_missing": field_errors(tuple(f for f in schema if f.name in records.columns), strict=True)})
    said = F.create_map(*[F.lit(x) for r, (text, _) in RULE_TEXTS.items() for x in (r, text)])
    told = lambda ids: F.concat_ws(", ", F.transform(F.array_sort(ids), lambda r: F.try_element_at(said, r)))
    newly = F.array_except("_after", "_before")
    left = F.array_intersect("_after", F.array(F.lit(rule))) if rule else F.array().cast("array<string>")
    broken = F.concat_ws("; ", F.when(F.size(newly) > 0, F.concat(F.lit("would break "), told(newly))), F.when(F.size(left) > 0, F.concat(F.lit("still does not fix "), told(left))))
    why = F.when(F.col("_x.why") != "", F.col("_x.why")).when(F.size("_bad") > 0, "not valid for the field").otherwise(broken)
    held = F.col("status").isin("excluded", "blocked", "incomplete")
    after = F.when(why != "", F.col("status")).when(held, F.when(F.size("_missing") == 0, "clean").otherwise("incomplete")).otherwise(F.col("status"))
    kept = [F.col(c) for c in records.columns if c not in ("status", field.name)]
    return filled.select(*kept, F.when(why == "", F.col(field.name)).otherwise(F.col("_old")).alias(field.name), F.col("_x.value").alias("value"), why.alias("why"), after.alias("status"))


def typed_answers(answers: DataFrame, fields: tuple[Field, ...] = SCHEMA, policy: Policy = Policy()) -> DataFrame:
    """answers (field, typed and more) with `value`, in the form the field stores, and `why` it can't be; unknown fields pass as typed."""
    plain = F.struct(F.col("typed").alias("value"), F.lit("").alias("why"))
    x = F.lit(None)
    for f in fields:
        x = F.when(F.col("field") == f.name, coerce_user_value(F.col("typed"), f, policy.date_formats)).otherwise(x if f is not fields[0] else plain)
    return answers.withColumn("_x", x).select(*answers.columns, "_x.value", "_x.why")
