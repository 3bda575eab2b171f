"""Delivery: the target's replies, retries, failures on purpose, repairs, and the summary of a push."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.config import SCHEMA, Field, Policy
from tallyfold.functions.text import mentioned_fields, target_error
from tallyfold.operators.records import broken_rules, signature
from tallyfold.operators.review import COST_CENTERS, DESIGNATIONS, EMPLOYMENT_TYPES

#: Shares of requests that fail on purpose.
RATE_500, RATE_429 = 0.10, 0.03


def _shown(values: tuple[str, ...]) -> str:
    return ", ".join(sorted(values))


def target_reply(employee_id: Column, cost_center: Column, employment_type: Column, designation: Column, born: Column) -> Column:
    """struct(status, error) of the target: 400 without an id, 422 for the first value it refuses, else 200 and null."""
    odd = lambda c, allowed: F.coalesce((c != "") & ~c.isin(*allowed), F.lit(False))
    told = lambda name, c, why: F.concat(F.lit(f"{name} '"), c, F.lit(f"' {why}"))
    refusal = (
        F.when(odd(cost_center, COST_CENTERS), told("cost_center", cost_center, f"is not an accepted cost centre; accepted values are {_shown(COST_CENTERS)}"))
        .when(odd(employment_type, EMPLOYMENT_TYPES), told("employment_type", employment_type, f"is not onboarded through this API; accepted values are {_shown(EMPLOYMENT_TYPES)}"))
        .when(odd(designation, DESIGNATIONS), told("designation", designation, f"is not in the job-title catalogue; accepted values are {_shown(DESIGNATIONS)}"))
        .when(F.coalesce(born, F.lit("")) == "", "date_of_birth is required for identity verification and is missing")
    )
    missing = F.coalesce(employee_id, F.lit("")) == ""
    error = F.when(missing, "employee_id is required").otherwise(refusal)
    return F.struct(F.when(missing, 400).when(error.isNotNull(), 422).otherwise(200).alias("status"), error.alias("error"))


def injected(key: Column, attempt: Column, rate_500: float = RATE_500, rate_429: float = RATE_429) -> Column:
    """500, 429 or null: a failure that a rerun gives again, from the key and the attempt's number."""
    roll = F.conv(F.substring(F.sha2(F.concat_ws("#", key.cast("string"), attempt.cast("string")), 256), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return F.when(roll < rate_500, 500).when(roll < rate_500 + rate_429, 429)


def backoff_ms(attempt: Column, share: Column, base: int = 250) -> Column:
    """Milliseconds to wait after an attempt (from 0): the base, doubled each time, times 0.5 to 1.5 by `share` (0 to 1)."""
    return base * F.pow(F.lit(2.0), attempt) * (0.5 + share)


def attempts(payloads: DataFrame, key: str, reply: Column, policy: Policy = Policy(), rate_500: float = RATE_500, rate_429: float = RATE_429) -> DataFrame:
    """key, attempt_number, status_code, error of every attempt that delivering the payloads takes.

    An attempt fails on purpose or gets the target's reply; the first that is not to be retried is the last, and so
    is the one after the policy's retries. The key stands for the Idempotency-Key: a reply is given once.
    """
    tries = F.sequence(F.lit(1), F.lit(policy.retries + 1))
    codes = F.transform(tries, lambda i: F.coalesce(injected(F.col(key), i, rate_500, rate_429), F.col("_reply.status")))
    rows = payloads.select(key, reply.alias("_reply")).select(key, "_reply", codes.alias("_codes"))
    again = F.array(*map(F.lit, policy.retry_on))
    done = F.array_position(F.transform(F.col("_codes"), lambda c: F.array_contains(again, c)), F.lit(False)).cast("int")
    last = F.when(done > 0, done).otherwise(policy.retries + 1)
    rows = rows.select(key, "_reply", F.posexplode(F.slice("_codes", F.lit(1), last)).alias("_k", "status_code"))
    error = F.when(F.col("status_code") == 500, "internal error, retry").when(F.col("status_code") == 429, "rate limited").otherwise(F.col("_reply.error"))
    return rows.select(key, (F.col("_k") + 1).alias("attempt_number"), "status_code", error.alias("error"))


def push_questions(tries: DataFrame, key: str, policy: Policy = Policy()) -> DataFrame:
    """key, reason_code, signature, error of each payload whose last attempt failed: by error, quoted values left out."""
    last = tries.groupBy(key).agg(F.max_by(F.struct("status_code", "error"), "attempt_number").alias("x")).select(key, "x.*")
    code = F.when(F.col("status_code").isin(*policy.retry_on), "PUSH_UNREACHABLE").when(F.col("status_code").isin(*policy.escalate_on), "PUSH_REJECTED")
    return last.withColumn("reason_code", code).where("reason_code is not null").select(key, "reason_code", signature(F.col("reason_code"), target_error(F.coalesce("error", F.lit("")))).alias("signature"), "error")


def push_summary(classified: DataFrame, tries: DataFrame, key: str, policy: Policy = Policy()) -> DataFrame:
    """One row: unchanged, refused_unchanged, created, changed, incomplete; pushed, rejected, unreachable, retries; failure_rate, offer_rollback.

    classified: key, outcome (of delta(), or incomplete). tries: of what was sent.
    """
    names = ("unchanged", "refused_unchanged", "created", "changed", "incomplete")
    kinds = classified.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])
    last = tries.groupBy(key).agg(F.max_by("status_code", "attempt_number").alias("code"), F.max("attempt_number").alias("n"))
    gone = F.col("code").isin(*policy.retry_on)
    sent = last.agg(F.count_if(F.col("code") == 200).alias("pushed"), F.count_if((F.col("code") != 200) & ~gone).alias("rejected"), F.count_if(gone).alias("unreachable"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("retries"))
    rate = F.coalesce(F.try_divide(F.col("rejected").cast("double"), F.col("pushed") + F.col("rejected")), F.lit(0.0))
    return kinds.join(F.broadcast(sent), F.lit(True)).withColumn("failure_rate", F.round(rate, 6)).withColumn("offer_rollback", rate > policy.rollback_above)  # one row each


def repair_refusal(field: Column, value: Column, error: Column, current: Column, schema: tuple[Field, ...] = SCHEMA) -> Column:
    """Why a proposed repair may not be shown, or null: the first of seven checks that fails."""
    names = [f.name for f in schema]
    told = mentioned_fields(error, names)
    enums = F.create_map(*[x for f in schema if f.values for x in (F.lit(f.name), F.array(*map(F.lit, f.values)))])
    patterns = F.create_map(*[x for f in schema if f.pattern for x in (F.lit(f.name), F.lit(f.pattern))])
    empty = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    return (
        F.when(empty(field), "no field")
        .when(~field.isin(*names), "unknown field")
        .when((F.size(told) > 0) & ~F.array_contains(told, field), "field not mentioned")
        .when(empty(value), "empties the field")
        .when(F.coalesce(~F.array_contains(F.try_element_at(enums, field), value), F.lit(False)), "value not allowed")
        .when(F.coalesce(~F.regexp_like(value, F.concat(F.lit("^(?:"), F.try_element_at(patterns, field), F.lit(")$"))), F.lit(False)), "format not matched")
        .when(empty(current), "nothing to correct")
    )


def propose_repairs(refused: DataFrame, schema: tuple[Field, ...] = SCHEMA) -> DataFrame:
    """signature, error, field, rows: one proposal for each distinct error of a question, for the first field in schema order that it names.

    refused: signature, error. Errors that name no field have a null field, for a provider or a person.
    """
    named = F.filter(F.array(*[F.lit(f.name) for f in schema]), lambda n: F.array_contains(mentioned_fields(F.col("error"), [f.name for f in schema]), n))
    return refused.groupBy("signature", "error").agg(F.count("*").alias("rows")).select("signature", "error", F.get(named, F.lit(0)).alias("field"), "rows")


def apply_repairs(records: DataFrame, answers: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """records after answers (id, field, action, value): adds status and the rules that are asked about anew.

    A rejection excludes the record; an approval or edit sets the field's value and makes the record clean, or
    blocked if a rule is broken then; records without an answer keep all they have.
    """
    both = records.join(answers.select("id", F.col("field").alias("_f"), F.col("action").alias("_a"), F.col("value").alias("_v")), "id", "left")
    set_ = F.col("_a").isNotNull() & (F.col("_a") != "reject")
    types = dict(records.dtypes)
    for f in fields:
        both = both.withColumn(f, F.when(set_ & (F.col("_f") == f), F.col("_v").try_cast(types[f])).otherwise(F.col(f)))
    both = both.withColumn("asked", F.when(set_, broken_rules()).otherwise(F.array().cast("array<string>")))
    status = F.when(F.col("_a") == "reject", "excluded").when(set_, F.when(F.size("asked") > 0, "blocked").otherwise("clean")).otherwise(F.col("status"))
    return both.withColumn("status", status).select(*records.columns, "asked")


def rolled_back(state: DataFrame, tries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left of the target's state after a roll-back, and the keys that went: those delivered by these attempts."""
    gone = tries.where("status_code = 200").select(key).distinct()
    return state.join(gone, key, "left_anti"), gone
