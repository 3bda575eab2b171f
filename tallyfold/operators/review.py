"""Answers, fills, repairs and the target's verdicts: what happens to records after a question is put."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.config import Policy
from tallyfold.operators.records import broken_rules

#: What the target accepts.
COST_CENTERS = ("CC-100", "CC-200", "CC-300", "CC-400", "CC-500")
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract")
DESIGNATIONS = (
    "Software Engineer", "Senior Software Engineer", "Engineering Manager", "Data Analyst", "Business Analyst", "Sales Executive", "Account Manager",
    "HR Specialist", "Finance Analyst", "Operations Manager", "Customer Support Associate", "Legal Counsel", "Marketing Specialist", "Director",
)


def resolve(open_: DataFrame, answers: DataFrame) -> DataFrame:
    """Open questions with the answer to their reason and signature: adds action, value, status.

    open_: reason_code, signature, suggested and more; answers: reason_code, signature, action (approve, edit,
    reject), typed. An approval takes the row's own suggestion and leaves rows without one open; a rejection
    resolves without a value; rows without an answer stay open.
    """
    joined = open_.join(answers, ["reason_code", "signature"], "left")
    value = F.when(F.col("action") == "approve", F.col("suggested")).when(F.col("action") == "edit", F.col("typed"))
    stays = F.col("action").isNull() | ((F.col("action") == "approve") & F.col("suggested").isNull())
    return joined.select(*open_.columns, "action", value.alias("value"), F.when(stays, "open").otherwise("resolved").alias("status"))


def requestion(asked: DataFrame, failing: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with an outcome: superseded (asked, no longer failing), new (failing, not asked) or stays."""
    both = asked.select(*keys).distinct().withColumn("a", F.lit(True)).join(failing.select(*keys).distinct().withColumn("f", F.lit(True)), keys, "full")
    return both.select(*keys, F.when(F.col("f").isNull(), "superseded").when(F.col("a").isNull(), "new").otherwise("stays").alias("outcome"))


def judge_fills(records: DataFrame, rule: str, field: str, proposed: Column) -> DataFrame:
    """Records that break `rule`, with `field` filled as proposed where it is null.

    Adds newly_broken (rules that the fill breaks), unfixed (the rule is still broken) and accepted.
    """
    before = records.withColumn("_before", broken_rules()).where(F.array_contains("_before", rule))
    after = before.withColumn(field, F.coalesce(F.col(field), proposed)).withColumn("_after", broken_rules())
    newly, unfixed = F.array_except("_after", "_before"), F.array_contains("_after", rule)
    return after.select(*records.columns, newly.alias("newly_broken"), unfixed.alias("unfixed"), ((F.size(newly) == 0) & ~unfixed).alias("accepted"))


def target_verdict(cost_center: Column, employment_type: Column, designation: Column, born: Column) -> Column:
    """The field for which the target refuses a payload, or null; the first failure wins, absent values pass, a birth date is needed."""
    odd = lambda c, allowed: F.coalesce((c != "") & ~c.isin(*allowed), F.lit(False))
    out = F.when(odd(cost_center, COST_CENTERS), "cost_center").when(odd(employment_type, EMPLOYMENT_TYPES), "employment_type")
    return out.when(odd(designation, DESIGNATIONS), "designation").when(F.coalesce(born, F.lit("")) == "", "date_of_birth")


def delivery_decision(status: Column, attempt: Column, policy: Policy = Policy()) -> Column:
    """retry while the policy's retries last, then PUSH_UNREACHABLE; PUSH_REJECTED; or done."""
    again = status.isin(*policy.retry_on)
    return F.when(again & (attempt <= policy.retries), "retry").when(again, "PUSH_UNREACHABLE").when(status.isin(*policy.escalate_on), "PUSH_REJECTED").otherwise("done")


def pair_decision(score: Column, verdict: Column, confidence: Column, policy: Policy = Policy()) -> Column:
    """merge, separate or ask; in the band a confident verdict of `different` separates, nothing else closes it."""
    low, high = policy.ask_band
    apart = (verdict == "different") & (confidence >= policy.separate_confidence)
    return F.when(score >= high, "merge").when(score < low, "separate").when(F.coalesce(apart, F.lit(False)), "separate").otherwise("ask")


def upsert(before: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The snapshot after new rows: of each key the row with the greatest `order`; of equal ones a new row wins."""
    both = before.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_new", "_nth")


def insert_new(before: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The first writer of a key wins: before, and of new the rows of keys that before lacks, one a key."""
    fresh = new.join(before.select(*keys).distinct(), keys, "left_anti")
    cols = [c for c in new.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in cols])
    return before.unionByName(first)


def transitions(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Audit rows: key, field, before, after of each row whose column changed, nulls compared too."""
    both = before.select(key, F.col(column).alias("before")).join(after.select(key, F.col(column).alias("after")), key)
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, F.lit(column).alias("field"), "before", "after")


def compare_pairs(records: DataFrame, pairs: DataFrame, fields: list[str]) -> DataFrame:
    """a_id, b_id, field, a_value, b_value, differs: the two records of each pair side by side; null counts as empty."""
    side = lambda p: records.select(F.col("id").alias(f"{p}_id"), F.struct(*fields).alias(p))
    both = pairs.select("a_id", "b_id").join(side("a"), "a_id").join(side("b"), "b_id")
    cell = [F.struct(F.lit(f).alias("field"), F.col("a")[f].alias("a_value"), F.col("b")[f].alias("b_value")) for f in fields]
    out = both.select("a_id", "b_id", F.explode(F.array(*cell)).alias("x")).select("a_id", "b_id", "x.*")
    return out.withColumn("differs", F.coalesce("a_value", F.lit("")) != F.coalesce("b_value", F.lit("")))


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration like 2m59.5s, 1h2m or 350ms; null where it is none."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    whole = text.rlike(r"^(?:\d+(?:\.\d+)?(?:ms|h|m|s))+$")
    return F.when(whole, part("h") * 3600 + part("m(?!s)") * 60 + part("s") + part("ms") / 1000)
