"""A run from export files to a delivered, audited data set: import, answers, push, and roll-back or export."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.config import SCHEMA, Policy, Schema
from tallyfold.functions import fuzzy, text
from tallyfold.operators import delivery, desk, pairs
from tallyfold.operators import records as R
from tallyfold.sources import sinks

_STAGES = (("mapping", "mappings"), ("cleaning", "records"), ("reconciling", "merges"), ("pushed", "push_attempts"))


def header_scores(spark: SparkSession, headers: DataFrame, schema: tuple = SCHEMA) -> DataFrame:
    """header, field, field_ord, null_rate, score of every header and field: as many rows as columns of files times fields."""
    fields = spark.createDataFrame([(f.name, k) for k, f in enumerate(schema)], "field string, field_ord int")
    both = headers.join(F.broadcast(fields), F.lit(True))  # the schema's fields, a fixed few
    both = both.withColumns({"a": fuzzy.token_sorted(text.header(F.col("header"))), "b": fuzzy.token_sorted(text.header(F.col("field")))})
    return both.select("header", "field", "field_ord", "null_rate", fuzzy.ratio("a", "b").alias("score"))


def run_status(mapping_open: int, questions: int, pushed: int) -> tuple[str, bool, str]:
    """Stage, whether a person is waited for, and what a watcher is told."""
    if mapping_open:
        return "mapping", True, f"{mapping_open} questions about columns are open"
    if pushed:
        return "pushed", False, f"{pushed} records are delivered"
    if questions:
        return "reconciling", True, f"{questions} questions are open"
    return "reconciling", False, "ready to push"


class Run:
    """One run over a folder of tables. Each stage is written, and can be run again: it replaces its own rows.

    The policy is kept with the run as it was at its start. providers: data frames of a model's readings by name
    (values, verdicts, corrections); none of them is needed.
    """

    def __init__(self, spark: SparkSession, folder: str, run_id: str, schema: Schema | None = None, policy: Policy = Policy(), **providers: DataFrame):
        self.spark, self.folder, self.run_id, self.policy, self.providers = spark, folder, run_id, policy, providers
        self.fields = schema.fields if schema else SCHEMA
        kept = spark.createDataFrame([(run_id, repr(policy))], "id string, policy_snapshot string")
        self._write(kept, "runs", "start")

    def _write(self, df: DataFrame, table: str, stage: str) -> DataFrame:
        sinks.write_stage(df, self.folder, table, self.run_id, stage)
        return self.table(table, stage)

    def table(self, name: str, stage: str | None = None) -> DataFrame:
        rows = sinks.read_table(self.spark, self.folder, name)
        if rows is None:
            raise LookupError(f"{name} has not been written")
        rows = rows.where(F.col("run_id").cast("string") == self.run_id)
        return (rows.where(F.col("stage") == stage) if stage else rows).drop("run_id", "stage")

    # Entry A: import

    def import_(self, exports: dict[str, DataFrame]) -> DataFrame:
        """Profile every export (text columns), propose a mapping, and return the questions about columns.

        The proposals are read with the exports again by clean(): nothing of the exports is held.
        """
        self.exports = exports
        parts = []
        for ord_, (name, df) in enumerate(exports.items()):
            profile = R.profile(df, df.columns)
            scores = header_scores(self.spark, profile.select(F.col("name").alias("header"), "null_rate"), self.fields)
            parts.append(R.decide_mapping(scores, self.policy).select(F.lit(name).alias("filename"), F.lit(ord_).alias("file_ord"), "header", "target", "confidence", "decision"))
        mappings = self._write(functools.reduce(DataFrame.unionByName, parts), "mappings", "mapping")
        scope = F.concat_ws(":", "filename", "header")
        asked = mappings.where("decision <> 'accept'").select(F.col("decision").alias("reason_code"), scope.alias("scope_key"), R.signature(F.col("decision"), scope).alias("signature"), F.col("target").alias("suggested"))
        return self._write(asked, "escalations", "mapping")

    def mapped(self, answers: DataFrame | None = None) -> tuple[DataFrame, int]:
        """Mappings after answers (signature, action, value), and how many questions about columns stay open."""
        rows = self.table("mappings", "mapping")
        sig = R.signature(F.col("decision"), F.concat_ws(":", "filename", "header"))
        rows = rows.withColumn("signature", sig)
        if answers is None:
            answers = rows.limit(0).select("signature", F.lit("").alias("action"), F.lit("").alias("value"))
        both = desk.apply_mapping(
            rows.select(F.col("signature").alias("column_id"), "filename", "file_ord", "header", F.col("target").alias("target_field"), F.col("decision").alias("status")),
            answers.select(F.col("signature").alias("column_id"), "action", "value"),
        )
        return both, both.where(F.col("status").startswith("MAP_")).count()

    # Entry B: resume

    def resume(self, answers: DataFrame | None = None) -> DataFrame:
        """Clean, check and reconcile all exports by the answered mapping; returns the open questions, grouped."""
        mappings, waiting = self.mapped(answers)
        if waiting:
            raise RuntimeError(run_status(waiting, 0, 0)[2])
        rows = mappings.where("status = 'accept' or status = 'accepted'").where("target_field is not null").collect()  # columns of files
        names = [f.name for f in self.fields]
        parts = []
        for ord_, (name, df) in enumerate(self.exports.items()):
            target = {r["target_field"]: r["header"] for r in rows if r["filename"] == name}
            numbered = df.select("*", F.monotonically_increasing_id().alias("_row"))
            picked = [F.col(f"`{target[n]}`").cast("string").alias(n) if n in target else F.lit(None).cast("string").alias(n) for n in names]
            parts.append(numbered.select((F.lit(ord_).cast("long") * (1 << 48) + F.col("_row")).alias("id"), F.lit(name).alias("filename"), *picked))
        raw = self._write(functools.reduce(DataFrame.unionByName, parts), "source_rows", "cleaning")
        cleaned = R.clean_records(raw, self.fields, self.policy)
        checked = R.corrected(cleaned, "id", self.fields, self.providers.get("corrections"))
        checked = self._write(checked, "records", "cleaning")
        found = functools.reduce(DataFrame.unionByName, [R.issues(checked.where(F.col("filename") == name), "id", name) for name in self.exports])
        found = found.unionByName(R.twice(checked, "id"))
        clusters = R.cluster(checked, policy=self.policy).join(checked.select("id", "filename"), "id")
        clusters = self._write(clusters.withColumn("rank", R.source_rank(F.col("filename"), self.policy)), "clusters", "reconciling")
        self._write(desk.merges(clusters), "merges", "reconciling")
        material = tuple(f.name for f in self.fields if f.material)
        merged = R.survivorship(checked.join(clusters.select("id", "cluster_id"), "id"), names, self.policy, material, amount=("annual_ctc", "ctc_currency"))
        merged = self._write(merged, "survivorship", "reconciling")
        scope = F.concat_ws(":", "field", "sources")
        code = F.lit("CONFLICT_ACROSS_SOURCES")
        found = found.unionByName(merged.where("asks").select(code.alias("reason_code"), scope.alias("scope_key"), F.col("cluster_id").alias("entity_id"), R.signature(code, scope).alias("signature")))
        low, high = self.policy.ask_band
        band = pairs.candidate_pairs(checked, least=low - 1e-9).where(F.col("score").between(low, high) & (F.col("score") < high))
        if "verdicts" in self.providers:
            band = desk.judged(band, self.providers["verdicts"], self.policy.judge_most).where(~(F.col("verdict").eqNullSafe("different") & (F.coalesce("confidence", F.lit(0.0)) >= self.policy.separate_confidence)))
        scope = F.concat_ws("|", F.least(F.col("a_id").cast("string"), F.col("b_id").cast("string")), F.greatest(F.col("a_id").cast("string"), F.col("b_id").cast("string")))
        dupes = band.select(F.lit("DUPE_AMBIGUOUS").alias("reason_code"), scope.alias("scope_key"), F.col("a_id").alias("entity_id"), R.signature(F.lit("DUPE_AMBIGUOUS"), scope).alias("signature"))
        self._write(found.unionByName(dupes), "escalations", "reconciling")
        return self.questions()

    def questions(self) -> DataFrame:
        return R.grouped(self.table("escalations", "reconciling"), self.providers.get("decisions"))

    def survivors(self) -> DataFrame:
        """One row a cluster, each field's surviving value as text, with `blocked` where a question about the record is open."""
        wide = self.table("survivorship", "reconciling").groupBy("cluster_id").pivot("field", [f.name for f in self.fields]).agg(F.first("value"))
        held = self.table("escalations", "reconciling").where("reason_code in ('LOGIC_CONTRADICTION', 'VALIDATE_TWICE')").select(F.col("entity_id").alias("id"))
        held = held.join(self.table("clusters", "reconciling"), "id").select("cluster_id").distinct().withColumn("blocked", F.lit(True))
        return wide.join(held, "cluster_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))

    # Entry C: push

    def push(self, rate_500: float = 0.0, rate_429: float = 0.0) -> DataFrame:
        """Deliver complete survivors that have changed since the last push; returns one row of the push's counts."""
        payload = [f.name for f in self.fields]
        required = [F.coalesce(F.col(f.name), F.lit("")) == "" for f in self.fields if f.required]
        rows = self.survivors().where("not blocked").withColumn("incomplete", functools.reduce(lambda a, b: a | b, required))
        rows = rows.withColumn("digest", R.payload_digest(payload))
        now = rows.where("not incomplete").dropDuplicates(["employee_id"])
        state = self._state()
        refused = sinks.read_table(self.spark, self.folder, "refused")
        refused = refused.select("employee_id", "digest") if refused is not None else state.limit(0)
        classed = R.delta(now.select("employee_id", "digest"), state, refused)
        classed = self._write(classed.unionByName(rows.where("incomplete").select("employee_id", "digest", F.lit("incomplete").alias("outcome"))), "classified", "pushed")
        sent = now.join(classed.where("outcome in ('created', 'changed')").select("employee_id"), "employee_id", "left_semi")
        reply = delivery.target_reply(F.col("employee_id"), F.col("cost_center"), F.col("employment_type"), F.col("designation"), F.col("date_of_birth"))
        tries = self._write(delivery.attempts(sent, "employee_id", reply, self.policy, rate_500, rate_429), "push_attempts", "pushed")
        done = tries.where("status_code = 200").select("employee_id").distinct()
        digests = sent.select("employee_id", "digest")
        self._keep(state.join(done, "employee_id", "left_anti").unionByName(digests.join(done, "employee_id")), "pushed")
        asked = delivery.push_questions(tries, "employee_id", self.policy)
        self._write(asked.join(digests, "employee_id"), "refused", "pushed")
        return delivery.push_summary(classed, tries, "employee_id", self.policy)

    def _keep(self, state: DataFrame, stage: str) -> None:
        """The state of the target after this run, in the place of the one before, which is read until it is written."""
        self._write(state, "pushed_next", stage)
        sinks.write_stage(self.table("pushed_next", stage), self.folder, "pushed_state", "all", "current")

    def _state(self) -> DataFrame:
        rows = sinks.read_table(self.spark, self.folder, "pushed_state")
        return rows.select("employee_id", "digest") if rows is not None else self.spark.createDataFrame([], "employee_id string, digest string")

    # Entry D: roll back, export

    def rollback(self) -> int:
        """Take back what this run's push delivered; returns how many records went."""
        left, gone = delivery.rolled_back(self._state(), self.table("push_attempts", "pushed"), "employee_id")
        n = gone.count()
        self._keep(left, "rollback")
        return n

    def audit(self, ts: str) -> DataFrame:
        """An audit row for each field that survived a conflict, and for each record that was absorbed."""
        at = F.lit(ts)
        won = self.table("survivorship", "reconciling").where("conflict").select(F.lit("record").alias("entity_type"), F.col("cluster_id").cast("string").alias("entity_id"), "field", F.col("value").alias("after"), F.col("sources").alias("note"))
        gone = self.table("merges", "reconciling").select(F.lit("record").alias("entity_type"), F.col("absorbed_id").cast("string").alias("entity_id"), F.lit("status").alias("field"), F.lit("merged").alias("after"), F.col("survivor_id").cast("string").alias("note"))
        return sinks.audit_rows(won, "agent", at, stage="reconciling").unionByName(sinks.audit_rows(gone, "agent", at, stage="reconciling"))
