"""Where results go: tables of a run, event frames, audit rows, exports and reports. Every write is a Spark write."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: The columns of an audit export, in its order, and those of a table of audit rows.
AUDIT = ("ts", "actor", "stage", "reason_code", "entity_type", "entity_id", "field", "before", "after", "confidence", "rule_id", "model", "latency_ms", "note")
_TYPES = {"confidence": "double", "latency_ms": "long"}
#: Tables of a run; cached answers of models outlive a reset.
TABLES = ("runs", "source_files", "source_columns", "mappings", "records", "merges", "escalations", "decisions", "pushed_state", "push_attempts", "audit_events", "run_events", "llm_cache")
KEPT = ("llm_cache",)


def write_stage(df: DataFrame, folder: str, table: str, run_id: str, stage: str) -> None:
    """The rows of one stage of a run. A stage that is run again replaces its own rows, so a retry leaves no copies."""
    target = os.path.join(folder, table, f"run_id={run_id}", f"stage={stage}")
    df.write.mode("overwrite").parquet(target)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table's rows with run_id and stage, columns that were added later being null in older rows; None if it was never written."""
    try:
        return spark.read.option("mergeSchema", "true").option("basePath", os.path.join(folder, table)).parquet(os.path.join(folder, table))
    except AnalysisException:
        return None


def truncate_all(spark: SparkSession, folder: str) -> dict[str, int]:
    """Empty every table but what is kept, and return the rows that there were, where any."""
    out = {}
    for table in TABLES:
        rows = read_table(spark, folder, table) if table not in KEPT else None
        n = rows.count() if rows is not None else 0
        if n:
            out[table] = n
            path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, table))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def audit_rows(changes: DataFrame, actor: str, ts: Column, **given) -> DataFrame:
    """A row of the audit's columns for each change; before and after as text, what is neither given nor there being null.

    changes: any of the audit's columns. given: literals for others, such as stage or reason_code.
    """
    has = {**{c: F.col(c) for c in changes.columns if c in AUDIT}, **{k: F.lit(v) for k, v in given.items()}, "actor": F.lit(actor), "ts": ts}
    return changes.select(*[has.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in AUDIT])


def export_csv(audit: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of time, quoted where needed; nulls are empty. An export for a person's eyes."""
    audit.select(*AUDIT).orderBy("ts", "entity_id", "field").coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def export_json(df: DataFrame, path: str, *order: str) -> None:
    """One JSON file, an object a line, nulls kept: an audit export or a report."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def frames(messages: DataFrame, run_id: str, after: int, *order: str) -> DataFrame:
    """Event frames: seq, run_id, kind, stage, message, detail (JSON), numbered in order from `after` + 1.

    messages: kind, stage, message, detail (a map) and the order's columns. Numbers come from the places of a global
    sort, in two steps: a rank within each of its ranges, and the ranges' sizes before it.
    """
    spark = messages.sparkSession
    at = F.monotonically_increasing_id()
    placed = messages.orderBy(*order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    from tallyfold.plans.materialize import materialize

    placed = materialize(placed, "frames")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row a task of the sort
    bases, total = [], after + 1
    for row in sizes:
        bases.append((row["_part"], total))
        total += row["n"]
    based = placed.join(F.broadcast(spark.createDataFrame(bases, "_part long, _base long")), "_part")
    return based.select((F.col("_base") + F.col("_in")).alias("seq"), F.lit(run_id).alias("run_id"), "kind", "stage", "message", F.to_json("detail").alias("detail"))


def table_sink(folder: str, key: str):
    """A sink for a stream of payloads: each batch is written under its number, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(os.path.join(folder, f"batch={number}"))

    return write
