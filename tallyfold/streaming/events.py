"""The event log as a stream: a tail from a cursor, running counts, ticks, and the delta of a stream of payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.operators.desk import TERMINAL

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tail(spark: SparkSession, path: str, cursor: int = -1, schema: str = EVENTS) -> DataFrame:
    """A stream of the events after the cursor, from a folder of Parquet files; a checkpoint makes it resume."""
    return spark.readStream.schema(schema).parquet(path).where(F.col("event_id") > cursor)


def running_counts(events: DataFrame) -> DataFrame:
    """Events and the last sequence number by kind, for output in complete or update mode."""
    return events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_seq"))


def running_questions(escalations: DataFrame) -> DataFrame:
    """Affected rows of each open question as they come in, for output in update mode. escalations: reason_code, signature, status."""
    return escalations.where("status = 'open'").groupBy("reason_code", "signature").agg(F.count("*").alias("affected_count"))


def windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and window of event time; later ones than `late` are left out. An extension of our own."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def ticks(frames: DataFrame, every: int = 500, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Every `every`th frame, and all frames that end a run: what a watcher is shown. Batches and streams alike."""
    return frames.where((F.col(seq) % every == 0) | F.col(kind).isin(*TERMINAL))


def first_outcomes(replies: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """The reply that a key got first: replays, in a batch or later in a stream, give nothing new."""
    return replies.dropDuplicates([key])


def delta_stream(payloads: DataFrame, key: str = "employee_id") -> DataFrame:
    """key, digest, outcome (created, changed, unchanged) of each payload of a stream, against the last digest of its key.

    payloads: key (text), digest. The state holds one digest a key; payloads of a key within a batch count in the
    order in which they come.
    """
    import pandas as pd

    def judge(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        for batch in batches:
            out = []
            for digest in batch["digest"]:
                out.append("created" if before is None else "unchanged" if digest == before else "changed")
                before = digest
            yield pd.DataFrame({key: [keys[0]] * len(out), "digest": batch["digest"].tolist(), "outcome": out})
        state.update((before,))

    return payloads.select(key, "digest").groupBy(key).applyInPandasWithState(judge, f"{key} string, digest string, outcome string", "digest string", "append", "NoTimeout")


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hand every micro-batch that there is to sink(batch, id), then stop; a rerun goes on where this ended."""
    stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def follow(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], kind: str = "event_type", stop: Callable[[], bool] = lambda: False, interval: str = "1 second", timeout: float | None = None) -> str:
    """Hand micro-batches to sink until one holds a frame that ends a run, or stop() says so: `finished`, `stopped` or `timeout`.

    The query stops between batches, with its checkpoint written: nothing is lost or done twice by a rerun.
    """
    import time

    seen = {"end": False}

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        sink(batch, number)
        seen["end"] = seen["end"] or not batch.where(F.col(kind).isin(*TERMINAL)).isEmpty()
        batch.unpersist()

    query: StreamingQuery = stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(each).start()
    until = time.time() + timeout if timeout else None
    try:
        while query.isActive:
            if seen["end"]:
                return "finished"
            if stop():
                return "stopped"
            if until and time.time() > until:
                return "timeout"
            query.awaitTermination(1)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return "stopped"
