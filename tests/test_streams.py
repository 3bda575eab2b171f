"""Streams: the delta of payloads, running questions, replays, and following a run to its end."""

from pyspark.sql import functions as F

from tallyfold.sources.sinks import table_sink
from tallyfold.streaming import events as S


def test_delta_stream(spark, tmp_path):
    folder, got = str(tmp_path / "in"), []
    stream = lambda: S.delta_stream(spark.readStream.schema("employee_id string, digest string").parquet(folder))
    sink = lambda batch, _: got.extend(tuple(r) for r in batch.collect())
    spark.createDataFrame([("a", "1"), ("b", "1")], "employee_id string, digest string").coalesce(1).write.parquet(folder)
    S.drain(stream(), str(tmp_path / "c"), sink)
    spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9")], "employee_id string, digest string").coalesce(1).write.mode("append").parquet(folder)
    S.drain(stream(), str(tmp_path / "c"), sink)  # goes on where the first ended, with its state
    assert sorted(got) == [("a", "1", "created"), ("a", "1", "unchanged"), ("b", "1", "created"), ("b", "2", "changed"), ("c", "9", "created")]


def test_running_questions_and_replays(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("X", "s1", "open", "k1"), ("X", "s1", "open", "k2"), ("X", "s2", "resolved", "k2"), ("Y", "s1", "open", "k1")]
    spark.createDataFrame(rows, "reason_code string, signature string, status string, idempotency_key string").write.parquet(folder)
    read = spark.readStream.schema("reason_code string, signature string, status string, idempotency_key string").parquet(folder)
    seen, keys = {}, []
    S.drain(S.running_questions(read), str(tmp_path / "c1"), lambda b, _: seen.update({(r[0], r[1]): r[2] for r in b.collect()}), "update")
    assert seen == {("X", "s1"): 2, ("Y", "s1"): 1}
    S.drain(S.first_outcomes(read), str(tmp_path / "c2"), lambda b, _: keys.extend(r["idempotency_key"] for r in b.collect()))
    assert sorted(keys) == ["k1", "k2"]
    sink = table_sink(str(tmp_path / "out"), "idempotency_key")
    S.drain(read, str(tmp_path / "c3"), sink)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_follow(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = spark.range(5).selectExpr("id as event_id", "timestamp'2024-01-01' as ts", "id as user_id", "if(id = 4, 'finished', 'tick') as event_type", "0D as value", "'' as props")
    rows.write.parquet(folder)
    seen = []
    assert S.follow(S.tail(spark, folder, schema=schema), str(tmp_path / "c"), lambda b, _: seen.extend(r["event_id"] for r in b.collect()), timeout=60) == "finished"
    assert sorted(seen) == [0, 1, 2, 3, 4]
    assert S.follow(S.tail(spark, folder, schema=schema), str(tmp_path / "c2"), lambda b, _: None, kind="props", stop=lambda: True, timeout=60) == "stopped"
    frames = rows.select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    assert sorted(r["seq"] for r in S.ticks(frames, 2).collect()) == [0, 2, 4]
