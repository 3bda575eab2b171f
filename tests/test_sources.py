from tallyfold.sources.exports import as_records, read_csv
from tallyfold.streaming.events import drain, running_counts, tail


def test_csv(spark, tmp_path):
    (tmp_path / "payroll_dump.csv").write_text('Export\nid, mail ,note\n1,a@x,"two\nlines"\n\n2\n3,c@x,n,extra\n', newline="")
    rows = as_records(read_csv(spark, str(tmp_path)), {"id": "employee_id", "mail": "work_email"}).orderBy("_row_ord").collect()
    assert [(r["employee_id"], r["work_email"]) for r in rows] == [("1", "a@x"), (None, None), ("2", None), ("3", "c@x")]


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    got = []
    for _ in range(2):  # the second run finds nothing new
        drain(tail(spark, str(tmp_path / "in"), 10), str(tmp_path / "state"), lambda batch, _: got.append((batch.count(), running_counts(batch).count())))
    assert sum(n for n, _ in got) == events.where("event_id > 10").count()
