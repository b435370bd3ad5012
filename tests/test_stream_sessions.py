"""Sessions of a stream: state between runs, late rows, restarts, against the same rows as a table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import intervals
from siltstone.streaming import sessions as stream

KIND = "k string, t timestamp_ntz, v long"


@pytest.fixture
def place(spark, tmp_path):
    at = str(tmp_path)
    schema = spark.createDataFrame([], KIND).schema

    def add(rows):
        spark.createDataFrame([(k, f"2024-01-01 {t}" if t else None, v) for k, t, v in rows], "k string, t string, v long").withColumn("t", F.col("t").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{at}/in")

    def run(**more):
        return stream.append_sessions(spark, f"{at}/in", schema, f"{at}/out", f"{at}/state", ["k"], "t", "10 minutes", "5 minutes", "v", **more)

    def out():
        return Counter((r.k, r.n, r.total) for r in spark.read.schema("k string, started long, ended long, n long, total long").parquet(f"{at}/out").collect())

    return add, run, out, lambda: stream.close(spark, f"{at}/in", schema, "t"), at


def test_late_rows_are_dropped_and_counted(place):
    add, run, out, close, _ = place
    add([("a", "00:00:00", 1), ("a", "00:09:00", 2), ("b", "01:00:00", 1), (None, "00:30:00", 4), ("a", None, 9)])
    first = run()
    assert (first.rows, first.late) == (5, 0) and out() == {("a", 2, 3): 1, (None, 1, 4): 1}  # b is open
    add([("a", "00:05:00", 100), ("a", "00:44:59.999999", 100), ("a", "00:45:00.000001", 7), ("b", "01:10:00", 1), ("b", "00:56:00", 1)])
    second = run()
    # the watermark stood at 00:55, so a row is late where its session of ten minutes alone had ended by then
    assert (second.rows, second.late) == (5, 2)
    close()
    last = run()
    assert (last.rows, last.late) == (1, 0) and last.open == 1  # the closing row's own
    assert out() == {("a", 2, 3): 1, (None, 1, 4): 1, ("a", 1, 7): 1, ("b", 3, 3): 1}
    add([("b", "01:12:00", 5)])
    assert run().late == 1


def test_stream_equals_table_whatever_the_batches(spark, place):
    add, run, out, close, at = place
    rows = [(k, f"{h:02}:{m:02}:00", h * m % 7) for k in ("a", "b", None) for h in range(3) for m in range(k == "b", 60, 11 if k == "a" else 7)]
    for i in range(4):
        add(sorted(rows, key=lambda r: r[1])[i::4])
    close()
    # all files lie there at once: the batches follow the order of writing, in which every batch holds all hours
    p = run(files_per_batch=5)
    assert p.rows == len(rows) + 1 and p.late == 0
    table = spark.read.parquet(f"{at}/in").where("t < '2025-01-01'")
    want = Counter((r.k, r.n, r.total) for r in intervals.sessions(table, ["k"], "t", 600_000_000, "v").collect())
    assert out() == want
    batch = stream.sessions(table, ["k"], "t", "10 minutes", "5 minutes", "v")
    assert Counter((r.k, r.n, r.total) for r in batch.collect()) == want


def test_a_run_without_new_files_changes_nothing(place):
    add, run, out, _, _ = place
    add([("a", "00:00:00", 1), ("b", "02:00:00", 1)])
    run()
    before = out()
    again = run()
    assert (again.rows, again.late) == (0, 0) and out() == before == {("a", 1, 1): 1}
