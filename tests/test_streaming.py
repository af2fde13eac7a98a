"""Streams against the batch operators on the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.streaming import events as E

SCHEMA = "k string, ts timestamp, active boolean, id long"
T0 = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, name, batches, build, mode="append"):
    src = f"{tmp_path}/{name}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{src}/b={i}")
    stream = spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        q.stop()
    return spark.table(name).collect()


def row(k, minute, active, i=0):
    return (k, T0 + dt.timedelta(minutes=minute), active, i)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    batches = [[row("a", m, m % 20 == 0) for m in range(0, 60, 10)], [row("a", 130, True), row("b", 131, False)], [row("b", 140, True)], [row("a", 5, True), row("a", 400, True)], [row("a", 800, True)]]
    got = feed(spark, tmp_path, "win", batches, lambda s: E.windowed_activity(s, "k", "ts", "active"))
    first = next(r for r in got if r.k == "a" and r.start == T0)
    assert (first.n, first.active_share) == (6, 0.5)
    assert {(r.k, r.n) for r in got} >= {("a", 6), ("a", 1), ("b", 2)}


def test_repeats_fall_out(spark, tmp_path):
    batches = [[row("a", 0, True, 1), row("a", 1, True, 2)], [row("a", 2, True, 1), row("a", 3, True, 3)]]
    got = feed(spark, tmp_path, "dup", batches, lambda s: E.first_of_each(s, "id", "ts").select("id"))
    assert sorted(r.id for r in got) == [1, 2, 3]


def test_runs_over_batches(spark, tmp_path):
    batches = [[row("a", 0, True), row("a", 1, True), row("a", 2, False)], [row("a", 3, False), row("a", 4, True)], [row("z", 300, True)], [row("z", 301, True)]]
    got = feed(spark, tmp_path, "runs", batches, lambda s: E.activity_runs(s, "k", "ts", "active"))
    assert [(r.k, r.active, r.n) for r in sorted(got, key=lambda r: r.start)][:2] == [("a", True, 2), ("a", False, 2)]
    assert ("a", True, 1) in {(r.k, r.active, r.n) for r in got}


def test_batch_windows_agree(spark, tmp_path):
    rows = [row("a", m, m % 3 == 0) for m in range(0, 300, 7)]
    got = feed(spark, tmp_path, "agree", [rows, [row("end", 5000, True)], [row("end", 9000, True)]], lambda s: E.windowed_activity(s, "k", "ts", "active"))
    want = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("ts", "1 hour").start.alias("s")).count().collect()
    assert {(r.start, r.n) for r in got if r.k == "a"} == {(r.s, r["count"]) for r in want}
