from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewheel import streaming
from tidewheel.operators.folds import Context

SCHEMA = "k string, ts timestamp_ntz, cycle int, name string, value double"


def rows(n):
    return [("ab"[i % 2], datetime(2020, 1, 1) + timedelta(seconds=i), 0, "x", float(i)) for i in range(n)]


def test_fold_keeps_state_over_batches(spark, tmp_path):
    def running(c: Context) -> None:
        c.state["sum"] += c.values["x"]
        c.emit(c.state["sum"])

    got = []
    for part in (rows(4), rows(8)[4:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = streaming.fold(streaming.read_files(spark, str(tmp_path / "in"), SCHEMA), ("k",), running, "double", {"sum": 0.0})
        streaming.catch_up(df, lambda b, _: got.extend(b.collect()), str(tmp_path / "c"))
    assert {r["k"]: r["value"] for r in sorted(got, key=lambda r: r["ts"])} == {"a": 12.0, "b": 16.0}
    assert len(got) == 8


def test_tumbling(spark, tmp_path):
    spark.createDataFrame(rows(20), SCHEMA).write.parquet(str(tmp_path / "in"))
    df = streaming.tumbling(streaming.read_files(spark, str(tmp_path / "in"), SCHEMA), ("k",), "5 seconds", "1 second", n=F.count("*"))
    got = []
    streaming.catch_up(df, lambda b, _: got.extend(b.collect()), str(tmp_path / "c"), "update")
    assert sum(r["n"] for r in got) == 20 and len(got) == 8


def test_sliding(spark, tmp_path):
    spark.createDataFrame(rows(20), SCHEMA).write.parquet(str(tmp_path / "in"))
    df = streaming.sliding(streaming.read_files(spark, str(tmp_path / "in"), SCHEMA), ("k",), "10 seconds", "5 seconds", "1 second", n=F.count("*"))
    got = []
    streaming.catch_up(df, lambda b, _: got.extend(b.collect()), str(tmp_path / "c"), "update")
    assert sum(r["n"] for r in got) == 40 and max(r["n"] for r in got) == 5


def test_alarms_come_without_further_ticks(spark, tmp_path):
    """A bucket is closed by its deadline: before a later tick of its key, or
    once the other keys have moved on; a cancelled one never."""

    def bucket(c: Context) -> None:
        if c.ticked("x"):
            if c.state["open"]:
                c.cancel(c.state["open"])
            c.state["open"] = c.schedule("deadline", timedelta(seconds=5))
        if c.ticked("deadline"):
            c.emit(c.values["x"])

    start = datetime(2020, 1, 1)
    at = lambda k, s, v: (k, start + timedelta(seconds=s), 0, "x", v)
    got = []
    for part in ([at("a", 0, 1.0), at("a", 2, 2.0), at("b", 1, 3.0)], [at("b", 60, 4.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = streaming.fold(streaming.read_files(spark, str(tmp_path / "in"), SCHEMA), ("k",), bucket, "double", {"open": None}, late="1 second")
        streaming.catch_up(df, lambda b, _: got.extend(b.collect()), str(tmp_path / "c"))
    assert sorted((r["k"], (r["ts"] - start).seconds, r["value"]) for r in got) == [("a", 7, 2.0), ("b", 6, 3.0)]


def test_status_and_live(spark, tmp_path):
    spark.createDataFrame(rows(4), SCHEMA).write.parquet(str(tmp_path / "in"))
    seen, got = streaming.Status(), []
    spark.streams.addListener(seen)
    live = streaming.go_live(streaming.read_files(spark, str(tmp_path / "in"), SCHEMA), lambda b, _: got.extend(b.collect()), str(tmp_path / "c"), "0 seconds")
    live.processAllAvailable()
    live.stop()
    spark.streams.removeListener(seen)
    assert len(got) == 4 and any(level == "info" for level, _, _ in seen.seen)
