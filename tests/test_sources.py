from __future__ import annotations

from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewheel.series import RunSpec, Series
from tidewheel.sources import files, generators, sinks

CSV = """TIME|SYMBOL|PRICE|SIZE
20200303 09:30:00|A|10.5|100
20200303 09:30:01|B|20.0|200
20200303 09:30:02|A|11.0|300
"""
RUN = RunSpec(datetime(2020, 3, 3, 9, 30), timedelta(minutes=1))


@pytest.fixture
def reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text(CSV)
    return files.read_csv(spark, str(tmp_path / "x.csv"), "TIME string, SYMBOL string, PRICE double, SIZE long", "TIME", sep="|", symbol="SYMBOL", run=RUN)


def test_csv(reader):
    assert [v for _, v in reader.subscribe("A", "PRICE").collect()] == [10.5, 11.0]
    with pytest.raises(ValueError):
        reader.subscribe_all("PRICE")
    assert reader.shifted(timedelta(seconds=59)).subscribe_all({"PRICE": "price", "SIZE": "n"}).df.count() == 2


def test_parquet_round_trip(spark, reader, tmp_path):
    basket = reader.subscribe_basket("PRICE")
    sinks.write_parquet(str(tmp_path / "p"), keys=("SYMBOL",), price=basket)
    again = files.read_parquet(spark, str(tmp_path / "p"), "ts", "SYMBOL", RUN).subscribe_basket("price")
    assert again.sorted().collect() == basket.sorted().collect()
    got = files.read_parquet(spark, [str(tmp_path / "p"), str(tmp_path / "none")], "ts", run=RUN, allow_missing_files=True)
    assert got.subscribe_all("price").df.count() == 3


def test_overlapping_files(spark, tmp_path):
    for k, seconds in enumerate(([0, 1, 2], [1, 2, 3])):
        spark.createDataFrame([(RUN.start + timedelta(seconds=t), k) for t in seconds], "ts timestamp_ntz, v int").write.parquet(str(tmp_path / str(k)))
    r = files.read_parquet(spark, [str(tmp_path / "0"), str(tmp_path / "1")], "ts", run=RUN, allow_overlapping_periods=True)
    assert [v for _, v in r.subscribe_all("v").collect()] == [0, 0, 0, 1]


def test_arrow_and_batches(spark):
    t = pa.table({"ts": pa.array([RUN.start, RUN.start, RUN.start + timedelta(seconds=1)], pa.timestamp("us")), "v": [1, 2, 3]})
    assert files.read_arrow(spark, [t, t.slice(2)], "ts", run=RUN).subscribe_all("v").df.count() == 4
    lists = files.record_batches(spark.createDataFrame(t)).collect()
    assert [len(v) for _, v in lists] == [2, 1]


def test_dict_basket(spark):
    df = spark.createDataFrame([(1, RUN.start, 2, "a", 1.0), (2, RUN.start + timedelta(seconds=1), 1, "b", 2.0), (3, RUN.start + timedelta(seconds=2), 0, "c", 3.0)], "n long, ts timestamp_ntz, c int, s string, v double")
    got = files.read_dict_basket(df, "v", "s", "c", "ts", ["n"]).df.select("symbol", F.second("ts").alias("t"), "value").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 1.0), ("b", 0, 2.0), ("c", 1, 3.0)]


def test_json(spark):
    x = generators.curve(spark, RUN, [(timedelta(0), '{"a": 1, "t": 1500}')], str)
    v = files.from_json(x, "struct<a: long, t: long>", {"t": "ms"}).collect()[0][1]
    assert (v["a"], v["t"]) == (1, datetime(1970, 1, 1, 0, 0, 1, 500000))


def test_frames_and_matrices(spark):
    run = RunSpec(RUN.start, timedelta(seconds=5))
    n = generators.timer(spark, run, timedelta(seconds=1), 1)
    got = sinks.frames(generators.timer(spark, run, timedelta(seconds=2)), 2, x=n).collect()
    assert [len(v["x"]) for _, v in got] == [2, 2]
    m = generators.curve(spark, run, [(timedelta(0), [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])], list[list[float]])
    assert sinks.reshape_array(sinks.flatten_array(m)).collect() == m.collect()
    assert sinks.to_pandas(run, x=n)["x"].tolist() == [1] * 5
    assert sinks.last_ticks(n, 2)[-1][1] == 1


def test_time_zones():
    from zoneinfo import ZoneInfo

    assert RunSpec(datetime(2020, 1, 1, 12, tzinfo=ZoneInfo("America/New_York")), timedelta(hours=1)).start.hour == 17
    with pytest.raises(ValueError):
        RunSpec(datetime(2020, 1, 2), datetime(2020, 1, 1))


def test_series_of_numbers_ties(spark):
    df = spark.createDataFrame([(RUN.start, 2, 5.0), (RUN.start, 1, 4.0)], "ts timestamp_ntz, n int, value double")
    assert [v for _, v in Series.of(df, order=("n",), unique=False).collect()] == [4.0, 5.0]
