from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewheel.frame import Frame
from tidewheel.operators import algebra as a
from tidewheel.operators import dynamics as dy
from tidewheel.plans import profile
from tidewheel.series import RunSpec, Series
from tidewheel.sources import adapters
from tidewheel.sources import generators as g

RUN = RunSpec(datetime(2020, 1, 1), timedelta(seconds=10))


def curve(spark, data, kind=float):
    return g.curve(spark, RUN, [(timedelta(seconds=t), v) for t, v in data], kind)


def test_frame(spark):
    x, y = Frame(p=curve(spark, [(1, 2.0), (2, 4.0)])), Frame(p=curve(spark, [(1, 1.0), (3, 0.0)]))
    assert [v for _, v in (x / y).p.collect()] == [2.0, 4.0, float("inf")]
    assert [v for _, v in (10 - x).p.collect()] == [8.0, 6.0] and [v for _, v in (x >= 4).p.collect()] == [False, True]
    assert x[["p"]].columns == ["p"] and [v for _, v in x[(x > 3).p].p.collect()] == [4.0]
    assert len(x.snap().to_pandas()) == 1
    with pytest.raises(KeyError):
        x + Frame(q=x.p)
    with pytest.raises(AttributeError):
        x.q


def test_values_between(spark):
    x = curve(spark, [(0, 1.0), (3, 2.0), (6, 3.0)])
    last = lambda *p: [(e["ts"].second, e["value"]) for e in dy.values_between(x, timedelta(seconds=4), timedelta(seconds=3), *p).collect()[-1][1]]
    assert last() == [(3, 2.0)] and last(dy.Range.EXTRAPOLATE) == [(2, 1.0), (3, 2.0)] and last(dy.Range.INCLUSIVE, dy.Range.EXCLUSIVE) == []


def test_delayed(spark):
    d = dy.Delayed()
    with pytest.raises(RuntimeError):
        _ = d.out
    d.bind(curve(spark, [(1, 1.0)]))
    assert len(d.out.collect()) == 1
    m = dy.DelayedDemultiplex(curve(spark, [(1, 1.0), (2, 2.0)]), curve(spark, [(0, "a"), (2, "b")], str))
    one = m.demultiplex("b")
    assert [v for _, v in one().collect()] == [2.0]


def test_structs(spark):
    t = dy.define_struct(a=int, b={"c": float})
    assert t.simpleString() == "struct<a:bigint,b:struct<c:double>>"
    row = spark.range(1).select(dy.update(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")), F.struct(F.lit(None).cast("int").alias("a"), F.lit(5).alias("b")), ["a", "b"]).alias("v")).first()
    assert tuple(row["v"]) == (1, 5)


def test_pull_source(spark):
    def seconds(run, part):
        for k in range(5):
            yield run.start + timedelta(seconds=k), float(k + part)

    assert [v for _, v in adapters.pull(spark, RUN, "double", seconds).collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_push_folder(spark, tmp_path):
    from tidewheel import streaming

    push, stream = adapters.push_folder(spark, str(tmp_path / "in"), "double")
    push([("2020-01-01T00:00:00", 1.0)])
    push([("2020-01-01T00:00:01", 2.0)])
    got = []
    streaming.catch_up(stream, lambda b, _: got.extend(b.collect()), str(tmp_path / "c"))
    assert sorted(r["value"] for r in got) == [1.0, 2.0]


def test_plans_push_down_and_shuffle_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type = 'view'")
    s = Series.of(df, keys=("user_id",), unique=True)
    info = profile.graph_info(a.count(s).df)
    assert info["shuffles"] == 1 and "EqualTo(event_type,view)" in info["pushed"][0] and "props" not in info["read"][0]
    assert profile.graph_info(a.sample(s, s).df)["shuffles"] == 1
    made = []
    f = profile.memoize(lambda n: made.append(n) or n)
    assert f(1) == f(1) == 1 and made == [1]
