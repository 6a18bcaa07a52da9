"""Matrices with weights, random motions, messages, batches, frames of structs."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewheel import streaming
from tidewheel.frame import Frame
from tidewheel.functions import stats as st
from tidewheel.functions.stats import Rules
from tidewheel.operators import algebra as a
from tidewheel.operators import baskets as b
from tidewheel.operators import folds
from tidewheel.series import RunSpec, Series
from tidewheel.sources import files, sinks
from tidewheel.sources import generators as g

RUN = RunSpec(datetime(2020, 1, 1), timedelta(hours=1))


def s(n: float) -> timedelta:
    return timedelta(seconds=n)


def values(x: Series) -> list:
    return [r["value"] for r in x.sorted().collect()]


def arrays(spark) -> Series:
    return g.curve(spark, RUN, [(s(k), [float(k), float(k * k), float(-k % 3)]) for k in range(1, 5)], list[float])


@pytest.mark.parametrize("weighted", [False, True])
def test_matrices(spark, weighted):
    w = [1.0, 2.0, 1.0, 3.0]
    weights = g.curve(spark, RUN, [(s(k + 1), v) for k, v in enumerate(w)], float) if weighted else None
    m = np.array([[k, k * k, -k % 3] for k in range(1, 5)], float).T
    fw = np.array(w, int) if weighted else None
    size = 3 if weighted else None
    got = values(st.cov_matrix(arrays(spark), Rules(4), weights=weights, size=size))
    assert len(got) == 1 and np.allclose(got[0], np.cov(m, fweights=fw))
    flat = np.cov(m, fweights=fw)
    want = flat / np.sqrt(np.outer(np.diag(flat), np.diag(flat)))
    assert np.allclose(values(st.corr_matrix(arrays(spark), Rules(4), weights=weights, size=size))[0], want)


def test_matrices_at_a_trigger(spark):
    trigger = g.curve(spark, RUN, [(s(3.5), True)], bool)
    m = np.array([[k, k * k, -k % 3] for k in range(1, 4)], float).T
    got = values(st.cov_matrix(arrays(spark), Rules(3, trigger=trigger), size=3))
    assert len(got) == 1 and np.allclose(got[0], np.cov(m))
    assert values(st.each_element(st.sum, arrays(spark), Rules(3, trigger=trigger), size=3)) == [[6.0, 14.0, 3.0]]
    with pytest.raises(ValueError):
        st.cov_matrix(arrays(spark), Rules(3, trigger=trigger))


def test_shape_across_members(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(6, 5))
    rows[3] = 2.0
    ticks = [(RUN.start + s(k), j, float(v)) for k, r in enumerate(rows) for j, v in enumerate(r)]
    basket = Series.of(spark.createDataFrame(ticks, "ts timestamp_ntz, j int, value double"), keys=("j",), unique=True)
    frame = pd.DataFrame(rows)
    assert np.allclose(values(b.reduce_members(basket, "j", list(range(5)), "skew")), frame.skew(axis=1))
    assert np.allclose(values(b.reduce_members(basket, "j", list(range(5)), "kurt")), frame.kurt(axis=1))
    few = Series(basket.df.where("j < 2"), ("j",))
    assert np.isnan(values(b.reduce_members(few, "j", [0, 1], "skew"))).all() and np.isnan(values(b.reduce_members(few, "j", [0, 1], "kurt"))).all()


def test_motion_with_changing_parameters(spark):
    """No noise, so that the walk is the integral of its drift."""
    drift = g.curve(spark, RUN, [(s(2), [1.0, 0.0]), (s(5), [-2.0, 1.0])], list[float])
    trigger = g.timer(spark, RUN, s(1))
    none = [[0.0, 0.0], [0.0, 0.0]]
    got = dict(g.brownian_motion(spark, RUN, trigger, drift, none, 1).collect())
    assert min(got) == RUN.start + s(2) and list(got[RUN.start + s(2)]) == [0, 0]
    assert list(got[RUN.start + s(5)]) == [3, 0] and list(got[RUN.start + s(7)]) == [-1, 2]
    half = g.timer(spark, RUN, s(3))
    steps = dict(g.brownian_motion(spark, RUN, half, drift, none, 1, return_increments=True).collect())
    assert list(steps[RUN.start + s(3)]) == [1, 0] and list(steps[RUN.start + s(6)]) == [0, 1]


def test_motion_with_changing_variance(spark):
    variance = g.curve(spark, RUN, [(s(0), 0.0), (s(1800), 4.0)], float)
    got = np.array(values(g.brownian_motion_1d(spark, RUN, g.timer(spark, RUN, s(1)), 0.0, variance, 7, return_increments=True)))
    assert (got[:1799] == 0).all() and 3.4 < got[1800:].var() < 4.6
    fixed = values(g.brownian_motion_1d(spark, RUN, g.timer(spark, RUN, s(60)), 0.5, 1.0, 7))
    held = values(g.brownian_motion_1d(spark, RUN, g.timer(spark, RUN, s(60)), g.curve(spark, RUN, [(s(0), 0.5)], float), 1.0, 7))
    assert len(fixed) == len(held) > 50


MESSAGES = "key string, value binary, ts timestamp_ntz, partition int, offset long, topic string"


def messages(spark):
    at = [5, 3, 9, 1]
    rows = [("ab"[k % 2], json.dumps({"p": k / 2, "n": k, "t": 1_577_836_800_000 + k}).encode(), RUN.start + s(t), 0, k, "x") for k, t in enumerate(at)]
    return spark.createDataFrame([*rows, ("a", b"no json", RUN.start + s(20), 0, 9, "x")], MESSAGES)


def test_messages(spark):
    df = messages(spark)
    schema = "p double, n long, t long"
    got = streaming.decode_messages(df, schema, {"p": "price", "t": "time"}, {"offset": "o", "live": "l", "key": "k"}, epoch={"t": "ms"}, live_from=RUN.start + s(5)).orderBy("value.o").collect()
    assert [(r["value"]["price"], r["value"]["o"], r["value"]["l"], r["value"]["k"]) for r in got] == [(0.0, 0, True, "a"), (0.5, 1, False, "b"), (1.0, 2, True, "a"), (1.5, 3, False, "b"), (None, 9, True, "a")]
    assert got[3]["value"]["time"] == RUN.start + timedelta(milliseconds=3)
    assert [r["value"] for r in streaming.decode_messages(df, schema, "n", key="b").orderBy("value").collect()] == [1, 3]
    assert streaming.decode_messages(df).where("value = 'no json'").count() == 1
    seconds = lambda d: [(r["ts"] - RUN.start).total_seconds() for r in d.orderBy("value").collect()]
    assert seconds(streaming.decode_messages(df, schema, "n", adjust_out_of_order_time=True).where("value is not null")) == [5, 5, 9, 9]
    assert seconds(streaming.decode_messages(df, schema, "n", start=RUN.start + s(4)).where("value is not null")) == [5, 4, 9, 4]
    assert seconds(streaming.decode_messages(df, schema, "n", start=RUN.start + s(4), include_before_start=False).where("value is not null")) == [5, 9]
    timed = streaming.decode_messages(df, schema, epoch={"t": "ms"}, time_field="t").where("value.n = 2").first()
    assert timed["ts"] == RUN.start + timedelta(milliseconds=2)


def test_wrong_messages(spark):
    df = messages(spark)
    for bad in ({"meta_field_map": {"topic": "t"}}, {"meta_field_map": {"timestamp": "t"}, "time_field": "t"}, {"field_map": "p", "meta_field_map": {"key": "k"}}):
        with pytest.raises(ValueError):
            streaming.decode_messages(df, "p double", **bad)


def test_messages_of_a_stream(spark, tmp_path):
    messages(spark).write.parquet(str(tmp_path / "in"))
    rows = streaming.read_files(spark, str(tmp_path / "in"), MESSAGES)
    with pytest.raises(ValueError):
        streaming.decode_messages(rows, "n long", "n", adjust_out_of_order_time=True)
    got = []
    streaming.catch_up(streaming.decode_messages(rows, "n long", "n"), lambda d, _: got.extend(d.collect()), str(tmp_path / "c"))
    assert sorted(r["value"] for r in got if r["value"] is not None) == [0, 1, 2, 3]


def test_encoded_messages(spark):
    df = spark.createDataFrame([((1.5, 2),)], "v struct<price: double, n: long>")
    got = df.select(streaming.encode_messages(F.col("v")).alias("a"), streaming.encode_messages(F.col("v"), {"price": "p"}).alias("b"), streaming.encode_messages(F.col("v.n"), "m").alias("c")).first()
    assert [json.loads(bytes(x)) for x in got] == [{"price": 1.5, "n": 2}, {"p": 1.5}, {"m": 2}]


def test_record_batches(spark, tmp_path):
    rows = [(RUN.start + s(k // 5), float(k), k) for k in range(23)]
    x = files.record_batches(spark.createDataFrame(rows, "ts timestamp_ntz, a double, n long"))
    out = sinks.to_record_batches(x, {"n": "number"}, 2)
    assert [[len(c) for c in v] for v in values(out)] == [[2, 2, 1]] * 4 + [[2, 1]]
    assert [len(v) for v in values(sinks.to_record_batches(x, max_batch_size=0))] == [1] * 5
    assert values(sinks.to_record_batches(x.map(lambda v: F.slice(v, 1, 0)), max_batch_size=3)) == [[]] * 5
    sinks.write_record_batches(str(tmp_path / "b"), out, max_file_rows=4)
    parts = [pq.read_table(p)["number"].to_pylist() for p in sorted((tmp_path / "b").glob("*.parquet"))]
    assert sorted(n for p in parts for n in p) == list(range(23)) and max(map(len, parts)) <= 4
    assert [n // 5 for p in parts for n in p] == [n // 5 for n in range(23)]


def test_parquet_metadata_and_visitor(spark, tmp_path):
    x, path, seen = g.curve(spark, RUN, [(s(1), 1.0)], float), str(tmp_path / "p"), []
    sinks.write_parquet(path, column_metadata={"x": {"unit": "EUR"}}, file_visitor=seen.append, x=x)
    assert spark.read.parquet(path).schema["x"].metadata["unit"] == "EUR"
    there = lambda: {p.name for p in (tmp_path / "p").glob("*.parquet")}
    first = there()
    assert {p.rsplit("/", 1)[1] for p in seen} == first
    seen.clear()
    sinks.write_parquet(path, mode="append", file_visitor=seen.append, x=x)
    assert {p.rsplit("/", 1)[1] for p in seen} == there() - first and seen


def test_frames_of_structs(spark):
    x, y, z = (g.curve(spark, RUN, [(s(k), k * 10 + n) for n in at], int) for k, at in ((1, [1]), (1, [2]), (2, [3])))
    f = Frame(**{"p": x, "q low": y, "q high": z})
    got = f.collect()
    assert [r["value"].asDict(True) for r in got.sorted().collect()][-1] == {"p": None, "q": {"low": None, "high": 23}}
    back = Frame.flatten(got)
    assert back.columns == ["p", "q low", "q high"] and [values(back[c]) for c in back.columns] == [[11], [12], [23]]
    assert Frame.flatten(got, name="f", recursive=False).columns == ["f p", "f q"]
    with pytest.raises(TypeError):
        Frame.flatten(x)
    flags = Frame(**{n: x.map(lambda v: F.lit(True)) for n in f.columns})
    assert values(flags.binop(a.filter, f)["p"]) == [11]
    with pytest.raises(KeyError):
        f.binop(a.filter, Frame(p=x))


def test_nodes_with_passive_inputs(spark):
    @folds.node({"n": "bigint", "s": "string"}, seen=0)
    def step(c):
        if not c.passive:
            c.make_passive("y")
        c.state["seen"] += 1
        c.emit_to("n", c.state["seen"])
        if c.ticked("x"):
            c.emit_to("s", f"{c.values['x']}:{c.values.get('y')}")

    x = g.curve(spark, RUN, [(s(k), k) for k in (1, 4, 5)], int)
    y = g.curve(spark, RUN, [(s(k), k) for k in (2, 3, 5)], int)
    out = step(x=x, y=y)
    assert values(out["n"]) == [1, 2, 3] and values(out["s"]) == ["1:None", "4:3", "5:5"]


def test_formula_with_functions(spark):
    x = g.curve(spark, RUN, [(s(1), 3.0)], float)
    own = {"twice": (("v",), "2 * v"), "span": (("lo", "hi"), "twice(hi) - lo")}
    assert values(folds.expression("span(x, x + 1)", functions=own, x=x)) == [5.0]
    assert values(folds.expression("array(x, twice(x))", "array<double>", functions=own, x=x)) == [[3.0, 6.0]]
