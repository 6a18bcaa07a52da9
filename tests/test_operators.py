"""Hand-written ticks: seconds after the start of a run."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import algebra as a
from tidewheel.operators import baskets as b
from tidewheel.operators import folds as f
from tidewheel.series import RunSpec, Series, spark_type
from tidewheel.sources import generators as g

START = datetime(2020, 1, 1)
RUN = RunSpec(START, timedelta(seconds=60))


def s(x: float) -> timedelta:
    return timedelta(seconds=x)


def curve(spark, data, kind=float):
    return g.curve(spark, RUN, [(s(t), v) for t, v in data], kind)


def ticks(x: Series) -> list[tuple]:
    return [((t - START).total_seconds(), v) for t, v in x.collect()]


def test_sample_takes_the_same_cycle(spark):
    run = RunSpec(START, s(3))
    n = a.count(g.timer(spark, run, s(1)))
    assert ticks(a.sample(g.timer(spark, run, s(0.6)), n)) == [(1.2, 1), (1.8, 1), (2.4, 2), (3.0, 3)]


def test_delay(spark):
    x = curve(spark, [(0, 1), (7, 2), (12, 3), (15, 4)], int)
    assert ticks(a.delay(x, s(2))) == [(2, 1), (9, 2), (14, 3), (17, 4)]
    assert ticks(a.delay(x, 2)) == [(12, 1), (15, 2)]
    with pytest.raises(ValueError):
        a.delay(x, 0)


def test_diff(spark):
    x = curve(spark, [(1, 2.0), (4, 5.0), (5, 12.0), (9, 23.0)])
    assert ticks(a.diff(x, s(2))) == [(4, 3), (5, 10), (9, 11)]
    assert ticks(a.diff(x, 2)) == [(5, 10), (9, 18)]


def test_merge(spark):
    x, y = curve(spark, [(2, 100), (4, 200), (6, 300)], int), curve(spark, [(1, 1), (2, 2), (3, 3)], int)
    assert ticks(a.merge(x, y)) == [(1, 1), (2, 100), (3, 3), (4, 200), (6, 300)]


def test_split_and_filter(spark):
    run = RunSpec(START, s(10))
    n, flag = a.count(g.timer(spark, run, s(1))), g.curve(spark, run, [(s(0), True), (s(4.5), False)], bool)
    yes, no = a.split(flag, n)
    assert [v for _, v in ticks(yes)] == [1, 2, 3, 4] == [v for _, v in ticks(a.filter(flag, n))]
    assert [v for _, v in ticks(no)] == [5, 6, 7, 8, 9, 10]


def test_unroll_queues_behind(spark):
    x = g.curve(spark, RUN, [(s(0), [1]), (s(1), [2, 3, 4]), (s(2), [5]), (s(3), [])], list[int])
    assert [v for _, v in ticks(a.unroll(x))] == [1, 2, 3, 4, 5]
    two = g.curve(spark, RUN, [(s(0), [1, 2, 3]), (s(0), [4, 5])], list[int])
    assert [(r["cycle"], r["value"]) for r in a.unroll(two).sorted().collect()] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


def test_collect_and_flatten_in_order_of_arrival(spark):
    run = RunSpec(START, s(6))
    parts = [g.timer(spark, run, s(d), k).df.withColumn("m", F.lit(k)) for k, d in enumerate((1, 1.5, 2))]
    basket = Series(parts[0].unionByName(parts[1]).unionByName(parts[2]), ("m",))
    got = dict(ticks(b.collect(basket, "m", START)))
    assert got[1] == [0] and got[1.5] == [1] and got[2] == [2, 0] and got[3] == [1, 0] and got[6] == [2, 1, 0]
    assert [v for t, v in ticks(b.flatten(basket, "m", START)) if t == 6] == [2, 1, 0]


@pytest.mark.parametrize(("x_at", "after", "want"), [(0, 0, [123]), (1, 0, [456, 123]), (1, 0.5, [456, 123]), (1, 2, [123])])
def test_default(spark, x_at, after, want):
    assert [v for _, v in ticks(a.default(g.const(spark, RUN, 123, after=s(x_at)), 456, RUN, s(after)))] == want


def test_gate(spark):
    run = RunSpec(START, s(10))
    n, release = a.count(g.timer(spark, run, s(1))), g.timer(spark, run, s(5))
    assert ticks(a.gate(n, release, release_on_tick=True)) == [(5, [1, 2, 3, 4, 5]), (10, [6, 7, 8, 9, 10])]


def test_struct_from_and_collect(spark):
    x, y = g.curve(spark, RUN, [(s(0), False), (s(1), True)], bool), curve(spark, [(0.2, 123.0), (1, 456.0)])
    assert [tuple(v) for _, v in ticks(a.struct_from(a=x, b=y))] == [(False, None), (False, 123.0), (True, 456.0)]
    assert [tuple(v) for _, v in ticks(a.struct_collect(a=x, b=y))] == [(False, None), (None, 123.0), (True, 456.0)]


def test_push_modes(spark):
    data = [(0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6), (3, 7)]
    make = lambda mode: ticks(g.curve(spark, RUN, [(s(t), v) for t, v in data], int, mode))
    assert [v for _, v in make(g.PushMode.NON_COLLAPSING)] == [1, 2, 3, 4, 5, 6, 7]
    assert [v for _, v in make(g.PushMode.LAST_VALUE)] == [1, 3, 6, 7]
    assert [v for _, v in make(g.PushMode.BURST)] == [[1], [2, 3], [4, 5, 6], [7]]


def _sync_basket(spark, data):
    df = None
    for k, pairs in data.items():
        part = curve(spark, pairs, int).df.withColumn("m", F.lit(k))
        df = part if df is None else df.unionByName(part)
    return Series(df, ("m",))


def test_sync(spark):
    basket = _sync_basket(spark, {"a": [(1, 1), (16, 2), (20, 3)], "b": [(6, 4), (16.5, 5), (20.5, 6)], "c": [(11, 7), (18, 8), (19.9, 9)]})
    got = f.sync(basket, "m", ["a", "b", "c"], s(1), run=RUN).sorted().collect()
    assert [(r["m"], (r["ts"] - START).total_seconds(), r["value"]) for r in got] == [("a", 2, 1), ("a", 17, 2), ("a", 20.5, 3), ("b", 7, 4), ("b", 17, 5), ("b", 20.5, 6), ("c", 12, 7), ("c", 19, 8), ("c", 20.5, 9)]
    whole = f.sync(basket, "m", ["a", "b", "c"], s(1), output_incomplete=False, run=RUN).sorted().collect()
    assert [(r["m"], r["value"]) for r in whole] == [("a", 3), ("b", 6), ("c", 9)]


def test_sync_with_trigger(spark):
    basket = _sync_basket(spark, {"a": [(1, 1), (12, 2), (30, 3), (52, 4)], "b": [(2, 5), (14, 6), (32, 7), (56, 8)]})
    trigger = curve(spark, [(10, 1), (30, 1), (31, 1), (50, 1)], int)
    got = f.sync(basket, "m", ["a", "b"], s(5), trigger=trigger, run=RUN).sorted().collect()
    assert [(r["m"], (r["ts"] - START).total_seconds(), r["value"]) for r in got] == [("a", 14, 2), ("a", 32, 3), ("a", 55, 4), ("b", 14, 6), ("b", 32, 7)]


def test_drop_dups_compares_with_what_was_emitted(spark):
    x = curve(spark, [(0, 1.0), (1, 1.4), (2, 1.6), (3, float("nan")), (4, float("nan")), (5, 1.6)])
    got = [v for _, v in ticks(f.drop_dups_eps(x, 0.5))]
    assert got[:2] == [1.0, 1.6] and math.isnan(got[2]) and got[3:] == [1.6]
    assert len(ticks(a.drop_dups(x))) == 5


def test_node_with_state_and_alarm(spark):
    @f.node("bigint", n=0)
    def reminder(c: f.Context) -> None:
        if c.ticked("x"):
            c.state["n"] += 1
            c.schedule("alarm", timedelta(seconds=2))
        if c.ticked("alarm"):
            c.emit(c.state["n"])

    assert ticks(reminder(x=curve(spark, [(0, 1.0), (1, 1.0)]), run=RUN)) == [(2, 2), (3, 2)]


def test_feedback_and_expression(spark):
    x, y = curve(spark, [(0, 1.0), (1, 2.0)]), curve(spark, [(1, 10.0)])
    assert [v for _, v in ticks(f.feedback(lambda v, old: v + 2 * old, x, "double", 0.0))] == [1.0, 4.0]
    assert ticks(f.expression("x * k + y", constants={"k": 3.0}, x=x, y=y)) == [(1, 16.0)]


def test_history(spark):
    x = g.curve(spark, RUN, [(s(0), 1.0), (s(0), 2.0), (s(0), 3.0), (s(1), 9.0)], float)
    assert ticks(a.value_at(x, s(1)))[-1] == (1, 3.0)
    assert ticks(a.value_at(x, s(1), first=True))[-1] == (1, 1.0)
    assert ticks(a.value_at(x, 3))[-1] == (1, 1.0)


def test_sources_and_types(spark):
    assert ticks(g.const(spark, RUN, 5, after=s(2))) == [(2, 5)]
    assert ticks(g.null_ts(spark, float)) == []
    with pytest.raises(ValueError):
        g.timer(spark, RUN, s(0))
    assert spark_type(dict[str, list[float]]) == "map<string,array<double>>"
    with pytest.raises(TypeError):
        spark_type(object)
    n = g.poisson_timer(spark, RUN, 1.0, 7).df.count()
    assert n == g.poisson_timer(spark, RUN, 1.0, 7).df.count() and 30 < n < 100
    walk = g.brownian_motion(spark, RUN, g.timer(spark, RUN, s(1)), [0.0, 1.0], [[1, 0.5], [0.5, 1]], 3).sorted().collect()
    assert len(walk) == 60 and 20 < walk[-1]["value"][1] < 100
