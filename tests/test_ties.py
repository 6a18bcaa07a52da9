"""Ticks that share a timestamp, and history by time, against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidewheel.functions import stats
from tidewheel.functions.stats import Rules
from tidewheel.operators import algebra as a
from tidewheel.operators import dynamics as dy
from tidewheel.operators.folds import Context, run_fold
from tidewheel.series import RunSpec, Series
from tidewheel.sources import sinks

START = datetime(2020, 1, 1)
US = timedelta(microseconds=1)


def tied(spark, n: int = 60, apart: int = 4) -> tuple[Series, list[tuple]]:
    rng = random.Random(n)
    rows, now = [], 0
    for i in range(n):
        now += rng.choice([0, 0, 1, 2, apart])
        rows.append((START + now * US, i, float(i)))
    s = Series.of(spark.createDataFrame(rows, "ts timestamp_ntz, i int, value double"), order=("i",))
    return s, [(t, v) for t, _, v in rows]


def ordered(s: Series) -> list:
    return [r["value"] for r in s.sorted().collect()]


def test_ticks_are_numbered_by_default(spark):
    s = Series.of(spark.createDataFrame([(START, 1.0), (START, 2.0), (START, 3.0)], "ts timestamp_ntz, value double"))
    assert sorted(r["cycle"] for r in s.df.collect()) == [0, 1, 2]
    assert a.merge(s, s).df.count() == a.count(s).df.count() == 3


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_windows_hold_every_cycle(spark, d):
    s, rows = tied(spark)
    want = [sum(v for u, v in rows[: i + 1] if u > t - d * US) for i, (t, _) in enumerate(rows)]
    assert ordered(stats.sum(s, Rules(d * US, timedelta(0)))) == want


@pytest.mark.parametrize("d", [1, 2])
def test_thousands_of_ticks_at_one_time(spark, d):
    rows = [(START, k, 1.0) for k in range(3000)] + [(START + US, 3000, 1.0)]
    s = Series.of(spark.createDataFrame(rows, "ts timestamp_ntz, i int, value double"), order=("i",))
    got = ordered(stats.count(s, Rules(d * US, timedelta(0))))
    assert got == [float(k + 1) for k in range(3000)] + [3001.0 if d == 2 else 1.0]


@pytest.mark.parametrize("first", [False, True])
def test_value_at_a_time(spark, first):
    s, rows = tied(spark)
    for ago in (1, 3):
        want = []
        for t, _ in rows:
            then = [(u, v) for u, v in rows if u <= t - ago * US]
            want.append(None if not then else next(v for u, v in then if u == then[-1][0]) if first else then[-1][1])
        assert ordered(a.value_at(s, ago * US, first)) == want


def test_history_of_a_span(spark):
    s, rows = tied(spark)
    got = [[e["value"] for e in h] for h in ordered(a.history(s, span=3 * US))]
    assert got == [[v for u, v in rows[: i + 1] if u >= t - 3 * US] for i, (t, _) in enumerate(rows)]


@pytest.mark.parametrize("low", list(dy.Range))
@pytest.mark.parametrize("high", list(dy.Range))
@pytest.mark.parametrize("end", [0, 2])
def test_values_between(spark, low, high, end):
    s, rows = tied(spark, 40)
    got = [[(e["ts"], e["value"]) for e in h] for h in ordered(dy.values_between(s, 5 * US, end * US, low, high))]
    want = []
    for i, (t, _) in enumerate(rows):
        past, lo, hi = rows[: i + 1], t - 5 * US, t - end * US
        part = [(u, v) for u, v in past if (u > lo if low is dy.Range.EXCLUSIVE else u >= lo) and (u < hi if high is dy.Range.EXCLUSIVE else u <= hi)]
        for side, at in ((low, lo), (high, hi)):
            if side is dy.Range.EXTRAPOLATE and not any(u == at for u, _ in past):
                then = [(at, v) for u, v in past if u <= at][-1:]
                part = then + part if at == lo else part + then
        want.append(part)
    assert got == want


@pytest.mark.parametrize("window", [3, 4 * US])
def test_frames_wait_for_all_columns(spark, window):
    s, rows = tied(spark, 30)
    late = Series.of(spark.createDataFrame([(rows[10][0], 7.0)], "ts timestamp_ntz, value double"))
    got = [r["value"]["x"] for r in sinks.frames(s, window, x=s, y=late).sorted().collect()]
    from_ = next(i for i, (t, _) in enumerate(rows) if t >= rows[10][0])
    want = [[v for _, v in rows[max(0, i - 2) : i + 1]] if window == 3 else [v for u, v in rows[: i + 1] if u > rows[i][0] - window] for i in range(len(rows))]
    assert [[e["value"] for e in x] for x in got] == want[from_:]
    assert sinks.frames(s, window, wait_all_valid=False, x=s, y=late).df.count() == len(rows)


def test_no_plan_holds_the_past(spark):
    s, _ = tied(spark)
    for out in (a.value_at(s, US), a.history(s, span=US), dy.values_between(s, 3 * US, US)):
        plan = out.df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan.replace(" ", "") or "RangeFrame" in plan and "unboundedpreceding$(), currentrow$()))" not in "".join(line for line in plan.splitlines() if "collect_list" in line)


def test_alarms_at_one_time_keep_their_order():
    """Alarms of equal time are told apart by number, also once some are off,
    whatever their values."""

    def step(c: Context) -> None:
        if c.ticked("x"):
            made = [c.schedule("alarm", timedelta(seconds=1), v) for v in (None, {"a": 1}, 2)]
            c.cancel(made[0])
            c.schedule("alarm", timedelta(seconds=1), "last")
        else:
            c.emit(c.values["alarm"])
            c.state["seen"].append(c.values["alarm"])

    seen: list = []
    run_fold(iter([(START, 0, {"x": 1})]), ("x",), step, {"seen": lambda: seen})
    assert seen == [{"a": 1}, 2, "last"]


def test_weighted_moments_keep_their_digits(spark):
    rows = [(START + k * US, 1e9 + (k % 7) / 8, 1.0 + k % 3) for k in range(50)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double, w double")
    x, w = Series.of(df), Series.of(df, value="w")
    got = ordered(stats.var(x, Rules(10), ddof=0, weights=w))
    for k, v in zip(range(9, 50), got, strict=True):
        part = rows[k - 9 : k + 1]
        total = sum(p[2] for p in part)
        mid = sum(p[2] * (p[1] - 1e9) for p in part) / total
        assert v == pytest.approx(sum(p[2] * (p[1] - 1e9 - mid) ** 2 for p in part) / total, rel=1e-6)


def test_printing_stops_nowhere(spark):
    s = Series.of(spark.createDataFrame([(START + k * US, k) for k in range(1500)], "ts timestamp_ntz, value int"))
    out: list[str] = []
    sinks.print_ticks("x", s, out=out.append)
    assert len(out) == 1500 and RunSpec(START, US).end == START + US


def test_bad_keys_raise_if_asked_to(spark):
    x = Series.of(spark.createDataFrame([(START, 1.0), (START + 2 * US, 2.0)], "ts timestamp_ntz, value double"))
    key = Series.of(spark.createDataFrame([(START, "a"), (START + US, "b")], "ts timestamp_ntz, value string"))
    assert a.demultiplex(x, key, keys=["a"]).df.count() == 1
    with pytest.raises(Exception, match="no such key: b"):
        a.demultiplex(x, key, keys=["a"], raise_on_bad_key=True).df.collect()
    assert ordered(a.binop(x, key, lambda v, k: v * 10)) == [10.0, 10.0, 20.0]


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_time_windows_at_triggers_equal_brute_force(spark, keys):
    rng = random.Random(len(keys))
    ticks = [(rng.choice([None, "a", "b"]), START + rng.randrange(80) * US, rng.randrange(2), rng.choice([None, float("nan"), *map(float, range(-4, 5))])) for _ in range(300)]
    asks = [("c", START, 0), *((rng.choice([None, "a", "b"]), START + rng.randrange(-5, 120) * US, rng.randrange(2)) for _ in range(60))]
    named = lambda *cols: ", ".join((*(f"{k} string" for k in keys), *cols))
    of = lambda r: r if keys else r[1:]
    x = Series(spark.createDataFrame([of(r) for r in ticks], named("ts timestamp_ntz", "cycle int", "value double")), keys)
    trigger = Series(spark.createDataFrame([of((*r, True)) for r in [*asks, *asks[:9]]], named("ts timestamp_ntz", "cycle int", "value boolean")), keys)
    stats_of = {"count": len, "sum": sum, "mean": lambda v: sum(v) / len(v) if v else None, "min": lambda v: min(v, default=None), "max_": lambda v: max(v, default=None)}
    for ago in (1, 7, 200):
        for more in ({}, {"ignore_na": False, "min_data_points": 2}):
            want = {}
            for k, t, c in set(asks):
                mine = [r for r in ticks if not keys or r[0] == k]
                if any((r[1], r[2]) <= (t, c) for r in mine):
                    held = [r[3] for r in mine if t - ago * US < r[1] and (r[1], r[2]) <= (t, c)]
                    good = [v for v in held if v is not None and v == v]
                    bad = bool(more) and (len(good) < 2 or len(good) < len(held))
                    want[of((k, t, c))] = {n: None if bad else f(good) for n, f in stats_of.items()}
            for n in stats_of:
                got = getattr(stats, n)(x, Rules(ago * US, 0 * US, trigger=trigger, run=RunSpec(START, 80 * US), **more)).df.collect()
                assert len(got) == len(want)
                assert {tuple(r[:-1]): None if r[-1] != r[-1] else pytest.approx(r[-1]) for r in got} == {k: v[n] for k, v in want.items()}, (n, ago, more)


def test_purchases_of_one_time_all_count_at_timers(spark, tmp_path):
    import duckdb

    from tidewheel.plans import queries as q

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).selectExpr("event_id + 1000000 * copy as event_id", "ts", "user_id + 1000000 * copy as user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, q.timer_trigger_sum(spark, str(tmp_path)).collect())) == sorted(con.sql(q.ORACLES["timer_trigger_sum"]).fetchall())
