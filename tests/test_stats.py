"""Statistics against hand-written values, pandas and the rules of windows."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import ewm
from tidewheel.functions import math as m
from tidewheel.functions import stats as st
from tidewheel.functions.stats import Rules
from tidewheel.series import RunSpec, Series
from tidewheel.sources import generators as g

START = datetime(2020, 1, 1)
RUN = RunSpec(START, timedelta(seconds=400))
NAN = float("nan")


def s(x: float) -> timedelta:
    return timedelta(seconds=x)


def curve(spark, values, times=None):
    return g.curve(spark, RUN, [(s(t), float(v)) for t, v in zip(times or range(1, len(values) + 1), values, strict=True)], float)


def vals(x: Series) -> list:
    return [v for _, v in x.collect()]


def same(got, want, eps=1e-9):
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert (math.isnan(x) and math.isnan(y)) or abs(x - y) < eps, (got, want)


GAPPY = [1, 2, 3, NAN, 4, NAN, NAN, 5, 6, 7]


@pytest.mark.parametrize("window", [3, s(3)])
def test_nan_rules(spark, window):
    x = curve(spark, GAPPY)
    least = 1 if isinstance(window, int) else s(1)
    same(vals(st.count(x, Rules(window, least, run=RUN))), [1, 2, 3, 2, 2, 1, 1, 1, 2, 3])
    same(vals(st.count(x, Rules(window, least, ignore_na=False, run=RUN))), [1, 2, 3, NAN, NAN, NAN, NAN, NAN, NAN, 3])
    least = 3 if isinstance(window, int) else s(3)
    same(vals(st.max_(x, Rules(window, least, run=RUN))), [3, 3, 4, 4, 4, 5, 6, 7])
    same(vals(st.sum(x, Rules(window, least, run=RUN))), [6, 5, 7, 4, 4, 5, 11, 18])
    same(vals(st.sum(x, Rules(window, least, ignore_na=False, run=RUN))), [6, NAN, NAN, NAN, NAN, NAN, NAN, 18])


def test_trigger_between_samples(spark):
    x = curve(spark, [*range(1, 21), 2, 2], [*range(1, 21), 25, 26])
    trigger = curve(spark, [0] * 7, [3.5, 6.5, 8.5, 9.5, 16.5, 23.5, 26.5])
    same(vals(st.sum(x, Rules(s(3), s(0), trigger, run=RUN))), [6, 15, 21, 24, 45, 0, 4])
    same(vals(st.mean(x, Rules(s(3), s(4), trigger, run=RUN))), [5, 7, 8, 15, NAN, 2])


def test_reset_precedes_sample(spark):
    x, reset = curve(spark, [1, 2, 3, 4]), curve(spark, [0], [3])
    same(vals(st.sum(x, Rules(reset=reset))), [1, 3, 3, 7])


def test_sampler_without_x_is_nan(spark):
    x, sampler = curve(spark, [1, 2], [1, 3]), curve(spark, [0, 0, 0], [1, 2, 3])
    same(vals(st.count(x, Rules(2, 1, sampler=sampler))), [1, 1, 1])


def test_ties_are_apart_in_time_windows(spark):
    x = g.curve(spark, RUN, [(s(0), 1.0), (s(1), 2.0), (s(1), 3.0), (s(2), 4.0)], float)
    same(vals(st.sum(x, Rules(s(1), s(0), run=RUN))), [1, 2, 5, 4])


def test_rank(spark):
    x = curve(spark, [5, 10, 5, 3, 8, 8, 1, 0, 4, 5.3] * 2)
    same(vals(st.rank(x, Rules(5))), [3, 2, 0, 0, 2, 3, 3, 4, 1, 0, 3, 2, 0, 0, 2, 3])
    y = curve(spark, [1, 1, 1, 1, 2, 1])
    same(vals(st.rank(y, Rules(s(4), s(0.1), run=RUN))), [0, 0, 0, 0, 3, 0])


def test_moments_agree_with_pandas(spark):
    values = np.random.default_rng(42).normal(0, 5, 60)
    x, w = curve(spark, values), pd.Series(values).rolling(10)
    for stat, want in ((st.mean, w.mean()), (st.var, w.var()), (st.stddev, w.std()), (st.skew, w.skew()), (st.kurt, w.kurt()), (st.median, w.median()), (st.sem, w.std() / math.sqrt(10))):
        same(vals(stat(x, Rules(10))), want.dropna().tolist(), 1e-7)
    ones = curve(spark, [1.0] * 60)
    for stat in (st.var, st.skew, st.kurt):
        same(vals(stat(x, Rules(10), weights=ones)), vals(stat(x, Rules(10))), 1e-7)


def test_pairs(spark):
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=40), rng.normal(size=40)
    want = pd.Series(p).rolling(8).corr(pd.Series(q)).dropna().tolist()
    same(vals(st.corr(curve(spark, p), curve(spark, q), Rules(8))), want, 1e-7)
    with pytest.raises(Exception, match="together"):
        vals(st.cov(curve(spark, [1, 2]), curve(spark, [1], [2]), Rules(2, 1)))
    same(vals(st.corr(curve(spark, [1, 1, 1]), curve(spark, [1, 2, 3]), Rules(3))), [NAN])


@pytest.mark.parametrize(("how", "want"), [("lower", 2), ("higher", 3), ("midpoint", 2.5), ("nearest", 3), ("linear", 2.5)])
def test_quantile_between(spark, how, want):
    same(vals(st.quantile(curve(spark, [4, 1, 3, 2]), Rules(4), 0.5, how)), [want])


def test_argmin_tie(spark):
    x = curve(spark, [2, 1, 1])
    at = lambda recent: (vals(st.argmin(x, Rules(3), recent))[0] - START).total_seconds()
    assert (at(True), at(False)) == (3, 2)


@pytest.mark.parametrize("ignore_na", [True, False])
@pytest.mark.parametrize("adjust", [True, False])
def test_ema_agrees_with_pandas(spark, adjust, ignore_na):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(200) < 0.2, NAN, rng.normal(size=200))
    values[0] = 1.0
    w = pd.Series(values).ewm(alpha=0.1, adjust=adjust, ignore_na=ignore_na)
    x = curve(spark, values)
    same(vals(ewm.ema(x, alpha=0.1, adjust=adjust, ignore_na=ignore_na)), w.mean().tolist(), 1e-7)
    got = vals(ewm.ema_var(x, alpha=0.1, adjust=adjust, ignore_na=ignore_na, min_periods=5))
    same(got, w.var().tolist()[4:], 1e-7)


def test_ema_parameters(spark):
    x = curve(spark, [1, 2])
    for bad in ({}, {"alpha": 0.1, "span": 2}, {"alpha": 2.0}):
        with pytest.raises(ValueError):
            ewm.ema(x, **bad)
    same(vals(ewm.ema(x, halflife=s(1))), [1, (0.5 + 2) / 1.5])


def test_arrays(spark):
    x = g.curve(spark, RUN, [(s(k), [float(k), float(k * k)]) for k in range(1, 5)], list[float])
    assert vals(st.each_element(st.sum, x, Rules(2))) == [[3.0, 5.0], [5.0, 13.0], [7.0, 25.0]]
    c = vals(st.cov_matrix(x, Rules(4)))[0]
    assert np.allclose(c, np.cov([[1, 2, 3, 4], [1, 4, 9, 16]]))


def test_rules_are_checked():
    for bad in ({"interval": 0}, {"interval": s(0)}, {"interval": 3, "min_window": s(1)}, {"interval": s(1)}):
        with pytest.raises(ValueError):
            Rules(**bad)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(x, y) for x in (-7.0, 0.0, 7.0, NAN) for y in (2.0, -2.0, 0.0)], "x double, y double")
    for r in df.select("x", "y", m.divide(F.col("x"), F.col("y")).alias("d"), m.mod(F.col("x"), F.col("y")).alias("m"), m.erf(F.col("x") / 3).alias("e"), m.ln(F.col("x")).alias("l"), m.lt(F.col("x"), F.col("y")).alias("lt")).collect():
        x, y = r["x"], r["y"]
        want = x / y if y else (NAN if x == 0 or x != x else math.copysign(math.inf, x))
        same([r["d"]], [want]) if not math.isinf(want) else None
        assert math.isinf(want) == math.isinf(r["d"])
        if y and x == x:
            same([r["m"]], [x % y])
        same([r["e"]], [math.erf(x / 3)], 1e-13)
        assert r["lt"] == (x < y)
        assert (r["l"] == -math.inf) if x == 0 else math.isnan(r["l"]) if not x > 0 else abs(r["l"] - math.log(x)) < 1e-12
