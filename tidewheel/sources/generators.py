"""Series made of parameters: constants, timers, curves, random ones."""

from __future__ import annotations

from datetime import timedelta
from enum import Enum

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..series import RunSpec, Series, spark_type, spine


class PushMode(Enum):
    """What happens to ticks at one timestamp: the last counts, each gets a
    cycle, or all come as a list."""

    LAST_VALUE = 1
    NON_COLLAPSING = 2
    BURST = 3


def push(df: DataFrame, keys: tuple[str, ...] = (), mode: PushMode = PushMode.NON_COLLAPSING, order: str = "seq") -> Series:
    """A series from (keys, ts, order, value) under a push mode."""
    if mode is PushMode.NON_COLLAPSING:
        nth = Window.partitionBy(*keys, "ts").orderBy(order)
        return Series(df.select(*keys, "ts", (F.row_number().over(nth) - 1).alias("cycle"), "value"), keys)
    value = F.max_by("value", order) if mode is PushMode.LAST_VALUE else F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda e: e["value"])
    return Series(df.groupBy(*keys, "ts").agg(F.lit(0).alias("cycle"), value.alias("value")).select(*keys, "ts", "cycle", "value"), keys)


def null_ts(spark: SparkSession, kind: object) -> Series:
    return Series(spark.createDataFrame([], f"ts timestamp_ntz, cycle int, value {spark_type(kind)}"))


def const(spark: SparkSession, run: RunSpec, value: object, kind: object | None = None, after: timedelta = timedelta(0)) -> Series:
    rows = [(run.start + after, 0, value)] if run.start + after <= run.end else []
    return Series(spark.createDataFrame(rows, f"ts timestamp_ntz, cycle int, value {spark_type(kind or type(value))}"))


def timer(spark: SparkSession, run: RunSpec, every: timedelta, value: object = True) -> Series:
    """A tick every interval, first one interval after the start."""
    if every <= timedelta(0):
        raise ValueError("a timer's interval is positive")
    n, step = (run.end - run.start) // every, every // timedelta(microseconds=1)
    at = F.lit(run.start).cast("timestamp_ntz") + (F.col("id") + 1) * F.expr(f"make_dt_interval(0, 0, 0, {step / 1e6:.6f})")
    return Series(spark.range(n).select(at.alias("ts"), F.lit(0).alias("cycle"), F.lit(value).alias("value")))


def curve(spark: SparkSession, run: RunSpec, data: list[tuple] | tuple[np.ndarray, np.ndarray], kind: object | None = None, mode: PushMode = PushMode.NON_COLLAPSING) -> Series:
    """Ticks from [(time or time since start, value)] or from two arrays;
    those outside the run are skipped."""
    if isinstance(data, tuple):
        times, values = data
        if len(times) != len(values):
            raise ValueError("times and values differ in number")
        pairs = [(t.astype("datetime64[us]").item() if isinstance(t, np.datetime64) else t, v.item() if isinstance(v, np.generic) else v) for t, v in zip(times, values, strict=True)]
    else:
        pairs = list(data)
    rows = [(run.at(t), k, v) for k, (t, v) in enumerate(pairs)]
    rows = [r for r in rows if run.start <= r[0] <= run.end]
    if not rows and kind is None:
        raise ValueError("an empty curve needs a type")
    df = spark.createDataFrame(rows, f"ts timestamp_ntz, seq long, value {spark_type(kind or type(rows[0][2]))}")
    return push(df, mode=mode)


def poisson_timer(spark: SparkSession, run: RunSpec, rate: float, seed: int, value: object = True) -> Series:
    """Ticks with exponential gaps, `rate` a second on average."""
    if rate < 0:
        raise ValueError("a rate is not negative")
    rng, t, rows = np.random.default_rng(seed), run.start, []
    while rate > 0:
        t = t + timedelta(seconds=float(rng.exponential(1 / rate)))
        if t > run.end:
            break
        rows.append((t, 0, value))
    return Series(spark.createDataFrame(rows, f"ts timestamp_ntz, cycle int, value {spark_type(type(value))}"))


def brownian_motion(spark: SparkSession, run: RunSpec, trigger: Series, drift: list[float] | Series, covariance: list[list[float]] | Series, seed: int, return_increments: bool = False) -> Series:
    """Correlated Brownian motion at the ticks of trigger, from 0. Constant
    drift and covariance (both a second) hold from the run's start; series of
    arrays hold from one tick to the next, and the motion starts once both
    have ticked. One walk is sequential, and so is one task."""
    constant = {n: np.array(v, float) for n, v in (("_d", drift), ("_c", covariance)) if not isinstance(v, Series)}
    rows = spine((), _t=trigger, **{n: v for n, v in (("_d", drift), ("_c", covariance)) if isinstance(v, Series)})
    for n in {"_d", "_c"} - set(constant):
        rows = rows.where(f"{n}_valid")
    start = np.datetime64(run.start, "us")

    def factor(c):
        root = np.linalg.svd(c)
        return root[0] * np.sqrt(root[1])

    def walk(pdf):
        pdf = pdf.sort_values(["ts", "cycle"])
        t = pdf["ts"].to_numpy().astype("datetime64[us]")
        d = np.stack([np.array(x, float) for x in pdf["_d"]]) if "_d" in pdf else np.broadcast_to(constant["_d"], (len(t), *constant["_d"].shape))
        c = np.stack([np.array([[*r] for r in x], float) for x in pdf["_c"]]) if "_c" in pdf else np.broadcast_to(constant["_c"], (len(t), *constant["_c"].shape))
        size = d.shape[-1]
        if d.ndim != 2 or c.shape[1:] != (size, size):
            raise ValueError("drift is an array of n numbers, covariance one of n times n")
        dt = np.diff(np.concatenate([[start if len(constant) == 2 else t[0]], t])).astype(np.int64) / 1e6
        noise = np.random.default_rng(seed).standard_normal((len(t), size)) * np.sqrt(dt)[:, None]
        held = np.maximum(np.arange(len(t)) - 1, 0)  # what held before a tick moves the walk up to it
        fresh = np.concatenate([[True], (c[1:] != c[:-1]).any(axis=(1, 2))])
        factors = [factor(m) for m in c[fresh]]
        which = np.cumsum(fresh)[held] - 1
        step = d[held] * dt[:, None]
        for k, f in enumerate(factors):
            step[which == k] += noise[which == k] @ f.T
        on = pdf["_t_ticked"].to_numpy(bool)
        at = np.cumsum(step, 0)[on]
        return pdf.loc[on, ["ts", "cycle"]].assign(value=list(np.diff(at, axis=0, prepend=np.zeros((1, size))) if return_increments else at))

    cols = ["ts", "cycle", "_t_ticked", *({"_d", "_c"} - set(constant))]
    return Series(rows.select(*cols).groupBy(F.lit(0).alias("_all")).applyInPandas(walk, "ts timestamp_ntz, cycle int, value array<double>"))


def brownian_motion_1d(spark: SparkSession, run: RunSpec, trigger: Series, drift: float | Series, variance: float | Series, seed: int, return_increments: bool = False) -> Series:
    d = drift.map(lambda v: F.array(v.cast("double"))) if isinstance(drift, Series) else [drift]
    c = variance.map(lambda v: F.array(F.array(v.cast("double")))) if isinstance(variance, Series) else [[variance]]
    return brownian_motion(spark, run, trigger, d, c, seed, return_increments).map(lambda v: v[0])


def between(df: DataFrame, run: RunSpec, ts: str = "ts") -> DataFrame:
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (run.start, run.end))
    return df.where((F.col(ts) >= lo) & (F.col(ts) <= hi))



