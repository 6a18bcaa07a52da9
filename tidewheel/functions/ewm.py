"""Exponentially weighted statistics, as folds over the samples of each key."""

from __future__ import annotations

import math
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from ..series import Series, arrow_schema, spine
from ..shipping import ship

NAN = float("nan")


def decay(alpha: float | None = None, span: float | None = None, com: float | None = None, halflife: timedelta | None = None) -> tuple[float | None, float | None]:
    """(alpha, halflife in microseconds) from the one parameter given."""
    given = [p for p in (alpha, span, com, halflife) if p is not None]
    if len(given) != 1:
        raise ValueError("give one of alpha, span, com and halflife")
    if halflife is not None:
        if halflife <= timedelta(0):
            raise ValueError("a half-life is positive")
        return None, halflife / timedelta(microseconds=1)
    a = alpha if alpha is not None else 2 / (span + 1) if span is not None else 1 / (1 + com)
    if not 0 <= a <= 1:
        raise ValueError("alpha lies between 0 and 1")
    return a, None


class Average:
    """The average of a stream of (time in microseconds, value)."""

    def __init__(self, alpha: float | None, half: float | None, adjust: bool, ignore_na: bool, horizon: int | None) -> None:
        self.alpha, self.half, self.adjust, self.ignore_na, self.horizon = alpha, half, adjust, ignore_na, horizon
        self.clear()

    def clear(self) -> None:
        self.num = self.den = 0.0
        self.weight = self.square = 0.0
        self.last: float | None = None
        self.gap, self.any = 1, False
        self.window: list[float] = []

    def _windowed(self, v: float) -> float:
        """With a horizon: the weighted mean of the last samples, afresh."""
        self.window = [*self.window, v][-self.horizon :]
        num = den = 0.0
        for x in [x for x in self.window if x == x] if self.ignore_na else self.window:
            num, den = num * (1 - self.alpha) + (x if x == x else 0.0), den * (1 - self.alpha) + (x == x)
        return num / den if den > 0 else NAN

    def add(self, at: float, v: float) -> float:
        if self.horizon is not None:
            return self._windowed(v)
        nan = v != v
        if nan:
            if not self.ignore_na and self.half is None and self.any:
                self.gap += 1
        else:
            if self.half is not None:
                keep = math.exp(-math.log(2) * (at - self.last) / self.half) if self.last is not None else 0.0
            else:
                keep = (1 - self.alpha) ** (1 if self.ignore_na else self.gap)
            if not self.any:
                self.num, self.den, self.weight, self.square = v, 1.0, 1.0, 1.0
            elif self.adjust:
                self.num, self.den = self.num * keep + v, self.den * keep + 1
                self.weight, self.square = self.weight * keep + 1, self.square * keep * keep + 1
            else:
                fresh = 1 - keep if self.half is not None else self.alpha
                total = keep + fresh
                self.num = (self.num * keep + fresh * v) / total
                self.weight, self.square = 1.0, (self.square * keep * keep + fresh * fresh) / total**2
            self.last, self.gap, self.any = at, 1, True
        return self.num / self.den if self.den > 0 else NAN

    @property
    def debias(self) -> float:
        w2 = self.weight * self.weight
        return w2 / (w2 - self.square) if abs(w2 - self.square) > 1e-9 else NAN


def _averages(x: Series, products: list, combine, sampler: Series | None, trigger: Series | None, reset: Series | None, min_periods: int, make, y: Series | None = None) -> Series:
    parts = {"x": x} | {n: s for n, s in (("y", y), ("_sampler", sampler), ("_trigger", trigger), ("_reset", reset)) if s is not None}
    rows = spine(x.keys, **parts)
    ship(rows.sparkSession)
    keys, kinds = x.keys, dict(rows.dtypes)
    ticks = [c for c in rows.columns if c.endswith("_ticked")]
    values = ["x", *(["y"] if y is not None else [])]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ts timestamp_ntz", "cycle int", "value double"])

    arrow = arrow_schema(schema)

    def one(table: pa.Table) -> pa.Table:
        pdf = table.sort_by([("ts", "ascending"), ("cycle", "ascending")]).to_pandas()
        at = pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
        on = {c.removesuffix("_ticked"): pdf[c].tolist() for c in ticks}
        data = {v: pdf[v].astype("float64").tolist() for v in values}
        stats = [make() for _ in products]
        n, now, rows_out = 0, [NAN] * len(stats), []
        for i in range(len(at)):
            if "_reset" in on and on["_reset"][i]:
                for s in stats:
                    s.clear()
                now = [NAN] * len(stats)
            ticked = on["x"][i]
            if on["_sampler"][i] if "_sampler" in on else ticked:
                got = [data[v][i] if on[v][i] else NAN for v in values]
                if any(g != g for g in got):
                    got = [NAN] * len(got)
                n += 1
                now = [s.add(at[i], p(*got)) for s, p in zip(stats, products, strict=True)]
                sampled = True
            else:
                sampled = False
            if (on["_trigger"][i] if "_trigger" in on else sampled) and n >= min_periods:
                rows_out.append((at[i], int(pdf["cycle"].iat[i]), combine(now, stats[0].debias)))
        held = {k: pa.array([table[k][0].as_py()] * len(rows_out), arrow.field(k).type) for k in keys}
        made = {"ts": pa.array([r[0] for r in rows_out], pa.int64()).cast(pa.timestamp("us")), "cycle": pa.array([r[1] for r in rows_out], pa.int32()), "value": pa.array([r[2] for r in rows_out], pa.float64())}
        return pa.table([(held | made)[c.name] for c in arrow], schema=arrow)

    return Series((rows.groupBy(*keys) if keys else rows.groupBy(F.lit(0).alias("_all"))).applyInArrow(one, schema), keys)


def ema(x: Series, min_periods: int = 1, adjust: bool = True, horizon: int | None = None, ignore_na: bool = False, trigger: Series | None = None, sampler: Series | None = None, reset: Series | None = None, **parameter) -> Series:
    """Exponential moving average by alpha, span, com or halflife."""
    alpha, half = decay(**parameter)
    if horizon is not None and (not adjust or half is not None):
        raise ValueError("a horizon needs adjust and no half-life")
    return _averages(x, [lambda v: v], lambda m, _: m[0], sampler, trigger, reset, min_periods, lambda: Average(alpha, half, adjust, ignore_na, horizon))


def ema_cov(x: Series, y: Series, min_periods: int = 1, adjust: bool = True, ignore_na: bool = False, bias: bool = False, trigger: Series | None = None, sampler: Series | None = None, reset: Series | None = None, **parameter) -> Series:
    alpha, half = decay(**parameter)
    combine = lambda m, d: (m[2] - m[0] * m[1]) * (1.0 if bias else d)
    return _averages(x, [lambda a, _: a, lambda _, b: b, lambda a, b: a * b], combine, sampler, trigger, reset, min_periods, lambda: Average(alpha, half, adjust, ignore_na, None), y)


def ema_var(x: Series, bias: bool = False, **kwargs) -> Series:
    alpha, half = decay(**{k: kwargs.pop(k) for k in ("alpha", "span", "com", "halflife") if k in kwargs})
    adjust, ignore_na, least = kwargs.pop("adjust", True), kwargs.pop("ignore_na", False), kwargs.pop("min_periods", 1)
    combine = lambda m, d: max((m[1] - m[0] * m[0]) * (1.0 if bias else d), 0.0) if m[0] == m[0] and (bias or d == d) else NAN
    return _averages(x, [lambda a: a, lambda a: a * a], combine, kwargs.get("sampler"), kwargs.get("trigger"), kwargs.get("reset"), least, lambda: Average(alpha, half, adjust, ignore_na, None))


def ema_std(x: Series, **kwargs) -> Series:
    return ema_var(x, **kwargs).map(F.sqrt)
