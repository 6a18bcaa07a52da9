"""Rolling, expanding and resettable statistics of series.

All share one contract. In each cycle a reset first clears the window, then
the sampler takes a sample (x, or NaN if x does not tick with it), then the
trigger asks for a value. Windows are the last n samples, the samples of the
time (t - d, t], or all. NaN samples count in the window: they are ignored, or
with ignore_na=False they make the result NaN. min_window suppresses results
until so many samples or so much time have passed.

A window is a frame over a spine of all ticks of a key: one shuffle by key,
one sort, and built-in aggregates. Ticks at one timestamp are kept apart, since
frames in time range over a position that holds both time and cycle: a window
of length d at (t, cycle) holds all cycles after t - d up to this one.

Counts, sums, means and extremes over a time at triggers alone are put
together from two parts of stretches of that time (Panes): their work doesn't
grow with the samples in a window, and no task holds all ticks of a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..series import RunSpec, Series, bound, micros, position, spine

NAN = float("nan")


@dataclass(frozen=True)
class Rules:
    """The arguments that all statistics have."""

    interval: int | timedelta | None = None
    min_window: int | timedelta | None = None
    trigger: Series | None = None
    sampler: Series | None = None
    reset: Series | None = None
    ignore_na: bool = True
    min_data_points: int = 0
    run: RunSpec | None = None

    def __post_init__(self) -> None:
        i, m = self.interval, self.min_window
        if isinstance(i, timedelta) and i <= timedelta(0) or isinstance(i, int) and i <= 0:
            raise ValueError("an interval is positive")
        if m is not None and i is not None and type(m) is not type(i):
            raise ValueError("min_window is of the interval's type")
        if isinstance(self.least, timedelta) and self.least > timedelta(0) and self.run is None:
            raise ValueError("a window in time needs the run's start (run) or a min_window of zero")

    @property
    def least(self) -> int | timedelta | None:
        return self.interval if self.min_window is None else self.min_window


class Frame:
    """The spine of a statistic, with its window; `of` names the inputs."""

    def __init__(self, rules: Rules, keys: tuple[str, ...], weights: Series | None = None, together: str | None = None, **inputs: Series) -> None:
        self.rules, self.keys, self.names = rules, keys, tuple(inputs)
        first = next(iter(inputs.values()))
        parts = dict(inputs)
        extra = {"sampler": rules.sampler, "trigger": rules.trigger, "reset": rules.reset, "weights": weights}
        parts |= {f"_{n}": s for n, s in extra.items() if s is not None}
        rows = spine(keys, **parts)
        if together:  # x and y tick in the same cycles: others raise, or don't count
            both = F.col("x_ticked") & F.col("y_ticked")
            if together == "strict":
                both = F.when(F.col("x_ticked") == F.col("y_ticked"), both).otherwise(F.raise_error(F.lit("x and y must tick together")))
            rows = rows.withColumn("_both", both).withColumn("x_ticked", F.col("_both")).withColumn("y_ticked", F.col("_both"))
        sampled = F.col("_sampler_ticked") if rules.sampler is not None else F.col(f"{self.names[0]}_ticked")
        asked = F.col("_trigger_ticked") if rules.trigger is not None else sampled
        cleared = F.col("_reset_ticked") if rules.reset is not None else F.lit(False)
        past = Window.partitionBy(*keys).orderBy("ts", "cycle").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_asked", asked).withColumn("_sampled", sampled)
        self.group = keys
        if rules.reset is not None:
            rows = rows.withColumn("_seg", F.sum(cleared.cast("int")).over(past))
            self.group = (*keys, "_seg")
        self.numeric = dict(first.df.dtypes)["value"]
        for n in self.names:
            v = F.when(F.col("_sampled"), F.when(F.col(f"{n}_ticked"), F.col(n).cast("double")).otherwise(F.lit(NAN)))
            rows = rows.withColumn(n, v)
        rows = rows.withColumn("_w", F.when(F.col("_sampled"), F.col("_weights").cast("double"))) if weights is not None else rows
        nan = F.lit(False)
        for n in [*self.names, *(["_w"] if weights is not None else [])]:
            nan = nan | F.coalesce(F.isnan(n), F.lit(False)) | (F.col("_sampled") & F.col(n).isNull())
        rows = rows.withColumn("_nan", nan & F.col("_sampled"))
        for n in self.names:
            rows = rows.withColumn(f"{n}_ok", F.when(F.col("_sampled") & ~F.col("_nan"), F.col(n)))
        within = Window.partitionBy(*self.group).orderBy("ts", "cycle")
        upto = within.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_n", F.sum(F.col("_sampled").cast("int")).over(upto))
        if rules.trigger is not None or isinstance(rules.least, int) and rules.least > 1:
            rows = rows.withColumn("_total", F.sum(F.col("_sampled").cast("int")).over(past))
        i = rules.interval
        if i is None:
            self.window: WindowSpec = upto
        elif isinstance(i, int):
            # Rows between two samples share an ordinal; only sampled ones have a value.
            self.window = Window.partitionBy(*self.group).orderBy("_n").rangeBetween(-(i - 1), 0)
        else:
            rows = rows.withColumn("_at", position())
            self.window = Window.partitionBy(*self.group).orderBy("_at").rangeBetween(bound(i, False, True), 0)
        self.rows = rows

    def over(self, c: Column) -> Column:
        return c.over(self.window)

    def fold(self, fn: Callable[[Column], Column], c: Column) -> Column:
        """An aggregate of c over the window that is its own merge; null for none."""
        return self.over(fn(c))

    def count(self, c: Column) -> Column:
        return self.over(F.count(c))

    def avg(self, c: Column) -> Column:
        return self.over(F.avg(c))

    def result(self, value: Column, need: int = 0, poison: bool = True) -> Series:
        """The series of value at triggers, with the NaN and min_window rules."""
        r, ok = self.rules, F.col(f"{self.names[0]}_ok")
        need = max(need, r.min_data_points)
        if need:
            value = F.when(self.over(F.count(ok)) < need, F.lit(NAN)).otherwise(value)
        if poison and not r.ignore_na:
            value = F.when(self.over(F.max(F.col("_nan").cast("int"))) > 0, F.lit(NAN)).otherwise(value)
        rows = self.rows.withColumn("_value", value)
        started = F.col("_asked")
        if isinstance(r.least, int) and r.least > 1:
            started = started & (F.col("_total") >= r.least)
        elif isinstance(r.least, timedelta) and r.least > timedelta(0):
            started = started & (F.col("ts") >= F.lit(r.run.start + r.least).cast("timestamp_ntz"))
        if r.trigger is not None:
            started = started & (F.col("_total") > 0)  # nothing is said before the first sample
        return Series(rows.where(started).select(*self.keys, "ts", "cycle", F.col("_value").alias("value")), self.keys)


class Panes:
    """The windows of an interval of time d at triggers, without a spine. Time
    is cut into stretches of d: a window (t - d, t] is the end of one and the
    start of the next, so that running aggregates over each stretch, from both
    sides, hold all that triggers ask for. Ticks that share a time and a cycle
    count each; triggers that do are one."""

    def __init__(self, rules: Rules, keys: tuple[str, ...], x: Series) -> None:
        self.rules, self.keys, self.x, self.parts = rules, keys, x, {}

    def fold(self, fn: Callable[[Column], Column], c: Column) -> Column:
        name = f"_p{len(self.parts)}"
        self.parts[name] = (fn, c)
        return F.col(name)

    def count(self, c: Column) -> Column:
        return F.coalesce(self.fold(F.sum, c.isNotNull().cast("int")), F.lit(0))

    def avg(self, c: Column) -> Column:
        return self.fold(F.sum, c) / F.nullif(self.count(c), F.lit(0))

    def result(self, value: Column, need: int = 0, poison: bool = True) -> Series:
        r, keys = self.rules, self.keys
        need = max(need, r.min_data_points)
        if need:
            value = F.when(self.count(F.col("x_ok")) < need, F.lit(NAN)).otherwise(value)
        if poison and not r.ignore_na:
            value = F.when(self.fold(F.max, F.col("x_ok").isNull().cast("int")) > 0, F.lit(NAN)).otherwise(value)
        length = r.interval // timedelta(microseconds=1)
        x = F.col("value").cast("double")
        samples = self.x.df.select(*keys, micros("ts").alias("_us"), "cycle", F.lit(0).alias("_end"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.when(~F.isnan(x), x).alias("x_ok"))
        samples = samples.select(*keys, "_us", "cycle", "_end", "ts", *[c.alias(n) for n, (_, c) in self.parts.items()])
        types = dict(samples.dtypes)
        # Twice each trigger: at the end of its window, and where that starts; no sample of that time is in it.
        asked = r.trigger.df.select(*keys, "ts", "cycle").distinct()
        ends = asked.select(*keys, F.explode(F.array(F.lit(1), F.lit(-1))).alias("_end"), "ts", "cycle")
        at = F.when(F.col("_end") == 1, micros("ts")).otherwise(micros("ts") - length)
        ends = ends.select(*keys, at.alias("_us"), "cycle", "_end", "ts", *[F.lit(None).cast(types[n]).alias(n) for n in self.parts])
        rows = samples.unionByName(ends).withColumn("_stretch", F.col("_us") - F.pmod("_us", F.lit(length)))
        within = Window.partitionBy(*keys, "_stretch")
        upto = within.orderBy("_us", F.when(F.col("_end") >= 0, F.col("cycle")), "_end").rowsBetween(Window.unboundedPreceding, 0)
        since = within.orderBy(F.desc("_us"), "_end").rowsBetween(Window.unboundedPreceding, 0)
        part = [F.when(F.col("_end") == 1, fn(n).over(upto)).otherwise(fn(n).over(since)).alias(n) for n, (fn, _) in self.parts.items()]
        held = rows.select(*keys, "ts", "cycle", "_end", *part).where("_end != 0").groupBy(*keys, "ts", "cycle").agg(*[fn(n).alias(n) for n, (fn, _) in self.parts.items()])
        # Nothing is said before the first sample.
        first = self.x.df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct("ts", "cycle")).alias("_first"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        held = held.join(first, same) if keys else held.crossJoin(first)
        started = F.struct("ts", "cycle") >= F.col("_first")
        if isinstance(r.least, timedelta) and r.least > timedelta(0):
            started = started & (F.col("ts") >= F.lit(r.run.start + r.least).cast("timestamp_ntz"))
        return Series(held.where(started).select(*keys, "ts", "cycle", value.alias("value")), keys)


def _frame(r: Rules, weights: Series | None, x: Series) -> Frame | Panes:
    """Panes where the rules allow for them."""
    if isinstance(r.interval, timedelta) and r.trigger is not None and r.sampler is None and r.reset is None and weights is None:
        return Panes(r, x.keys, x)
    return Frame(r, x.keys, weights, x=x)


def _nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def count(x: Series, r: Rules) -> Series:
    f = _frame(r, None, x)
    return f.result(f.count(F.col("x_ok")).cast("double"))


def unique(x: Series, r: Rules, precision: int = 10) -> Series:
    """Distinct values, told apart after truncation to `precision` digits."""
    f = Frame(r, x.keys, x=x)
    return f.result(F.size(f.over(F.collect_set((F.col("x_ok") * 10.0**precision).cast("long")))).cast("double"))


def first(x: Series, r: Rules) -> Series:
    f = Frame(r, x.keys, x=x)
    if r.ignore_na:
        return f.result(_nan(f.over(F.first("x_ok", ignorenulls=True))))
    return f.result(_nan(f.over(F.first(F.when(F.col("_sampled"), F.col("x")), ignorenulls=True))), poison=False)


def last(x: Series, r: Rules) -> Series:
    f = Frame(r, x.keys, x=x)
    if r.ignore_na:
        return f.result(_nan(f.over(F.last("x_ok", ignorenulls=True))))
    return f.result(_nan(f.over(F.last(F.when(F.col("_sampled"), F.col("x")), ignorenulls=True))), poison=False)


def sum(x: Series, r: Rules, weights: Series | None = None) -> Series:  # noqa: A001
    """Sum, 0 for an empty window; with weights, of products."""
    f = _frame(r, weights, x)
    return f.result(F.coalesce(f.fold(F.sum, _times(weights, "x_ok")), F.lit(0.0)))


def _times(weights: Series | None, name: str) -> Column:
    return F.col(name) if weights is None else F.col(name) * F.col("_w")


def mean(x: Series, r: Rules, weights: Series | None = None) -> Series:
    f = _frame(r, weights, x)
    if weights is None:
        return f.result(_nan(f.avg(F.col("x_ok"))))
    w = f.over(F.sum(F.when(F.col("x_ok").isNotNull(), F.col("_w"))))
    return f.result(F.when(w > 1e-9, f.over(F.sum(F.col("x_ok") * F.col("_w"))) / F.nullif(w, F.lit(0.0))).otherwise(F.lit(NAN)))


def prod(x: Series, r: Rules) -> Series:
    f = Frame(r, x.keys, x=x)
    return f.result(_nan(f.over(F.product("x_ok"))))


def gmean(x: Series, r: Rules) -> Series:
    f = Frame(r, x.keys, x=x)
    x_ok = F.col("x_ok")
    logs = F.when(x_ok > 0, F.ln(x_ok)).when(x_ok == 0, F.lit(float("-inf"))).when(x_ok < 0, F.lit(NAN))
    return f.result(_nan(F.exp(f.over(F.avg(logs)))))


def min(x: Series, r: Rules) -> Series:  # noqa: A001
    f = _frame(r, None, x)
    return f.result(_nan(f.fold(F.min, F.col("x_ok"))))


def max_(x: Series, r: Rules) -> Series:
    f = _frame(r, None, x)
    return f.result(_nan(f.fold(F.max, F.col("x_ok"))))


def min_max(x: Series, r: Rules) -> tuple[Series, Series]:
    return min(x, r), max_(x, r)


def quantile(x: Series, r: Rules, q: float, interpolate: str = "linear") -> Series:
    """The q-quantile at q (n - 1) in the sorted window; between two values:
    linear, lower, higher, midpoint or nearest (ties go up)."""
    if interpolate not in ("linear", "lower", "higher", "midpoint", "nearest") or not 0 <= q <= 1:
        raise ValueError("no such quantile")
    f = Frame(r, x.keys, x=x)
    if interpolate == "linear":
        return f.result(_nan(f.over(F.percentile("x_ok", q))))
    s = F.array_sort(f.over(F.collect_list("x_ok")))
    at = (F.size(s) - 1) * q
    lo, hi = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    form = {"lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "nearest": F.when(at - F.floor(at) < 0.5, lo).otherwise(hi)}[interpolate]
    return f.result(_nan(F.when(F.size(s) > 0, form)))


def median(x: Series, r: Rules) -> Series:
    return quantile(x, r, 0.5, "linear")


def _arg(x: Series, r: Rules, sign: int, recent: bool) -> Series:
    """Time of the extreme; 1970 for none."""
    f = Frame(r, x.keys, x=x)
    when = position()
    best = f.over(F.max(F.when(F.col("x_ok").isNotNull(), F.struct((F.col("x_ok") * sign).alias("v"), (when if recent else -when).alias("k"), F.col("ts").alias("t")))))
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    value = F.coalesce(best["t"], zero)
    if not r.ignore_na:
        value = F.when(f.over(F.max(F.col("_nan").cast("int"))) > 0, zero).otherwise(value)
    return f.result(value, poison=False)


def argmax(x: Series, r: Rules, return_most_recent: bool = True) -> Series:
    return _arg(x, r, 1, return_most_recent)


def argmin(x: Series, r: Rules, return_most_recent: bool = True) -> Series:
    return _arg(x, r, -1, return_most_recent)


def rank(x: Series, r: Rules, method: str = "min", na_option: str = "keep") -> Series:
    """Rank from 0 of the latest sample in its window."""
    if method not in ("min", "max", "avg") or na_option not in ("keep", "last"):
        raise ValueError("no such rank")
    f = Frame(r, x.keys, x=x)
    all_ = f.over(F.collect_list("x_ok"))
    newest = f.over(F.last(F.when(F.col("_sampled"), F.col("x")), ignorenulls=True)) if na_option == "keep" else f.over(F.last("x_ok", ignorenulls=True))
    rows = f.rows.withColumn("_all", all_).withColumn("_new", newest)
    f.rows = rows
    less, upto = F.size(F.filter("_all", lambda e: e < F.col("_new"))), F.size(F.filter("_all", lambda e: e <= F.col("_new")))
    value = {"min": less, "max": upto - 1, "avg": (less + upto - 1) / 2}[method].cast("double")
    return f.result(F.when(F.col("_new").isNull() | F.isnan("_new"), F.lit(NAN)).otherwise(value))


def _centred(f: Frame, name: str) -> Column:
    """A column less a value amid those of its key: central moments stay as
    they are, and differences of sums keep their digits."""
    whole = Window.partitionBy(*f.keys).orderBy("ts", "cycle").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = f"_mid_{name}"
    if named not in f.rows.columns:
        f.rows = f.rows.withColumn(named, F.avg(F.when(~F.isnan(name), F.col(name))).over(whole))
    return F.col(name) - F.col(named)


def _moments(f: Frame, weights: Series | None, x: str = "x_ok", y: str = "x_ok") -> tuple[Column, Column]:
    """(weight, weighted centred product sum) of a window; w <= 0 is skipped."""
    if weights is None:
        n = f.over(F.count(x)).cast("double")
        return n, f.over(F.covar_pop(x, y) if x != y else F.var_pop(x)) * n
    w = F.when((F.col("_w") > 0) & F.col(x).isNotNull(), F.col("_w"))
    s = lambda c: f.over(F.sum(c))
    total, dx, dy = s(w), _centred(f, x), _centred(f, y)
    return total, s(w * dx * dy) - s(w * dx) * s(w * dy) / F.nullif(total, F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    """a / b where b > 0, else NaN."""
    return _nan(F.when(b > 0, a / F.when(b > 0, b)))


def var(x: Series, r: Rules, ddof: int = 1, weights: Series | None = None) -> Series:
    f = Frame(r, x.keys, weights, x=x)
    w, m = _moments(f, weights)
    return f.result(_ratio(F.greatest(m, F.lit(0.0)), w - ddof))


def stddev(x: Series, r: Rules, ddof: int = 1, weights: Series | None = None) -> Series:
    return var(x, r, ddof, weights).map(F.sqrt)


def sem(x: Series, r: Rules, ddof: int = 1, weights: Series | None = None) -> Series:
    f = Frame(r, x.keys, weights, x=x)
    w, m = _moments(f, weights)
    return f.result(F.sqrt(_ratio(_ratio(F.greatest(m, F.lit(0.0)), w - ddof), w)))


def cov(x: Series, y: Series, r: Rules, ddof: int = 1, weights: Series | None = None, allow_non_overlapping: bool = False) -> Series:
    f = Frame(r, x.keys, weights, "overlap" if allow_non_overlapping else "strict", x=x, y=y)
    w, m = _moments(f, weights, "x_ok", "y_ok")
    return f.result(_ratio(m, w - ddof))


def corr(x: Series, y: Series, r: Rules, weights: Series | None = None, allow_non_overlapping: bool = False) -> Series:
    """Correlation; NaN where either variance is under 1e-9."""
    f = Frame(r, x.keys, weights, "overlap" if allow_non_overlapping else "strict", x=x, y=y)
    (w, xy), (_, xx), (_, yy) = _moments(f, weights, "x_ok", "y_ok"), _moments(f, weights, "x_ok", "x_ok"), _moments(f, weights, "y_ok", "y_ok")
    flat = (xx / F.nullif(w, F.lit(0.0)) < 1e-9) | (yy / F.nullif(w, F.lit(0.0)) < 1e-9)
    return f.result(F.when(flat, F.lit(NAN)).otherwise(_ratio(xy, F.sqrt(xx) * F.sqrt(yy))))


def _central(f: Frame, weights: Series | None, p: int) -> tuple[Column, Column, Column, Column]:
    """(rows, variance, third, fourth) central moments over the weights."""
    x, n = _centred(f, "x_ok"), f.over(F.count("x_ok")).cast("double")
    w = F.lit(1.0) if weights is None else F.when(F.col("_w") > 0, F.col("_w"))
    s = [f.over(F.sum(F.when(x.isNotNull(), w) * x**k if k else F.when(x.isNotNull(), w))) for k in range(p + 1)]
    m = [c / F.nullif(s[0], F.lit(0.0)) for c in s]
    v = m[2] - m[1] * m[1]
    third = m[3] - 3 * m[1] * m[2] + 2 * m[1] ** 3
    fourth = m[4] - 4 * m[1] * m[3] + 6 * m[1] ** 2 * m[2] - 3 * m[1] ** 4 if p > 3 else F.lit(0.0)
    return n, v, third, fourth


def skew(x: Series, r: Rules, bias: bool = False, weights: Series | None = None) -> Series:
    f = Frame(r, x.keys, weights, x=x)
    n, v, third, _ = _central(f, weights, 3)
    raw = f.over(F.skewness("x_ok")) if weights is None else third / F.when(v > 0, v ** F.lit(1.5))
    value = raw if bias else raw * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    flat = f.over(F.var_pop("x_ok")) if weights is None else v
    return f.result(_nan(F.when((n > 2) & (flat >= 1e-9), value)))


def kurt(x: Series, r: Rules, excess: bool = True, bias: bool = False, weights: Series | None = None) -> Series:
    f = Frame(r, x.keys, weights, x=x)
    n, v, _, fourth = _central(f, weights, 4)
    raw = f.over(F.kurtosis("x_ok")) + 3 if weights is None else fourth / F.when(v > 0, v * v)
    fair = ((n * n - 1) * raw - 3 * (n - 1) ** F.lit(2)) / F.when(n > 3, (n - 2) * (n - 3)) + 3
    value = (raw if bias else fair) - (3 if excess else 0)
    flat = f.over(F.var_pop("x_ok")) if weights is None else v
    return f.result(_nan(F.when((n > 3) & (flat >= 1e-9), value)))


def cross_sectional(x: Series, r: Rules) -> Series:
    """The samples of the window, oldest first, NaN kept."""
    f = Frame(r, x.keys, x=x)
    return f.result(f.over(F.collect_list(F.when(F.col("_sampled"), F.col("x")))), poison=False)


def _shared(r: Rules, weights: Series | None, size: int | None, members: Callable[[DataFrame, int], DataFrame], names: tuple[str, ...]) -> tuple[Rules, Series | None]:
    """The rules and weights of arrays, for each of their elements: a copy of
    the ticks of trigger, sampler, reset and weights for every member."""

    def dealt(s: Series | None) -> Series | None:
        if s is None:
            return None
        if size is None:
            raise ValueError("trigger, sampler, reset and weights of arrays need the arrays' size")
        return Series(members(s.df, size).select(*s.keys, *names, "ts", "cycle", "value"), (*s.keys, *names))

    return replace(r, trigger=dealt(r.trigger), sampler=dealt(r.sampler), reset=dealt(r.reset)), dealt(weights)


def each_element(stat, x: Series, r: Rules, *args, size: int | None = None, weights: Series | None = None, **kwargs) -> Series:
    """A statistic of every element of array values, as arrays; size is the
    arrays' length, needed with weights or a trigger, sampler or reset."""
    from ..operators.baskets import from_array

    r, weights = _shared(r, weights, size, lambda df, n: df.withColumn("_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ("_idx",))
    parts = stat(from_array(x, "_idx", size), r, *args, **kwargs, **({"weights": weights} if weights is not None else {}))
    rows = parts.df.groupBy(*x.keys, "ts", "cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("_idx", "value"))), lambda e: e["value"]).alias("value"))
    return Series(rows, x.keys)


def _matrix(stat, x: Series, r: Rules, size: int | None, weights: Series | None, **kwargs) -> Series:
    """A symmetric statistic of all pairs of elements: the pairs (i, j) with
    i <= j are series of their own, put together again by one grouping."""

    def pairs_of(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.lit(n - 1))))

    r, weights = _shared(r, weights, size, pairs_of, ("_i", "_j"))
    rows = x.df.select(*x.keys, "ts", "cycle", "value", F.posexplode("value").alias("_i", "_x"))
    rest = F.slice("value", F.col("_i") + 1, F.size("value"))
    pairs = rows.select(*x.keys, "ts", "cycle", "_i", "_x", F.posexplode(rest).alias("_k", "_y")).withColumn("_j", F.col("_i") + F.col("_k"))
    keys = (*x.keys, "_i", "_j")
    pick = lambda n: Series(pairs.select(*keys, "ts", "cycle", F.col(n).cast("double").alias("value")), keys)
    out = stat(pick("_x"), pick("_y"), r, weights=weights, **kwargs).df
    half = out.groupBy(*x.keys, "ts", "cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_j", "value"))), lambda e: e["value"]).alias("_half"))
    half = half.withColumn("_n", ((F.sqrt(F.size("_half") * 8 + 1) - 1) / 2).cast("int"))
    each = F.sequence(F.lit(0), F.col("_n") - 1)

    def entry(i: Column, j: Column) -> Column:
        lo, hi = F.least(i, j), F.greatest(i, j)
        return F.get("_half", lo * F.col("_n") - F.shiftright(lo * (lo - 1), 1) + hi - lo)

    full = F.transform(each, lambda i: F.transform(each, lambda j: entry(i, j)))
    return Series(half.select(*x.keys, "ts", "cycle", full.alias("value")), x.keys)


def cov_matrix(x: Series, r: Rules, ddof: int = 1, weights: Series | None = None, size: int | None = None) -> Series:
    """Covariances of all pairs of elements of array values; size is the
    arrays' length, needed with weights or a trigger, sampler or reset."""
    return _matrix(cov, x, r, size, weights, ddof=ddof)


def corr_matrix(x: Series, r: Rules, weights: Series | None = None, size: int | None = None) -> Series:
    """Correlations, as cov_matrix() has covariances."""
    return _matrix(corr, x, r, size, weights)


def tumbling(df: DataFrame, keys: tuple[str, ...], every: str, **aggs: Column) -> DataFrame:
    """Aggregates of each key over windows that follow each other: what a
    trigger with a reset right after it gives."""
    out = df.groupBy(*keys, F.window("ts", every).alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, F.col("_w.start").alias("window_start"), *aggs)
