"""Operators on ticks of one or two series.

Ticks of one key are always compared through the same partitioning, so chains
of these operators over keyed series shuffle once for each join.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..series import RunSpec, Series, bound, interval, series_of, spine


def sample(trigger: Series, x: Series) -> Series:
    """The latest value of x (of the same cycle too) whenever trigger ticks."""
    both = spine(trigger.keys, t=trigger, x=x)
    return series_of(both, trigger.keys, F.col("x"), F.col("t_ticked") & F.col("x_valid"))


def filter(flag: Series, x: Series) -> Series:
    """Ticks of x while the latest flag is true."""
    both = spine(x.keys, f=flag, x=x)
    return series_of(both, x.keys, F.col("x"), F.col("x_ticked") & F.col("f_valid") & F.col("f"))


def split(flag: Series, x: Series) -> tuple[Series, Series]:
    """Ticks of x while flag is true, and while it is false; none before flag
    has ticked."""
    both, known = spine(x.keys, f=flag, x=x), F.col("x_ticked") & F.col("f_valid")
    return series_of(both, x.keys, F.col("x"), known & F.col("f")), series_of(both, x.keys, F.col("x"), known & ~F.col("f"))


def merge(x: Series, y: Series) -> Series:
    """Ticks of both; x wins in the same cycle."""
    both = spine(x.keys, x=x, y=y)
    return series_of(both, x.keys, F.when(F.col("x_ticked"), F.col("x")).otherwise(F.col("y")), F.col("x_ticked") | F.col("y_ticked"))


def combine_latest(fn: Callable[..., Column], *inputs: Series) -> Series:
    """fn of the latest values whenever any input ticks, once all have."""
    named = {f"i{k}": s for k, s in enumerate(inputs)}
    both = spine(inputs[0].keys, **named)
    valid = F.lit(True)
    for n in named:
        valid = valid & F.col(f"{n}_valid")
    return series_of(both, inputs[0].keys, fn(*map(F.col, named)), valid)


def drop_nans(x: Series) -> Series:
    return x.where(~F.isnan("value"))


def first_n(x: Series, n: int) -> Series:
    """The first n ticks; none for n of 0 or less."""
    return series_of(x.df.withColumn("_n", F.row_number().over(x.ordered)), x.keys, F.col("value"), F.col("_n") <= n)


def drop_dups(x: Series) -> Series:
    """Ticks whose value differs from the last one emitted; NaN equals NaN.
    With exact comparison that is the last tick, so no fold is needed."""
    before = F.lag("value").over(x.ordered)
    same = (F.row_number().over(x.ordered) > 1) & F.col("value").eqNullSafe(before)
    return series_of(x.df.withColumn("_same", same), x.keys, F.col("value"), ~F.col("_same"))


def count(x: Series) -> Series:
    return x.with_value(F.row_number().over(x.ordered).cast("long"))


def accum(x: Series, start: float | int = 0) -> Series:
    """start plus the sum of all ticks so far."""
    return x.with_value(F.lit(start) + F.sum("value").over(x.past))


def delay(x: Series, by: timedelta | int, run: RunSpec | None = None) -> Series:
    """By a duration: each tick comes that much later (not after the end of
    the run). By n ticks: each tick brings the value of n ticks before."""
    if isinstance(by, timedelta):
        if by < timedelta(0):
            raise ValueError("a delay is not negative")
        late = Series(x.df.withColumn("ts", F.col("ts") + interval(by)), x.keys)
        return late.where(F.col("ts") <= F.lit(run.end).cast("timestamp_ntz")) if run else late
    if by <= 0:
        raise ValueError("a delay is one tick or more")
    old = x.df.select("*", F.lag("value", by).over(x.ordered).alias("_old"), F.row_number().over(x.ordered).alias("_n"))
    return series_of(old, x.keys, F.col("_old"), F.col("_n") > by)


def diff(x: Series, lag: timedelta | int) -> Series:
    """x less its value lag ago, by ticks or by time."""
    if not isinstance(lag, timedelta):
        old = x.df.select("*", F.lag("value", lag).over(x.ordered).alias("_old"), F.row_number().over(x.ordered).alias("_n"))
        return series_of(old, x.keys, F.col("value") - F.col("_old"), F.col("_n") > lag)
    both = spine(x.keys, x=x, o=delay(x, lag))
    return series_of(both, x.keys, F.col("x") - F.col("o"), F.col("x_ticked") & F.col("o_valid"))


def unroll(x: Series) -> Series:
    """Elements of list values, one a cycle; lists that come while one is
    being emitted queue behind it."""
    rows = x.df.select(*x.keys, "ts", F.col("cycle").alias("_at"), F.posexplode("value").alias("_pos", "value"))
    # At one timestamp element j of all that are queued leaves in cycle max over earlier lists of (arrival + elements since).
    order = Window.partitionBy(*x.keys, "ts").orderBy("_at", "_pos")
    nth = F.row_number().over(order) - 1
    cycle = nth + F.max(F.col("_at") - F.col("_first")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_nth", nth).withColumn("_first", F.min("_nth").over(Window.partitionBy(*x.keys, "ts", "_at")))
    return Series(rows.select(*x.keys, "ts", cycle.cast("int").alias("cycle"), "value"), x.keys)


def default(x: Series, value: object, run: RunSpec, after: timedelta = timedelta(0)) -> Series:
    """x, with a tick of value at the start (plus after) unless x has ticked
    by then. For keyed series, each key that x has gets one."""
    at = F.lit(run.start + after).cast("timestamp_ntz")
    kind = dict(x.df.dtypes)["value"]
    if x.keys:
        firsts = x.df.groupBy(*x.keys).agg(F.min("ts").alias("_first"))
        add = firsts.where(F.col("_first") > at)
    else:
        add = x.df.agg(F.min("ts").alias("_first")).where(F.col("_first").isNull() | (F.col("_first") > at))
    return Series(x.df.unionByName(add.select(*x.keys, at.alias("ts"), F.lit(0).alias("cycle"), F.lit(value).cast(kind).alias("value"))), x.keys)


def gate(x: Series, release: Series, release_on_tick: bool = False) -> Series:
    """Lists of the ticks of x: each is emitted at once while release is true,
    and otherwise held until release next ticks true (release_on_tick: always
    held until then, or let through if it ticks true in the same cycle)."""
    both = spine(x.keys, x=x, r=release)
    open_now = F.col("r_ticked") & F.col("r") if release_on_tick else F.col("r_valid") & F.col("r")
    out_at = F.when(open_now, F.struct("ts", "cycle"))
    ahead = Window.partitionBy(*x.keys).orderBy("ts", "cycle").rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumn("_out", F.first(out_at, ignorenulls=True).over(ahead)).where(F.col("x_ticked") & F.col("_out").isNotNull())
    lists = rows.groupBy(*x.keys, "_out").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "cycle", "x"))), lambda e: e["x"]).alias("value"))
    return Series(lists.select(*x.keys, F.col("_out.ts").alias("ts"), F.col("_out.cycle").alias("cycle"), "value"), x.keys)


def multiplex(x: Series, key: Series, by: str, tick_on_index: bool = False) -> Series:
    """Ticks of those members of basket x (keyed by column `by`) that key
    names; tick_on_index: also the member's latest value when key ticks."""
    rest = tuple(k for k in x.keys if k != by)
    members = x.df.select(*rest, "ts", "cycle", F.struct(F.col(by).alias("k"), F.col("value").alias("v")).alias("value"))
    # Members may tick in one cycle, so each gets its own row: the key is joined as of their time.
    ticks = members.select(*rest, "ts", "cycle", F.col("value").alias("_x"), F.lit(None).cast(f"struct<k:{dict(key.df.dtypes)['value']}>").alias("_k"))
    keyed = key.df.select(*rest, "ts", "cycle", F.lit(None).cast(members.schema["value"].dataType).alias("_x"), F.struct(F.col("value").alias("k")).alias("_k"))
    now = Window.partitionBy(*rest).orderBy("ts", "cycle").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ticks.unionByName(keyed).withColumn("_now", F.last("_k", ignorenulls=True).over(now))
    out = rows.where(F.col("_x").isNotNull() & (F.col("_x.k") == F.col("_now.k"))).select(*rest, "ts", "cycle", F.col("_x.v").alias("value"))
    if tick_on_index:
        asked = key.df.select(*rest, F.col("value").alias(by), "ts", "cycle", F.lit(True).alias("value"))
        held = sample(Series(asked, x.keys), x)
        own = out.select(*rest, "ts", "cycle").withColumn("_own", F.lit(True))
        more = held.df.join(own, [*rest, "ts", "cycle"], "left_anti")
        out = out.unionByName(more.select(*rest, "ts", "cycle", "value"))
    return Series(out, rest)


def demultiplex(x: Series, key: Series, name: str = "key", keys: list | None = None, raise_on_bad_key: bool = False) -> Series:
    """x as a basket: each tick under the latest key, which is kept in column
    `name`; with keys, ticks under others are dropped or raise."""
    both = spine(x.keys, k=key, x=x).where(F.col("x_ticked") & F.col("k_valid"))
    if keys is not None:
        bad = F.raise_error(F.concat(F.lit("no such key: "), F.col("k").cast("string"))).cast("boolean") if raise_on_bad_key else F.lit(False)
        both = both.where(F.when(F.col("k").isin(keys), F.lit(True)).otherwise(bad))
    return Series(both.select(*x.keys, F.col("k").alias(name), "ts", "cycle", F.col("x").alias("value")), (*x.keys, name))


def struct_field(x: Series, field: str) -> Series:
    """A field of struct values; ticks where it is set."""
    return x.with_value(F.col(f"value.{field}"), F.col(f"value.{field}").isNotNull())


def cast_int_to_float(x: Series) -> Series:
    return x.map(lambda v: v.cast("double"))


def static_cast(x: Series, kind: str) -> Series:
    """The same values under another declared type; bad values raise."""
    return x.map(lambda v: v.cast(kind))


def apply(x: Series, fn: Callable[[Column], Column]) -> Series:
    """fn of each value; fn makes a column expression."""
    return x.map(fn)


def binop(x: Series, y: Series, fn: Callable[[Column, Column], Column]) -> Series:
    """fn of the latest values of both, whenever either ticks."""
    return combine_latest(fn, x, y)


def times(x: Series) -> Series:
    return x.with_value(F.col("ts"))


def times_ns(x: Series) -> Series:
    from ..series import micros

    return x.with_value(micros("ts") * 1000)


def stop_at(x: Series, stop: Series) -> Series:
    """x up to and with the cycle in which stop first ticks."""
    first = stop.df.groupBy(*stop.keys).agg(F.min(F.struct("ts", "cycle")).alias("_stop"))
    kept = x.df.join(first, list(x.keys), "left") if x.keys else x.df.join(F.broadcast(first))  # without keys first is one row
    return series_of(kept, x.keys, F.col("value"), F.col("_stop").isNull() | (F.struct("ts", "cycle") <= F.col("_stop")))


def struct_collect(keys: tuple[str, ...] = (), **fields: Series) -> Series:
    """Structs of the fields that ticked in each cycle; others are null."""
    rows = spine(keys, **fields)
    value = F.struct(*[F.when(F.col(f"{n}_ticked"), F.col(n)).alias(n) for n in fields])
    return series_of(rows, keys, value, F.lit(True))


def struct_from(keys: tuple[str, ...] = (), trigger: Series | None = None, **fields: Series) -> Series:
    """Structs of the latest fields that are valid, whenever one ticks or, with
    a trigger, whenever that does."""
    value = F.struct(*[F.col(n).alias(n) for n in fields])
    if trigger is None:
        return series_of(spine(keys, **fields), keys, value, F.lit(True))
    rows = spine(keys, _t=trigger, **fields)
    any_valid = F.lit(False)
    for n in fields:
        any_valid = any_valid | F.col(f"{n}_valid")
    return series_of(rows, keys, value, F.col("_t_ticked") & any_valid)


def history(x: Series, size: int | None = None, span: timedelta | None = None) -> Series:
    """The past ticks at each tick, as a list of (ts, value), oldest first:
    the last `size`, those within `span`, or all. With neither, each tick
    holds its whole past."""
    if size is not None:
        frame = x.ordered.rowsBetween(-(size - 1), 0)
        return x.with_value(F.collect_list(F.struct("ts", "value")).over(frame))
    frame = x.by_position.rangeBetween(bound(span, True, True), 0) if span is not None else x.past
    return x.with_value(F.collect_list(F.struct("ts", "value")).over(frame))


def value_at(x: Series, ago: int | timedelta, first: bool = False, otherwise: object = None) -> Series:
    """The value `ago` ticks or time before each tick (as of then); of ticks
    at one timestamp the last, or the first. Where there is none: otherwise."""
    if isinstance(ago, int):
        return x.with_value(F.coalesce(F.lag("value", ago).over(x.ordered), F.lit(otherwise)) if ago else F.col("value"))
    if not ago:
        return x
    named = F.first("value").over(Window.partitionBy(*x.keys, "ts").orderBy("cycle")) if first else F.col("value")
    then = F.last(F.struct("_v")).over(x.by_position.rangeBetween(Window.unboundedPreceding, bound(ago, True, False)))
    got = x.df.withColumn("_v", named).withColumn("_then", then)
    return Series(got.select(*x.keys, "ts", "cycle", F.when(F.col("_then").isNotNull(), F.col("_then._v")).otherwise(F.lit(otherwise)).alias("value")), x.keys)
