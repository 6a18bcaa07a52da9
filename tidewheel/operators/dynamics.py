"""Operators whose shape is not known at first: keys that come and go, edges
bound later, ranges of history, and structs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import StructType

from ..series import Series, bound, interval, spark_type
from .algebra import demultiplex, sample
from .baskets import attach, lifetimes


def dynamic(events: Series, graph: Callable[..., Series], snap: dict[str, Series] | None = None, attached: dict[str, Series] | None = None) -> Series:
    """A sub-graph for each key while it lives. events: true where a key is
    added, false where it is removed. graph gets, by name, the attached
    series of the key within its life and, for each of snap (keyed like
    events), the value as of when the key was added. All keys run as one plan,
    partitioned by key."""
    lives = lifetimes(events)
    born = events.where(F.col("value"))
    inputs = {n: attach(s, lives) for n, s in (attached or {}).items()}
    inputs |= {n: sample(born, s) for n, s in (snap or {}).items()}
    return attach(graph(**inputs), lives)


class Delayed:
    """An edge that is used before it is bound."""

    def __init__(self, default: Series | None = None) -> None:
        self._series = default

    def bind(self, series: Series) -> None:
        self._series = series

    @property
    def out(self) -> Series:
        if self._series is None:
            raise RuntimeError("a delayed edge was never bound")
        return self._series


class DelayedDemultiplex:
    """Collects keys while a graph is put together and splits x once."""

    def __init__(self, x: Series, key: Series, raise_on_bad_key: bool = False) -> None:
        self.x, self.key, self.strict, self.keys = x, key, raise_on_bad_key, []

    def demultiplex(self, key: object) -> Callable[[], Series]:
        self.keys.append(key)
        return lambda: Series(self.basket().df.where(F.col("key") == key).drop("key"), self.x.keys)

    def basket(self) -> Series:
        if not self.strict:
            return demultiplex(self.x, self.key, "key", self.keys)
        out = demultiplex(self.x, self.key, "key")
        checked = F.when(F.col("key").isin(self.keys), F.col("key")).otherwise(F.raise_error(F.lit("a key that nobody asked for")))
        return Series(out.df.withColumn("key", checked), out.keys)


class Range(Enum):
    INCLUSIVE = 1
    EXCLUSIVE = 2
    EXTRAPOLATE = 3


def values_between(x: Series, start: timedelta, end: timedelta = timedelta(0), start_policy: Range = Range.INCLUSIVE, end_policy: Range = Range.INCLUSIVE) -> Series:
    """At each tick, the past ticks (ts, value) from `start` to `end` before
    it. A bound may be taken in, left out, or, with EXTRAPOLATE, given the
    value as of then."""
    if start < end or end < timedelta(0):
        raise ValueError("a range runs from the past to now")
    lo, hi = F.col("ts") - interval(start), F.col("ts") - interval(end)
    upto = 0 if not end and end_policy is not Range.EXCLUSIVE else bound(end, end_policy is not Range.EXCLUSIVE, False)
    got = F.collect_list(F.struct("ts", "value")).over(x.by_position.rangeBetween(bound(start, start_policy is not Range.EXCLUSIVE, True), upto))

    def as_of(ago: timedelta, t: Column) -> Column:
        frame = x.by_position.rangeBetween(Window.unboundedPreceding, bound(ago, True, False) if ago else 0)
        last = F.last(F.struct("value")).over(frame)
        return F.when(last.isNotNull(), F.array(F.struct(t.alias("ts"), last["value"].alias("value")))).otherwise(F.slice(got, 1, 0))

    first, newest = F.get(got, 0)["ts"], F.get(got, F.size(got) - 1)["ts"]
    whole = got
    if start_policy is Range.EXTRAPOLATE:
        whole = F.when(first.eqNullSafe(lo), whole).otherwise(F.concat(as_of(start, lo), whole))
    if end_policy is Range.EXTRAPOLATE:
        whole = F.when(newest.eqNullSafe(hi), whole).otherwise(F.concat(whole, as_of(end, hi)))
    return x.with_value(whole)


# Structs: values are immutable, so each of these makes new ones.


def define_struct(**fields: object) -> StructType:
    """A struct type from field names and Python types; dicts nest."""
    ddl = lambda t: "struct<" + ",".join(f"{k}:{ddl(v)}" for k, v in t.items()) + ">" if isinstance(t, dict) else spark_type(t)
    return StructType.fromDDL(", ".join(f"{k} {ddl(v)}" for k, v in fields.items()))


def update(value: Column, new: Column, fields: list[str]) -> Column:
    """value with those fields of new that are set."""
    for n in fields:
        value = value.withField(n, F.coalesce(new[n], value[n]))
    return value


def copy_from(value: Column, new: Column, fields: list[str]) -> Column:
    """value with all of the fields of new, set or not."""
    for n in fields:
        value = value.withField(n, new[n])
    return value


def all_fields_set(value: Column, fields: list[str]) -> Column:
    out = F.lit(True)
    for n in fields:
        out = out & value[n].isNotNull()
    return out


def strict(x: Series, fields: list[str]) -> Series:
    """x, raising where a required field is not set."""
    ok = all_fields_set(F.col("value"), fields)
    return x.with_value(F.when(ok, F.col("value")).otherwise(F.raise_error(F.lit("a required field is not set"))))
