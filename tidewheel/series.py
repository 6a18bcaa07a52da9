"""Series: time-ordered ticks in a DataFrame.

A tick is a row with optional key columns, ``ts`` (timestamp_ntz), ``cycle``
(int: ticks that share a timestamp are numbered) and ``value``. A series with
keys stands for a basket: all operators work on each key on its own. Absence
of a tick is absence of a row; NaN is a value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def naive_utc(t: datetime) -> datetime:
    """Times with a zone are taken to UTC; naive ones are UTC already."""
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


@dataclass(frozen=True)
class RunSpec:
    """Start and end of a run. end may be a duration; start is required."""

    start: datetime
    end: datetime | timedelta

    def __post_init__(self) -> None:
        if self.start is None:
            raise ValueError("a run needs a start")
        object.__setattr__(self, "start", naive_utc(self.start))
        end = self.start + self.end if isinstance(self.end, timedelta) else naive_utc(self.end)
        object.__setattr__(self, "end", end)
        if end < self.start:
            raise ValueError("a run ends after its start")

    def at(self, t: datetime | timedelta) -> datetime:
        return self.start + t if isinstance(t, timedelta) else naive_utc(t)


def interval(d: timedelta) -> Column:
    micros = (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds
    return F.expr(f"make_dt_interval(0, 0, 0, {micros / 1e6:.6f})")


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp_ntz since 1970, whatever the session's zone."""
    since = F.col(ts) if isinstance(ts, str) else ts
    minutes = F.unix_date(F.to_date(since)).cast("long") * 1440 + F.hour(since) * 60 + F.minute(since)
    seconds = F.extract(F.lit("SECOND"), since).cast("decimal(20,6)")
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def position(ts: str = "ts", cycle: str = "cycle") -> Column:
    """Twice the microseconds, and the cycle as a fraction under one half:
    ascending with (ts, cycle), and whole numbers apart only by time, so that
    bound() can bound windows in time whatever the number of cycles."""
    return (micros(ts) * 2).cast("decimal(28,10)") + F.col(cycle).cast("decimal(20,0)") * F.lit(Decimal("0.0000000001"))


def bound(ago: timedelta, closed: bool, start: bool) -> int:
    """Offset on position() of the start or end of a frame `ago` before a
    tick; closed: with the ticks of that very time, in all of their cycles."""
    twice = 2 * ((ago.days * 86_400 + ago.seconds) * 1_000_000 + ago.microseconds)
    return -twice + ((-1 if closed else 1) if start else (1 if closed else -1))


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, ts: str = "ts", value: str | Column = "value", keys: tuple[str, ...] = (), order: tuple[str, ...] = (), unique: bool = False) -> Series:
        """A series from the columns of df. Ticks of a key that share a
        timestamp are numbered in the given order, or else by a hash of their
        values. unique says that there are none, which saves the numbering;
        where that is wrong, operators may merge such ticks."""
        v = F.col(value) if isinstance(value, str) else value
        cols = [*(F.col(k) for k in keys), F.col(ts).cast("timestamp_ntz").alias("ts")]
        if unique:
            return cls(df.select(*cols, F.lit(0).alias("cycle"), v.alias("value")), keys)
        same = order or ("_by",)
        rows = df.select(*cols, v.alias("value"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)])
        rows = rows if order else rows.withColumn("_by", F.lit(0) if "map<" in dict(rows.dtypes)["value"] else F.xxhash64("value"))
        # Over the keys alone, so that what follows finds the ticks dealt out already.
        by_time = Window.partitionBy(*keys).orderBy("ts")
        number = F.row_number().over(by_time.orderBy("ts", *(f"_{k}" if order else c for k, c in enumerate(same)))) - F.rank().over(by_time)
        return cls(rows.select(*keys, "ts", number.cast("int").alias("cycle"), "value"), keys)

    @property
    def past(self) -> WindowSpec:
        """All ticks of a key up to the current one."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("ts", "cycle")

    @property
    def by_position(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(position())

    def map(self, fn: Callable[[Column], Column]) -> Series:
        return self.with_value(fn(F.col("value")))

    def with_value(self, value: Column, where: Column | None = None) -> Series:
        df = self.df if where is None else self.df.where(where)
        return Series(df.select(*self.keys, "ts", "cycle", value.alias("value")), self.keys)

    def where(self, condition: Column) -> Series:
        return Series(self.df.where(condition), self.keys)

    def pipe(self, fn: Callable, *args, **kwargs):
        return fn(self, *args, **kwargs)

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.keys, "ts", "cycle")

    def collect(self) -> list[tuple]:
        """[(time, value)] of a series without keys, for small results."""
        return [(r["ts"], r["value"]) for r in self.sorted().collect()]


def spine(keys: tuple[str, ...], **series: Series) -> DataFrame:
    """One row for each key, ts and cycle at which any of the series ticks,
    with for each name: ``name`` the latest value, ``name_ticked`` and
    ``name_valid`` (has ticked so far). One shuffle, on the keys; series
    without keys take part in every key only if no series has keys."""
    if len(series) == 1:  # its ticks are their own spine: no union, no grouping
        ((name, s),) = series.items()
        yes = F.lit(True)
        return s.df.select(*keys, "ts", "cycle", F.col("value").alias(name), yes.alias(f"{name}_ticked"), yes.alias(f"{name}_valid"))
    parts = None
    for name, s in series.items():
        cols = [F.struct(F.col("value")).alias(f"_{n}") if n == name else F.lit(None).cast(f"struct<value:{dict(o.df.dtypes)['value']}>").alias(f"_{n}") for n, o in series.items()]
        part = s.df.select(*keys, "ts", "cycle", *cols)
        parts = part if parts is None else parts.unionByName(part)
    dealt = parts.repartition(*keys) if keys else parts
    rows = dealt.groupBy(*keys, "ts", "cycle").agg(*[F.first(f"_{n}", ignorenulls=True).alias(f"_{n}") for n in series])
    past = Window.partitionBy(*keys).orderBy("ts", "cycle").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.select(*keys, "ts", "cycle", *[c for n in series for c in (F.last(f"_{n}", ignorenulls=True).over(past).alias(f"_{n}"), F.col(f"_{n}").isNotNull().alias(f"{n}_ticked"))])
    return held.select(*keys, "ts", "cycle", *[c for n in series for c in (F.col(f"_{n}.value").alias(n), f"{n}_ticked", F.col(f"_{n}").isNotNull().alias(f"{n}_valid"))])


def series_of(df: DataFrame, keys: tuple[str, ...], value: Column, where: Column) -> Series:
    return Series(df.where(where).select(*keys, "ts", "cycle", value.alias("value")), keys)


def spark_type(t: object) -> str:
    """DDL type of a Python type, as sources declare them."""
    if isinstance(t, str):
        return t
    simple = {bool: "boolean", int: "bigint", float: "double", str: "string", bytes: "binary", datetime: "timestamp_ntz", timedelta: "interval day to second", date: "date"}
    if t in simple:
        return simple[t]
    origin, args = getattr(t, "__origin__", None), getattr(t, "__args__", ())
    if origin is list:
        return f"array<{spark_type(args[0])}>"
    if origin is dict:
        return f"map<{spark_type(args[0])},{spark_type(args[1])}>"
    if hasattr(t, "__annotations__"):
        return "struct<" + ",".join(f"{k}:{spark_type(v)}" for k, v in t.__annotations__.items()) + ">"
    raise TypeError(f"no column type for {t!r}: opaque Python objects are not values of a series")


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def session(app: str = "tidewheel", **conf: str) -> SparkSession:
    """A session with the settings the library relies on."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
