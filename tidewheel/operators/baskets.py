"""Operators on baskets: series with a member key."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..series import Series
from .algebra import sample


def _arrival(x: Series, start: datetime) -> Series:
    """When the source of each tick scheduled it: at its tick before."""
    return Series(x.df.withColumn("arrival", F.coalesce(F.lag("ts").over(x.ordered), F.lit(start).cast("timestamp_ntz"))), x.keys)


def collect(basket: Series, member: str, start: datetime) -> Series:
    """Lists of the members that tick in a cycle, in order of arrival."""
    rest = tuple(k for k in basket.keys if k != member)
    rows = _arrival(basket, start).df
    lists = rows.groupBy(*rest, "ts", "cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("arrival", member, "value"))), lambda e: e["value"]).alias("value"))
    return Series(lists, rest)


def flatten(basket: Series, member: str, start: datetime) -> Series:
    """All members' ticks as one series; those of one cycle follow each other
    in order of arrival."""
    rest = tuple(k for k in basket.keys if k != member)
    order = Window.partitionBy(*rest, "ts").orderBy("cycle", "arrival", member)
    rows = _arrival(basket, start).df.withColumn("cycle", F.row_number().over(order) - 1)
    return Series(rows.select(*rest, "ts", "cycle", "value"), rest)


def dynamic_collect(basket: Series, member: str) -> Series:
    """Maps from member to value of those that tick in a cycle."""
    rest = tuple(k for k in basket.keys if k != member)
    return Series(basket.df.groupBy(*rest, "ts", "cycle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(member, "value")))).alias("value")), rest)


def sample_basket(trigger: Series, basket: Series, member: str, members: list) -> Series:
    """Every member's latest value whenever trigger ticks."""
    rest = tuple(k for k in basket.keys if k != member)
    each = trigger.df.withColumn(member, F.explode(F.array(*map(F.lit, members))))
    return sample(Series(each.select(*rest, member, "ts", "cycle", "value"), basket.keys), basket)


def basket_field(basket: Series, field: str) -> Series:
    return basket.with_value(F.col(f"value.{field}"), F.col(f"value.{field}").isNotNull())


def to_array(basket: Series, member: str, members: list, hold: bool = False) -> Series:
    """Arrays of the members' values in the given order at each cycle; those
    that do not tick are NaN or, with hold, their latest value."""
    rest = tuple(k for k in basket.keys if k != member)
    nan = F.lit(float("nan"))
    rows = basket.df.groupBy(*rest, "ts", "cycle").agg(*[F.first(F.when(F.col(member) == m, F.col("value").cast("double")), ignorenulls=True).alias(f"_{k}") for k, m in enumerate(members)])
    past = Window.partitionBy(*rest).orderBy("ts", "cycle").rowsBetween(Window.unboundedPreceding, 0)
    pick = [F.last(f"_{k}", ignorenulls=True).over(past) if hold else F.col(f"_{k}") for k in range(len(members))]
    return Series(rows.select(*rest, "ts", "cycle", F.array(*[F.coalesce(p, nan) for p in pick]).alias("value")), rest)


def from_array(x: Series, member: str = "idx", size: int | None = None) -> Series:
    """A basket of the elements of array values; with size, others raise."""
    df = x.df
    if size is not None:
        df = df.withColumn("value", F.when(F.size("value") == size, F.col("value")).otherwise(F.raise_error(F.lit(f"arrays of {size} elements are expected"))))
    return Series(df.select(*x.keys, "ts", "cycle", F.posexplode("value").alias(member, "value")), (*x.keys, member))


def lifetimes(events: Series) -> Series:
    """From a series of keys added (true) and removed (false), keyed by key:
    (added_at, removed_at) as structs at each addition; removed_at is null
    while the key lives."""
    after = F.first(F.when(~F.col("value"), F.col("ts")), ignorenulls=True).over(events.ordered.rowsBetween(1, Window.unboundedFollowing))
    rows = events.df.withColumn("_end", after)
    return Series(rows.where("value").select(*events.keys, "ts", "cycle", F.struct(F.col("ts").alias("added_at"), F.col("_end").alias("removed_at")).alias("value")), events.keys)


def attach(x: Series, lives: Series) -> Series:
    """Ticks of each key of x within its lives, with the cycle of removal."""
    held = lives.df.select(*x.keys, F.col("value.added_at").alias("_a"), F.col("value.removed_at").alias("_z"))
    rows = x.df.join(held, list(x.keys)).where((F.col("ts") >= F.col("_a")) & (F.col("_z").isNull() | (F.col("ts") <= F.col("_z"))))
    return Series(rows.select(*x.keys, "ts", "cycle", "value"), x.keys)


def reduce_members(basket: Series, member: str, members: list, how: str, ddof: int = 1, skipna: bool = True) -> Series:
    """A reduction across members at each cycle, of their latest values once
    all are valid: all any min max sum prod mean median std var sem skew kurt.
    Skew (of 3 members or more) and excess kurtosis (4) are unbiased, and 0 where
    the members are equal."""
    held = to_array(basket, member, members, hold=True)
    ok = F.filter(F.col("value"), lambda v: ~F.isnan(v)) if skipna else F.col("value")
    rows = held.df.withColumn("_v", ok).where(F.size("_v") > 0)
    v, n = F.col("_v"), F.size("_v")
    total = F.aggregate(v, F.lit(0.0), lambda a, e: a + e)
    mean = total / n
    var = F.when(n > ddof, F.aggregate(v, F.lit(0.0), lambda a, e: a + (e - mean) * (e - mean)) / F.nullif(n - ddof, F.lit(0))).otherwise(F.lit(float("nan")))
    s = F.array_sort(v)
    d = n.cast("double")
    power = lambda p: F.aggregate(v, F.lit(0.0), lambda a, e: a + F.pow(e - mean, F.lit(p)))
    second, third, fourth = power(2), power(3), power(4)
    least = F.nullif(second, F.lit(0.0))
    skew = F.coalesce(F.sqrt(d * (d - 1)) * F.sqrt(d) * third / F.nullif(d - 2, F.lit(0.0)) / F.pow(least, F.lit(1.5)), F.lit(0.0))
    pairs = F.nullif((d - 2) * (d - 3), F.lit(0.0))
    kurt = F.coalesce(d * (d + 1) * (d - 1) * fourth / pairs / (least * least) - 3 * (d - 1) * (d - 1) / pairs, F.lit(0.0))
    nan = F.lit(float("nan"))
    forms = {
        "all": F.forall(v, lambda e: e != 0), "any": F.exists(v, lambda e: e != 0), "min": F.array_min(v), "max": F.array_max(v), "sum": total, "prod": F.aggregate(v, F.lit(1.0), lambda a, e: a * e), "mean": mean,
        "median": (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, ((n + 2) / 2).cast("int"))) / 2, "var": var, "std": F.sqrt(var), "sem": F.sqrt(var / n),
        "skew": F.when(n > 2, skew).otherwise(nan), "kurt": F.when(n > 3, kurt).otherwise(nan),
    }
    return Series(rows.select(*held.keys, "ts", "cycle", forms[how].alias("value")), held.keys)
