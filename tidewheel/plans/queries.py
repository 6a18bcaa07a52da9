"""Queries over the driver's tables: one or more for each family of operators,
with equivalent DuckDB SQL where SQL can express them. Times of `events` are
unique, so it needs no cycle numbers; NaN is put in by both sides alike."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ewm, stats
from ..functions import math as m
from ..functions.stats import Rules
from ..operators import algebra as a
from ..operators import baskets as b
from ..operators import folds as f
from ..series import RunSpec, Series
from ..sources import files, generators, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

JAN = RunSpec(datetime(2024, 1, 1), datetime(2024, 2, 1))
KEY = ("user_id",)


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _of(*args, **kwargs) -> Series:
    """A series of a table that has one tick for each key and time."""
    return Series.of(*args, **{"unique": True} | kwargs)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, kind: str | None = None, value: str | Column = "value", keys: tuple[str, ...] = KEY) -> Series:
    df = table(spark, d, "events")
    return _of(df.where(F.col("event_type") == kind) if kind else df, "ts", value, keys)


def shown(s: Series, **value: Column) -> DataFrame:
    cols = [v.alias(n) for n, v in value.items()] if value else ["value"]
    return s.df.select(*s.keys, "ts", *cols)


def r6(name: str = "value") -> Column:
    return F.round(name, 6)


def near(digits: int, name: str = "value") -> Column:
    """Rounded for comparison. Values of few decimals often lie half-way
    between two results, where engines' last bits would decide; the shift
    moves them away from there."""
    return F.round(F.col(name) + 0.123 * 10.0**-digits, digits)


def near_sql(value: str, digits: int) -> str:
    return f"round({value} + {0.123 * 10.0**-digits!r}::double, {digits})"


W = "partition by user_id order by ts"


@query(f"select user_id, ts, row_number() over ({W}) as value from events")
def tick_count(spark, d):
    return shown(a.count(events(spark, d)))


@query(f"select user_id, ts, round(10 + sum(value) over ({W}), 6) as value from events")
def accum_value(spark, d):
    return shown(a.accum(events(spark, d), 10), value=r6())


@query(f"select user_id, ts, value from (select *, row_number() over ({W}) n from events) where n <= 3")
def first_n(spark, d):
    return shown(a.first_n(events(spark, d), 3))


@query(f"select user_id, ts, value from (select user_id, ts, lag(value, 2) over ({W}) as value, row_number() over ({W}) n from events) where n > 2")
def delay_ticks(spark, d):
    return shown(a.delay(events(spark, d), 2))


@query("select user_id, ts + interval 90 minute as ts, value from events where ts + interval 90 minute <= timestamp '2024-01-20'")
def delay_time(spark, d):
    return shown(a.delay(events(spark, d), timedelta(minutes=90), RunSpec(datetime(2024, 1, 1), datetime(2024, 1, 20))))


@query(f"select user_id, ts, round(v, 6) as value from (select user_id, ts, value - lag(value, 1) over ({W}) v, row_number() over ({W}) n from events) where n > 1")
def diff_ticks(spark, d):
    return shown(a.diff(events(spark, d), 1), value=r6())


@query("select e.user_id, e.ts, round(e.value - o.value, 6) as value from events e asof join (select user_id, ts + interval 1 day as ts, value from events) o on e.user_id = o.user_id and e.ts >= o.ts")
def diff_time(spark, d):
    return shown(a.diff(events(spark, d), timedelta(days=1)), value=r6())


@query("select t.user_id, t.ts, x.value from (select * from events where event_type = 'purchase') t asof join (select * from events where event_type = 'view') x on t.user_id = x.user_id and t.ts >= x.ts")
def sample_asof(spark, d):
    return shown(a.sample(events(spark, d, "purchase"), events(spark, d, "view")))


FLAG = "(select user_id, ts, value > 50 as flag from events where event_type = 'error')"


@query(f"select x.user_id, x.ts, x.value from (select * from events where event_type = 'view') x asof join {FLAG} g on x.user_id = g.user_id and x.ts >= g.ts where g.flag")
def filter_flag(spark, d):
    return shown(a.filter(events(spark, d, "error", F.col("value") > 50), events(spark, d, "view")))


@query(f"select x.user_id, x.ts, x.value, g.flag as side from (select * from events where event_type = 'view') x asof join {FLAG} g on x.user_id = g.user_id and x.ts >= g.ts")
def split_flag(spark, d):
    yes, no = a.split(events(spark, d, "error", F.col("value") > 50), events(spark, d, "view"))
    return shown(yes).withColumn("side", F.lit(True)).unionByName(shown(no).withColumn("side", F.lit(False)))


@query("select user_id, ts, value from events where event_type in ('click', 'view')")
def merge_streams(spark, d):
    return shown(a.merge(events(spark, d, "click"), events(spark, d, "view")))


LATEST = f"""select user_id, ts, last_value(case when event_type = 'click' then value end ignore nulls) over ({W}) c,
  last_value(case when event_type = 'view' then value end ignore nulls) over ({W}) v from events where event_type in ('click', 'view')"""


@query(f"select user_id, ts, round(c - v, 6) as value from ({LATEST}) where c is not null and v is not null")
def combine_latest_spread(spark, d):
    return shown(a.combine_latest(lambda x, y: x - y, events(spark, d, "click"), events(spark, d, "view")), value=r6())


@query("""select o_custkey, ts, cycle::int as cycle, value from (select o_custkey, o_orderdate as ts, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) - 1 as cycle, o_orderstatus as value,
  lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders) where before is distinct from value""")
def drop_dups_status(spark, d):
    s = _of(table(spark, d, "orders"), "o_orderdate", "o_orderstatus", ("o_custkey",), ("o_orderkey",), unique=False)
    return a.drop_dups(s).df


@query(f"select user_id, ts, value from events where event_id % 7 <> 0")
def drop_nans(spark, d):
    return shown(a.drop_nans(events(spark, d, value=F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))))


@query("""select user_id, out_ts as ts, count(*)::bigint as n, round(sum(value), 6) as total from (select x.user_id, x.value, (select min(p.ts) from events p where p.event_type = 'purchase' and p.user_id = x.user_id and p.ts >= x.ts) as out_ts
  from events x where x.event_type = 'view') where out_ts is not null group by all""")
def gate_release(spark, d):
    s = a.gate(events(spark, d, "view"), events(spark, d, "purchase", F.lit(True)), release_on_tick=True)
    return shown(s, n=F.size("value").cast("long"), total=F.round(F.aggregate("value", F.lit(0.0), lambda x, y: x + y), 6))


CHOICE = "(select user_id, ts, case when event_id % 2 = 0 then 'click' else 'view' end as k from events where event_type = 'error')"


def _choice(spark, d):
    return events(spark, d, "error", F.when(F.col("event_id") % 2 == 0, "click").otherwise("view"))


@query(f"select x.user_id, x.ts, x.value from events x asof join {CHOICE} g on x.user_id = g.user_id and x.ts >= g.ts where x.event_type = g.k")
def multiplex_key(spark, d):
    return shown(a.multiplex(events(spark, d, keys=("user_id", "event_type")), _choice(spark, d), "event_type"))


@query(f"select x.user_id, x.ts, g.k as chosen, x.value from (select * from events where event_type = 'purchase') x asof join {CHOICE} g on x.user_id = g.user_id and x.ts >= g.ts where g.k in ('click')")
def demultiplex_key(spark, d):
    return shown(a.demultiplex(events(spark, d, "purchase"), _choice(spark, d), "chosen", ["click"]))


@query("select event_type, ts, value from events e where exists (select 1 from events) and (ts, event_type) <= ((select min(ts) from events x where x.event_type = e.event_type and x.value > 99), event_type)")
def stop_engine(spark, d):
    df = table(spark, d, "events")
    return shown(a.stop_at(_of(df, keys=("event_type",)), _of(df.where("value > 99"), keys=("event_type",))))


@query("select user_id, ts, value from events union all select user_id, timestamp '2024-01-05', -1.0 from events group by user_id having min(ts) > timestamp '2024-01-05'")
def default_value(spark, d):
    return shown(a.default(events(spark, d), -1.0, JAN, timedelta(days=4)))


@query(f"select user_id, ts, (pos - 1)::int as cycle, (event_id * 10 + pos)::bigint as value from (select *, unnest(generate_series(1, event_id % 4)) as pos from events)")
def unroll_lists(spark, d):
    lists = F.when(F.col("event_id") % 4 > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("event_id") % 4)), lambda i: F.col("event_id") * 10 + i)).otherwise(F.array().cast("array<bigint>"))
    return a.unroll(events(spark, d, value=lists)).df


@query(f"select user_id, ts, round(c, 6) as click, round(v, 6) as view from ({LATEST})")
def struct_from_latest(spark, d):
    s = a.struct_from(KEY, c=events(spark, d, "click"), v=events(spark, d, "view"))
    return shown(s, click=F.round("value.c", 6), view=F.round("value.v", 6))


@query("select user_id, ts, case when event_type = 'click' then value end as click, case when event_type = 'view' then value end as view from events where event_type in ('click', 'view')")
def struct_collect_ticks(spark, d):
    s = a.struct_collect(KEY, c=events(spark, d, "click"), v=events(spark, d, "view"))
    return shown(s, click=F.col("value.c"), view=F.col("value.v"))


@query(f"select user_id, ts, lag(value, 3) over ({W}) as value from events")
def value_at_ticks(spark, d):
    return shown(a.value_at(events(spark, d), 3))


@query("select e.user_id, e.ts, o.value from events e asof left join (select user_id, ts + interval 2 day as ts, value from events) o on e.user_id = o.user_id and e.ts >= o.ts")
def value_at_time(spark, d):
    return shown(a.value_at(events(spark, d), timedelta(days=2)))


@query(f"select user_id, ts, (epoch_us(ts) * 1000)::bigint as value from events")
def times_ns(spark, d):
    return shown(a.times_ns(events(spark, d)))


# Rolling statistics over five ticks and one day.


def _tick(sql: str, least: int = 5, base: str = "events", digits: int = 6) -> str:
    return f"select user_id, ts, {near_sql('v', digits)} as value from (select user_id, ts, {sql.replace('@', f'over ({W} rows 4 preceding)')} as v, row_number() over ({W}) n from {base}) where n >= {least}"


def _time(sql: str, digits: int = 6) -> str:
    value = sql.replace("@", f"over ({W} range between interval 86399999999 microsecond preceding and current row)")
    return f"select user_id, ts, {near_sql(value, digits)} as value from events qualify ts >= timestamp '2024-01-02'"


FIVE, DAY = Rules(5), Rules(timedelta(days=1), run=JAN)
NULLED = "(select user_id, ts, event_id, case when event_id % 7 = 0 then null else value end as value, (event_id % 7 = 0)::int as bad from events)"


def _roll(name: str, stat, tick: str, time: str | None = None, digits: int = 6) -> None:
    def by_tick(spark, d):
        return shown(stat(events(spark, d), FIVE), value=near(digits))

    def by_time(spark, d):
        return shown(stat(events(spark, d), DAY), value=near(digits))

    QUERIES[f"roll_{name}_tick"], ORACLES[f"roll_{name}_tick"] = by_tick, _tick(tick, digits=digits)
    if time:
        QUERIES[f"roll_{name}_time"], ORACLES[f"roll_{name}_time"] = by_time, _time(time, digits)


for _name, _stat, _sql in (("count", stats.count, "(count(value) @)::double"), ("sum", stats.sum, "sum(value) @"), ("mean", stats.mean, "avg(value) @"), ("min", stats.min, "min(value) @"), ("max", stats.max_, "max(value) @")):
    _roll(_name, _stat, _sql, _sql)
_VAR = "coalesce(var_samp(value) @, 'NaN'::double)"
_roll("var", stats.var, "var_samp(value) @", _VAR, 5)
_roll("stddev", stats.stddev, "stddev_samp(value) @", "coalesce(stddev_samp(value) @, 'NaN'::double)")
_roll("sem", stats.sem, "stddev_samp(value) @ / sqrt(count(value) @)")
_roll("skew", stats.skew, "skewness(value) @")
_roll("kurt", stats.kurt, "kurtosis(value) @")
_roll("first", stats.first, "first_value(value) @")
_roll("last", stats.last, "last_value(value) @")
_roll("median", stats.median, "quantile_cont(value, 0.5) @", "quantile_cont(value, 0.5) @")
_roll("quantile", lambda x, r: stats.quantile(x, r, 0.3), "quantile_cont(value, 0.3) @")
_roll("gmean", lambda x, r: stats.gmean(x.map(lambda v: v + 1), r), "exp(avg(ln(value + 1)) @)")
_roll("prod", lambda x, r: stats.prod(x.map(lambda v: 1 + v / 1000), r), "product(1 + value / 1000) @")
_roll("unique", lambda x, r: stats.unique(x.map(lambda v: F.floor(v / 20).cast("double")), r), "len(list_distinct(list(floor(value / 20)) @))::double")
_roll("rank", stats.rank, "len(list_filter(list(value) @, lambda e: e < value))::double")
_roll("quantile_lower", lambda x, r: stats.quantile(x, r, 0.3, "lower"), "list_sort(list(value) @)[2]")
_roll("quantile_nearest", lambda x, r: stats.quantile(x, r, 0.625, "nearest"), "list_sort(list(value) @)[4]")


@query(f"select user_id, ts, value.t as value from (select user_id, ts, max({{'v': value, 't': ts}}) over ({W} rows 4 preceding) as value, row_number() over ({W}) n from events) where n >= 5")
def roll_argmax_tick(spark, d):
    return shown(stats.argmax(events(spark, d), FIVE))


@query(f"select user_id, ts, array_to_string(v, ',') as value from (select user_id, ts, list(round(value * 100)::bigint) over ({W} rows 4 preceding) as v, row_number() over ({W}) n from events) where n >= 5")
def cross_sectional_window(spark, d):
    s = stats.cross_sectional(events(spark, d), FIVE)
    return shown(s, value=F.array_join(F.transform("value", lambda v: F.round(v * 100).cast("long").cast("string")), ","))


def _with_nan(spark, d):
    return events(spark, d, value=F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))


@query(_tick("coalesce(avg(value) @, 'NaN'::double)", base=NULLED))
def nan_ignored_mean(spark, d):
    return shown(stats.mean(_with_nan(spark, d), FIVE), value=near(6))


@query(_tick("case when max(bad) @ = 1 then 'NaN'::double else sum(value) @ end", base=NULLED))
def nan_kept_sum(spark, d):
    return shown(stats.sum(_with_nan(spark, d), Rules(5, ignore_na=False)), value=near(6))


@query(_tick("case when count(value) @ < 4 then 'NaN'::double else max(value) @ end", least=1, base=NULLED))
def min_data_points_max(spark, d):
    return shown(stats.max_(_with_nan(spark, d), Rules(5, 1, min_data_points=4)), value=near(6))


LINES = "(select l_partkey, l_shipdate as ts, sum(l_quantity) as q, round(sum(l_extendedprice), 2) as p from lineitem group by 1, 2)"


def _lines(spark, d, value):
    df = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p"))
    return _of(df, "ts", value, ("l_partkey",))


def _pairs(sql: str, digits: int) -> str:
    return f"select l_partkey, ts, {near_sql('v', digits)} as value from (select l_partkey, ts, {sql.replace('@', 'over (partition by l_partkey order by ts rows 9 preceding)')} as v, row_number() over (partition by l_partkey order by ts) n from {LINES}) where n >= 10"


@query(_pairs("covar_samp(q, p) @", 2))
def roll_cov(spark, d):
    return shown(stats.cov(_lines(spark, d, "q"), _lines(spark, d, "p"), Rules(10)), value=near(2))


@query(_pairs("corr(q, p) @", 4))
def roll_corr(spark, d):
    return shown(stats.corr(_lines(spark, d, "q"), _lines(spark, d, "p"), Rules(10)), value=near(4))


@query(_pairs("sum(q * p) @ / sum(q) @", 2))
def weighted_mean_price(spark, d):
    return shown(stats.mean(_lines(spark, d, "p"), Rules(10), _lines(spark, d, "q")), value=near(2))


@query(_pairs("(sum(q * d * d) @ - (sum(q * d) @) * (sum(q * d) @) / sum(q) @) / (sum(q) @ - 1)", 2).replace(LINES, f"(select *, p - avg(p) over (partition by l_partkey) as d from {LINES})"))
def weighted_var_price(spark, d):
    return shown(stats.var(_lines(spark, d, "p"), Rules(10), weights=_lines(spark, d, "q")), value=near(2))


TIED = "(select l_partkey, l_shipdate::timestamp as ts, l_quantity as q, row_number() over (partition by l_partkey, l_shipdate order by l_orderkey, l_linenumber) as n from lineitem)"


def _tied(spark, d):
    """Several lines of a part on one day."""
    return Series.of(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "l_shipdate", "q", ("l_partkey",), ("l_orderkey", "l_linenumber"))


def _tied_sql(value: str) -> str:
    return f"select a.l_partkey, a.ts, (a.n - 1)::int as cycle, {value} as value from {TIED} a join {TIED} b on a.l_partkey = b.l_partkey and b.ts > a.ts - interval 30 day and (b.ts < a.ts or b.ts = a.ts and b.n <= a.n) group by a.l_partkey, a.ts, a.n"


@query(_tied_sql("round(sum(b.q), 6)::double"))
def roll_sum_time_ties(spark, d):
    return stats.sum(_tied(spark, d), Rules(timedelta(days=30), timedelta(0))).df.select("l_partkey", "ts", "cycle", F.round("value", 6).alias("value"))


@query(_tied_sql("count(*)::double"))
def roll_count_time_ties(spark, d):
    return stats.count(_tied(spark, d), Rules(timedelta(days=30), timedelta(0))).df


@query(f"select l_partkey, ts, (n - 1)::int as cycle, (select b.q from {TIED} b where b.l_partkey = a.l_partkey and b.ts <= a.ts - interval 10 day order by b.ts desc, b.n desc limit 1)::double as value from {TIED} a")
def value_at_time_ties(spark, d):
    return a.value_at(_tied(spark, d), timedelta(days=10)).df


@query("select user_id, ts, round(avg(value) over (partition by user_id, ts::date order by ts), 6) as value from events")
def expanding_mean_reset_daily(spark, d):
    df = table(spark, d, "events")
    firsts = df.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts")).withColumn("value", F.lit(True))
    return shown(stats.mean(events(spark, d), Rules(reset=_of(firsts, keys=KEY))), value=r6())


@query("select t.ts, round(coalesce(sum(e.value), 0), 6) as value from (select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-02-01', interval 1 day)) as ts) t left join events e on e.event_type = 'purchase' and e.ts <= t.ts and e.ts > t.ts - interval 3 day group by t.ts having t.ts >= timestamp '2024-01-04'")
def timer_trigger_sum(spark, d):
    daily = generators.timer(spark, JAN, timedelta(days=1))
    # Purchases of several users may share a time; a window at triggers counts each.
    return shown(stats.sum(events(spark, d, "purchase", keys=()), Rules(timedelta(days=3), trigger=daily, run=JAN)), value=r6())


@query(f"select user_id, ts, round(s, 6) as total, round(s / n, 6) as average from (select *, sum(value) over ({W} rows 4 preceding) s, count(value) over ({W} rows 4 preceding) n from events) where event_type = 'purchase'")
def rolling_at_purchases(spark, d):
    x, t = events(spark, d), events(spark, d, "purchase")
    total, average = (a.sample(t, stat(x, Rules(5, 1))) for stat in (stats.sum, stats.mean))
    both = a.struct_collect(KEY, total=total, average=average)
    return shown(both, total=F.round("value.total", 6), average=F.round("value.average", 6))


@query("select user_id, date_trunc('day', ts) as window_start, count(*) as n, round(sum(value), 6) as total from events group by all")
def tumbling_trigger_sum(spark, d):
    return stats.tumbling(table(spark, d, "events"), KEY, "1 day", n=F.count("*"), total=F.round(F.sum("value"), 6))


ALL = f"list(value) over ({W})"


@query(f"select user_id, ts, round(list_reduce({ALL}, lambda e, x: e + 0.2 * (x - e)), 6) as value from events")
def ema_alpha(spark, d):
    return shown(ewm.ema(events(spark, d), alpha=0.2, adjust=False), value=r6())


NUMBERED = f"(select *, row_number() over ({W}) n from events)"


@query(f"select e.user_id, e.ts, round(sum(o.value * pow(0.75, e.n - o.n)) / sum(pow(0.75, e.n - o.n)), 6) as value from {NUMBERED} e join {NUMBERED} o on e.user_id = o.user_id and o.n <= e.n group by e.user_id, e.ts")
def ema_span_adjusted(spark, d):
    return shown(ewm.ema(events(spark, d), span=7), value=r6())


@query(f"select e.user_id, e.ts, round(sum(o.value * pow(0.5, (epoch_us(e.ts) - epoch_us(o.ts)) / 86400000000.0)) / sum(pow(0.5, (epoch_us(e.ts) - epoch_us(o.ts)) / 86400000000.0)), 6) as value from events e join events o on e.user_id = o.user_id and o.ts <= e.ts group by e.user_id, e.ts")
def ema_halflife(spark, d):
    return shown(ewm.ema(events(spark, d), halflife=timedelta(days=1)), value=r6())


@query(f"""select user_id, ts, round(greatest(0, (q / w - (s / w) * (s / w)) * w * w / (w * w - v)) + 0.000123::double, 3) as value from (select e.user_id, e.ts, sum(o.value * pow(0.8, e.n - o.n)) s, sum(o.value * o.value * pow(0.8, e.n - o.n)) q, sum(pow(0.8, e.n - o.n)) w, sum(pow(0.64, e.n - o.n)) v
  from {NUMBERED} e join {NUMBERED} o on e.user_id = o.user_id and o.n <= e.n group by e.user_id, e.ts having count(*) >= 2)""")
def ema_variance(spark, d):
    return shown(ewm.ema_var(events(spark, d), alpha=0.2, min_periods=2), value=near(3))


@query("""select event_id, round(value / nullif(k, 0), 6) as quotient, value - 7 * floor(value / 7) as remainder, round(ln(value + 1), 6) as log_e, round(log2(value + 1), 6) as log_2, round(log10(value + 1), 6) as log_10, round(exp(value / 100), 6) as exp, round(sqrt(value), 6) as root,
  round(sin(value), 6) as sine, round(atan(value), 6) as arctan, round(tanh(value / 100), 6) as tanh, abs(value - 50) as distance, least(value, 50.0) as lower, greatest(value, 50.0) as upper, floor(value / 7)::bigint as whole from (select *, (event_id % 5)::double as k from events)""")
def scalar_math_suite(spark, d):
    v, k, seven = F.col("value"), (F.col("event_id") % 5).cast("double"), F.lit(7.0)
    return table(spark, d, "events").select(
        "event_id", F.round(F.when(k != 0, m.divide(v, k)), 6).alias("quotient"), m.mod(v, seven).alias("remainder"), F.round(m.ln(v + 1), 6).alias("log_e"), F.round(m.log2(v + 1), 6).alias("log_2"), F.round(m.log10(v + 1), 6).alias("log_10"), F.round(m.exp(v / 100), 6).alias("exp"), F.round(m.sqrt(v), 6).alias("root"),
        F.round(m.sin(v), 6).alias("sine"), F.round(m.arctan(v), 6).alias("arctan"), F.round(m.tanh(v / 100), 6).alias("tanh"), m.absolute(v - 50).alias("distance"), m.minimum(v, F.lit(50.0)).alias("lower"), m.maximum(v, F.lit(50.0)).alias("upper"), m.floordiv(v, seven).alias("whole"),
    )


@query("select user_id, ts, cast(json_extract(props, '$.k') as bigint) as value from events")
def json_props_decode(spark, d):
    return shown(files.from_json(events(spark, d, value="props"), "struct<k: bigint>"), value=F.col("value.k"))


@query(f"select user_id, ts, round(list_reduce(list_prepend(0.0, {ALL}), lambda y, x: greatest(0.0, y + x - 50)), 6) as value from events")
def feedback_cusum(spark, d):
    return shown(f.feedback(lambda x, y: max(0.0, y + x - 50), events(spark, d), "double", 0.0), value=r6())


@query()
def drop_dups_within(spark, d):
    return shown(f.drop_dups_eps(events(spark, d), 10.0))


@query()
def sync_types(spark, d):
    return shown(f.sync(events(spark, d, keys=("user_id", "event_type")), "event_type", ["click", "view"], timedelta(hours=12), run=JAN))


@query(f"select user_id, ts, round(c * 2 + v / 4, 6) as value from ({LATEST}) where c is not null and v is not null")
def formula(spark, d):
    return shown(f.expression("c * two + v / 4", keys=KEY, constants={"two": 2.0}, c=events(spark, d, "click"), v=events(spark, d, "view")), value=r6())


DAILY = "(select o_orderdate::date::timestamp as ts, o_orderpriority as p, round(sum(o_totalprice), 2) as v from orders group by 1, 2)"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _daily(spark, d):
    df = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderpriority").alias("p")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return _of(df, "ts", "v", ("p",))


@query(f"select ts, array_to_string([{', '.join(f'cast(round(coalesce(max(case when p = {chr(39)}{p}{chr(39)} then v end), -0.01) * 100) as bigint)' for p in PRIORITIES)}], ',') as value from {DAILY} group by ts")
def basket_to_array(spark, d):
    s = b.to_array(_daily(spark, d), "p", PRIORITIES)
    return shown(s, value=F.array_join(F.transform("value", lambda v: F.round(F.when(F.isnan(v), -0.01).otherwise(v) * 100).cast("long").cast("string")), ","))


@query(f"select ts, count(*) as n, round(sum(v), 2) as total from {DAILY} group by ts")
def dynamic_collect_daily(spark, d):
    s = b.dynamic_collect(_daily(spark, d), "p")
    return shown(s, n=F.size("value").cast("long"), total=F.round(F.aggregate(F.map_values("value"), F.lit(0.0), lambda x, y: x + y), 2))


@query("select ts, round(max(v), 2) as value from " + DAILY + " group by ts")
def basket_members_now(spark, d):
    s = b.dynamic_collect(_daily(spark, d), "p")
    return shown(s, value=F.round(F.array_max(F.map_values("value")), 2))


@query("select vec_id, (i - 1)::int as idx, round(embedding[i]::double, 6) as value from (select *, unnest(generate_series(1, len(embedding))) as i from embeddings)")
def array_to_basket(spark, d):
    df = table(spark, d, "embeddings")
    s = _of(df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), "ts", F.transform("embedding", lambda v: v.cast("double")), ("vec_id",))
    return b.from_array(s, "idx").df.select("vec_id", "idx", F.round("value", 6).alias("value"))


@query(f"""select vec_id, round(v11, 6) as v11, round(v12, 6) as v12, round(v33, 6) as v33 from (select vec_id, var_samp(embedding[1]::double) over w as v11, covar_samp(embedding[1]::double, embedding[2]::double) over w as v12, var_samp(embedding[3]::double) over w as v33, row_number() over (order by vec_id) n
  from embeddings window w as (order by vec_id rows 9 preceding)) where n >= 10""")
def cov_matrix_embeddings(spark, d):
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("interval '1' second") * F.col("vec_id")
    s = _of(table(spark, d, "embeddings").withColumn("ts", at), "ts", F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, 3))
    c = stats.cov_matrix(s, Rules(10))
    n = F.date_diff("ts", F.lit("2024-01-01")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return c.df.select(n.cast("long").alias("vec_id"), *[F.round(F.col("value")[i][j], 6).alias(f"v{i + 1}{j + 1}") for i, j in ((0, 0), (0, 1), (2, 2))])


@query("select user_id, ts, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'error' then value end) as error from events where event_type in ('click', 'error') group by all")
def wide_frame(spark, d):
    return sinks.wide(KEY, click=events(spark, d, "click"), error=events(spark, d, "error")).drop("cycle")


@query("""select x.user_id, x.ts, x.value from events x join (select user_id, ts as a, (select min(z.ts) from events z where z.user_id = e.user_id and z.event_type = 'error' and z.ts > e.ts) as z from events e where event_type = 'signup') l
  on x.user_id = l.user_id and x.ts >= l.a and (l.z is null or x.ts <= l.z) where x.event_type = 'click'""")
def dynamic_attach(spark, d):
    df = table(spark, d, "events")
    keys = _of(df.where("event_type in ('signup', 'error')"), "ts", F.col("event_type") == "signup", KEY)
    return shown(b.attach(events(spark, d, "click"), b.lifetimes(keys)))


@query(f"select user_id, ts, len(v)::bigint as n, round(list_sum(v), 6) as total from (select user_id, ts, list(value) over ({W} rows 2 preceding) as v from events)")
def history_ticks(spark, d):
    s = a.history(events(spark, d), size=3)
    return shown(s, n=F.size("value").cast("long"), total=F.round(F.aggregate("value", F.lit(0.0), lambda x, e: x + e["value"]), 6))


@query("select o_orderkey, o_custkey, o_orderdate as ts, round(o_totalprice, 2) as price from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-01-01'")
def parquet_subscribe_all(spark, d):
    reader = files.read_parquet(spark, f"{d}/orders.parquet", "o_orderdate", run=RunSpec(datetime(1995, 1, 1), datetime(1996, 1, 1)))
    s = reader.subscribe_all({"o_orderkey": "key", "o_custkey": "cust", "o_totalprice": "price"})
    return s.df.select(F.col("value.key").alias("o_orderkey"), F.col("value.cust").alias("o_custkey"), "ts", F.round("value.price", 2).alias("price"))


@query("select o_orderpriority, o_orderdate as ts, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1, 2")
def burst_mode(spark, d):
    df = table(spark, d, "orders").select("o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("value"))
    s = generators.push(df, ("o_orderpriority",), generators.PushMode.BURST)
    return shown(s, n=F.size("value").cast("long"), keys=F.aggregate("value", F.lit(0).cast("long"), lambda x, y: x + y))


@query("select o_orderpriority, o_orderdate as ts, max(o_orderkey) as value from orders group by 1, 2")
def last_value_mode(spark, d):
    df = table(spark, d, "orders").select("o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("value")).distinct()
    return shown(generators.push(df, ("o_orderpriority",), generators.PushMode.LAST_VALUE))


@query(f"select user_id, ts, round((c - v) / 2, 6) as click, v > 50 as high from ({LATEST}) where c is not null and v is not null")
def frame_algebra(spark, d):
    from ..frame import Frame

    click, view = Frame(x=events(spark, d, "click")), Frame(x=events(spark, d, "view"))
    out = Frame(click=((click - view) / 2).x, high=a.combine_latest(lambda _, v: m.gt(v, F.lit(50.0)), click.x, view.x))
    return out.wide().select("user_id", "ts", F.round("click", 6).alias("click"), "high")


@query("select e.user_id, e.ts, count(o.ts)::bigint as n, round(coalesce(sum(o.value), 0), 6) as total from events e left join events o on e.user_id = o.user_id and o.ts >= e.ts - interval 2 day and o.ts < e.ts - interval 1 day group by e.user_id, e.ts")
def values_between_days(spark, d):
    from ..operators import dynamics as dy

    s = dy.values_between(events(spark, d), timedelta(days=2), timedelta(days=1), end_policy=dy.Range.EXCLUSIVE)
    return shown(s, n=F.size("value").cast("long"), total=F.round(F.aggregate("value", F.lit(0.0), lambda x, e: x + e["value"]), 6))


@query("""select x.user_id, x.ts, count(*) over (partition by x.user_id order by x.ts) as value from events x join (select user_id, min(ts) as a from events where event_type = 'signup' group by user_id) l on x.user_id = l.user_id and x.ts >= l.a where x.event_type = 'click'""")
def dynamic_sub_graph(spark, d):
    from ..operators import dynamics as dy

    firsts = table(spark, d, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("ts")).withColumn("value", F.lit(True))
    return shown(dy.dynamic(_of(firsts, keys=KEY), lambda x: a.count(x), attached={"x": events(spark, d, "click")}))


_EMA = f"(select e.user_id, e.ts, sum(o.value * pow(0.8, e.n - o.n)) s, sum(o.k * pow(0.8, e.n - o.n)) r, sum(o.value * o.k * pow(0.8, e.n - o.n)) p, sum(o.value * o.value * pow(0.8, e.n - o.n)) q, sum(pow(0.8, e.n - o.n)) w, sum(pow(0.64, e.n - o.n)) v from (select *, event_id % 7 as k from {NUMBERED}) e join (select *, event_id % 7 as k from {NUMBERED}) o on e.user_id = o.user_id and o.n <= e.n group by e.user_id, e.ts having count(*) >= 2)"


@query(f"select user_id, ts, {near_sql('(p / w - (s / w) * (r / w)) * w * w / (w * w - v)', 3)} as value from {_EMA}")
def ema_covariance(spark, d):
    y = events(spark, d, value=(F.col("event_id") % 7).cast("double"))
    return shown(ewm.ema_cov(events(spark, d), y, alpha=0.2, min_periods=2), value=near(3))


@query(f"select user_id, ts, {near_sql('sqrt(greatest(0, (q / w - (s / w) * (s / w)) * w * w / (w * w - v)))', 2)} as value from {_EMA}")
def ema_deviation(spark, d):
    return shown(ewm.ema_std(events(spark, d), alpha=0.2, min_periods=2), value=near(2))


@query(f"""select t.ts, t.p, (select x.v from {DAILY} x where x.p = t.p and x.ts <= t.ts order by x.ts desc limit 1) as value
  from (select distinct a.ts, b.p from {DAILY} a, (select distinct p from {DAILY}) b where day(a.ts) = 1) t where value is not null""")
def sample_basket_monthly(spark, d):
    daily = _daily(spark, d)
    firsts = _of(daily.df.where(F.dayofmonth("ts") == 1).select("ts", F.lit(True).alias("value")).distinct())
    return shown(b.sample_basket(firsts, daily, "p", PRIORITIES))


@query(f"select ts, count(*) as n, round(sum(v), 2) as total from {DAILY} group by ts")
def collect_daily(spark, d):
    s = b.collect(_daily(spark, d), "p", datetime(1990, 1, 1))
    return shown(s, n=F.size("value").cast("long"), total=F.round(F.aggregate("value", F.lit(0.0), lambda x, y: x + y), 2))


@query(f"""select ts, (row_number() over (partition by ts order by before, p) - 1)::int as cycle, v as value
  from (select *, coalesce(lag(ts) over (partition by p order by ts), timestamp '1990-01-01') as before from {DAILY})""")
def flatten_daily(spark, d):
    return b.flatten(_daily(spark, d), "p", datetime(1990, 1, 1)).df.select("ts", F.col("cycle").cast("int").alias("cycle"), "value")


@query("select user_id, ts, cast(json_extract(props, '$.k') as double) as value from events where json_extract(props, '$.k') is not null")
def struct_field_as_double(spark, d):
    return shown(a.cast_int_to_float(a.struct_field(files.from_json(events(spark, d, value="props"), "struct<k: bigint>"), "k")))


@query("select o_custkey, o_orderdate as ts, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey) as n, (row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) - 1)::int as cycle from orders")
def numbered_ticks(spark, d):
    s = Series.of(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ("o_custkey",), ("o_orderkey",))
    return a.count(s).df.select("o_custkey", "ts", F.col("value").alias("n"), "cycle")


@query("""select event_id, round(value + k, 6) as added, round(value - k, 6) as less, round(value * k, 6) as product, round(pow(value / 10, 2), 6) as square, round(pow(2, k), 6) as two_to, -value as negative, round(cos(value), 6) as cosine, round(tan(k), 6) as tangent,
  round(asin(k / 4), 6) as arcsine, round(acos(k / 4), 6) as arccosine, round(sinh(k), 6) as sineh, round(cosh(k), 6) as cosineh, round(asinh(value), 6) as arcsineh, round(acosh(k + 1), 6) as arccosineh, round(atanh(k / 5), 6) as arctanh,
  value = k as same, value <> k as other, value > k as above, value < k as below, value >= k as least, value <= k as most, not (value > k) as unsaid, value > 1 and k > 1 as both, value > 99 or k > 3 as either from (select *, (event_id % 5)::double as k from events)""")
def scalar_functions(spark, d):
    v, k = F.col("value"), (F.col("event_id") % 5).cast("double")
    r = lambda c: F.round(c, 6)
    out = {
        "added": r(m.add(v, k)), "less": r(m.sub(v, k)), "product": r(m.multiply(v, k)), "square": r(m.power(v / 10, F.lit(2.0))), "two_to": r(m.exp2(k)), "negative": m.neg(m.pos(v)), "cosine": r(m.cos(v)), "tangent": r(m.tan(k)), "arcsine": r(m.arcsin(k / 4)), "arccosine": r(m.arccos(k / 4)),
        "sineh": r(m.sinh(k)), "cosineh": r(m.cosh(k)), "arcsineh": r(m.arcsinh(v)), "arccosineh": r(m.arccosh(k + 1)), "arctanh": r(m.arctanh(k / 5)), "same": m.eq(v, k), "other": m.ne(v, k), "above": m.gt(v, k), "below": m.lt(v, k), "least": m.ge(v, k), "most": m.le(v, k),
        "unsaid": m.not_(m.gt(v, k)), "both": m.and_(v > 1, k > 1), "either": m.or_(v > 99, k > 3),
    }
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in out.items()])


@query(f"""select ts, {near_sql("coalesce(skewness(v), 'nan'::double)", 4)} as skew, {near_sql("coalesce(kurtosis(v), 'nan'::double)", 4)} as kurt, {near_sql('median(v)', 2)} as middle
  from (select t.ts, x.v from (select a.ts, b.p from (select distinct ts from {DAILY}) a, (select distinct p from {DAILY}) b) t asof join {DAILY} x on t.p = x.p and t.ts >= x.ts) group by ts""")
def member_shape_daily(spark, d):
    daily = _daily(spark, d)
    parts = {n: b.reduce_members(daily, "p", PRIORITIES, how) for n, how in (("skew", "skew"), ("kurt", "kurt"), ("middle", "median"))}
    return sinks.wide((), **parts).select("ts", near(4, "skew").alias("skew"), near(4, "kurt").alias("kurt"), near(2, "middle").alias("middle"))


@query("""select vec_id, 64 as n, round(var_samp(s) over w, 6) as total, round(q, 6) as trace from (select vec_id, s, row_number() over (order by vec_id) as nth, (select sum(var) from (select var_samp(y.embedding[i]::double) as var from embeddings y, unnest(generate_series(1, 64)) as g(i) where y.vec_id between x.vec_id - 9 and x.vec_id group by i)) as q
  from (select vec_id, list_sum(embedding::double[]) as s from embeddings) x) window w as (order by vec_id rows 9 preceding) qualify nth >= 10""")
def cov_matrix_whole(spark, d):
    """All 64 x 64 covariances: their sum is the variance of the vectors' sums,
    their diagonal the elements' variances."""
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("interval '1' second") * F.col("vec_id")
    s = _of(table(spark, d, "embeddings").withColumn("ts", at), "ts", F.transform("embedding", lambda v: v.cast("double")))
    c = stats.cov_matrix(s, Rules(10))
    n = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y)
    diagonal = F.transform("value", lambda r, i: r[i])
    return c.df.select(n.alias("vec_id"), F.size("value").alias("n"), F.round(add(F.transform("value", add)), 6).alias("total"), F.round(add(diagonal), 6).alias("trace"))


@query("""select user_id, event_id as at, (user_id % 4)::int as place, max(ts) over (partition by user_id % 4 order by event_id % 97, event_id) as ts, cast(json_extract(props, '$.k') as bigint) as k from events""")
def kafka_messages(spark, d):
    from .. import streaming

    nth = F.row_number().over(Window.partitionBy(F.col("user_id") % 4).orderBy(F.col("event_id") % 97, "event_id"))
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct(F.from_json("props", "k bigint").alias("body"), F.col("event_id").alias("id"))).cast("binary").alias("value"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % 4).cast("int").alias("partition"), nth.cast("long").alias("offset"), F.lit("events").alias("topic"))
    got = streaming.decode_messages(rows, "body struct<k: bigint>, id bigint", {"body": "body", "id": "at"}, {"partition": "place"}, adjust_out_of_order_time=True)
    return got.select(F.col("key").cast("long").alias("user_id"), "value.at", "value.place", "ts", "value.body.k")


@query(f"select user_id, ts, case when n % 2 = 0 then n end as even, case when value = top then value end as top from (select *, row_number() over ({W}) as n, max(value) over ({W}) as top from events) where n % 2 = 0 or value = top")
def node_outputs(spark, d):
    @f.node({"even": "bigint", "top": "double"}, n=0, top=float("-inf"))
    def spread(c: f.Context) -> None:
        c.state["n"] += 1
        if c.state["n"] % 2 == 0:
            c.emit_to("even", c.state["n"])
        if c.values["x"] >= c.state["top"]:
            c.state["top"] = c.values["x"]
            c.emit_to("top", c.state["top"])

    return sinks.wide(KEY, **spread(KEY, x=events(spark, d))).drop("cycle")


@query("select l_shipdate as ts, count(*) as n, ((count(*) + 6) // 7)::int as batches, least(7, count(*)) as largest, round(sum(l_quantity), 2) as total from lineitem group by l_shipdate")
def batches_by_ship_date(spark, d):
    rows = table(spark, d, "lineitem").select("l_shipdate", "l_quantity")
    s = sinks.to_record_batches(files.record_batches(rows, "l_shipdate"), {"l_quantity": "quantity"}, 7)
    flat = F.flatten("value")
    return shown(s, n=F.size(flat).cast("long"), batches=F.size("value"), largest=F.array_max(F.transform("value", F.size)).cast("long"), total=F.round(F.aggregate(flat, F.lit(0.0), lambda x, e: x + e["quantity"]), 2)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select user_id, ts, max(case when event_type = 'click' then value end) as click, max(case when event_type = 'error' then value end) as error from events where event_type in ('click', 'error') group by all")
def frame_of_structs(spark, d):
    from ..frame import Frame

    structs = Frame(**{"web click": events(spark, d, "click"), "web error": events(spark, d, "error")}).collect()
    return Frame.flatten(structs).wide().select(*KEY, "ts", F.col("web click").alias("click"), F.col("web error").alias("error"))


@query(f"select user_id, ts, {near_sql('value * value / (1 + abs(value))', 6)} as value from events")
def formula_function(spark, d):
    return shown(f.expression("softened(x) * x", functions={"softened": (("v",), "v / (1 + abs(v))")}, keys=KEY, x=events(spark, d)), value=near(6))
