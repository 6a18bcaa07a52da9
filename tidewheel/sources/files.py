"""Readers of files, tables and databases.

A reader is one scan; its subscriptions are filters and projections of it, so
Spark prunes columns and pushes the time and symbol conditions to the file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..series import RunSpec, Series, interval
from .generators import PushMode, push


def _value(field_map: str | dict[str, str]) -> Column:
    """A column's value, or a struct of renamed columns."""
    return F.col(field_map) if isinstance(field_map, str) else F.struct(*[F.col(c).alias(n) for c, n in field_map.items()])


@dataclass(frozen=True)
class Reader:
    """Rows with a time column, and perhaps a symbol column, as series."""

    df: DataFrame
    time: str
    symbol: str | None = None
    run: RunSpec | None = None
    shift: timedelta = timedelta(0)
    modes: dict[str, PushMode] = field(default_factory=dict, compare=False)

    def _rows(self) -> DataFrame:
        t = F.col(self.time).cast("timestamp_ntz")
        df = self.df
        if self.run:
            df = df.where((t >= F.lit(self.run.start - self.shift).cast("timestamp_ntz")) & (t <= F.lit(self.run.end - self.shift).cast("timestamp_ntz")))
        ok = F.when(t.isNotNull(), t + interval(self.shift) if self.shift else t).otherwise(F.raise_error(F.lit("a time is null")))
        return df.withColumn("_ts", ok)

    def _mode(self, name: str, mode: PushMode) -> PushMode:
        """One push mode for a reader; all-rows and by-symbol subscriptions
        don't mix where each tick gets its own cycle."""
        others = {m for n, m in self.modes.items() if n != name}
        if others - {mode} or (mode is PushMode.NON_COLLAPSING and others and len({*self.modes, name}) > 1):
            raise ValueError("subscriptions of one reader use one push mode, and either symbols or all rows")
        self.modes[name] = mode
        return mode

    def _series(self, df: DataFrame, value: Column, keys: tuple[str, ...], mode: PushMode) -> Series:
        rows = df.select(*keys, F.col("_ts").alias("ts"), F.monotonically_increasing_id().alias("seq"), value.alias("value"))
        return push(rows, keys, mode)

    def subscribe(self, symbol: object, field_map: str | dict[str, str], mode: PushMode = PushMode.NON_COLLAPSING) -> Series:
        return self._series(self._rows().where(F.col(self.symbol) == symbol), _value(field_map), (), self._mode("symbol", mode))

    def subscribe_all(self, field_map: str | dict[str, str], mode: PushMode = PushMode.NON_COLLAPSING) -> Series:
        return self._series(self._rows(), _value(field_map), (), self._mode("all", mode))

    def subscribe_basket(self, field_map: str | dict[str, str], mode: PushMode = PushMode.NON_COLLAPSING) -> Series:
        """All symbols as one basket keyed by the symbol column."""
        s = F.col(self.symbol)
        checked = F.when(s.isNotNull(), s).otherwise(F.raise_error(F.lit("a symbol is null")))
        return self._series(self._rows().withColumn(self.symbol, checked), _value(field_map), (self.symbol,), mode)

    def shifted(self, by: timedelta) -> Reader:
        return replace(self, shift=by, modes={})


def paths_of(files: str | list[str] | Callable[[datetime, datetime], list[str]], run: RunSpec | None) -> list[str]:
    got = files(run.start, run.end) if callable(files) else files
    return [got] if isinstance(got, str) else list(got)


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that Spark's file system knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    return [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]


def read_parquet(spark: SparkSession, files: str | list[str] | Callable[[datetime, datetime], list[str]], time: str, symbol: str | None = None, run: RunSpec | None = None, start: datetime | None = None, end: datetime | None = None, time_shift: timedelta = timedelta(0), allow_missing_columns: bool = False, allow_missing_files: bool = False, allow_overlapping_periods: bool = False, tz: str = "UTC") -> Reader:
    """Parquet files as a reader. Files may differ in schema where
    allow_missing_columns; with allow_overlapping_periods, each later file
    counts from after the last time of those before it."""
    if tz != "UTC":
        raise ValueError("times are in UTC")
    paths = paths_of(files, run)
    paths = _existing(spark, paths) if allow_missing_files else paths
    if allow_overlapping_periods and len(paths) > 1:
        parts, last = [], None
        for p in paths:
            part = spark.read.parquet(p)
            parts.append(part if last is None else part.where(F.col(time) > F.lit(last)))
            top = part.agg(F.max(time)).first()[0]
            last = top if last is None or top is not None and top > last else last
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part, allowMissingColumns=allow_missing_columns)
    else:
        df = spark.read.option("mergeSchema", str(allow_missing_columns).lower()).parquet(*paths)
    if run and (start or end):
        run = RunSpec(max(run.start, start or run.start), min(run.end, end or run.end))
    return Reader(df, time, symbol, run, time_shift)


def read_split_columns(spark: SparkSession, folder: str, columns: list[str], index: str = "row") -> DataFrame:
    """A table whose columns lie in a file each, `<folder>/<column>.parquet`,
    with a row number in each."""
    parts = [spark.read.parquet(f"{folder}/{c}.parquet") for c in columns]
    df = parts[0]
    for p in parts[1:]:
        df = df.join(p, index)
    return df


def read_dict_basket(df: DataFrame, value: str, symbol: str, count: str, time: str, order: list[str]) -> Series:
    """A basket stored beside a table: column `count` says how many of the
    next rows of the columns `symbol` and `value` belong to a row."""
    by = Window.orderBy(*order)
    nth = df.select(*order, F.row_number().over(by).alias("_n"), time, count, symbol, value)
    heads = nth.where(F.col(count) > 0).select(F.col(time).cast("timestamp_ntz").alias("ts"), F.col(count).alias("_c"), F.sum(count).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"))
    each = heads.select("ts", F.explode(F.sequence(F.col("_to") - F.col("_c") + 1, F.col("_to"))).alias("_n"))
    rows = each.join(nth.select("_n", F.col(symbol).alias("symbol"), F.col(value).alias("value")), "_n")
    return Series(rows.select("symbol", "ts", F.lit(0).alias("cycle"), "value"), ("symbol",))


def read_csv(spark: SparkSession, path: str, schema: str | StructType, time: str, fmt: str = "yyyyMMdd HH:mm:ss", sep: str = ",", symbol: str | None = None, run: RunSpec | None = None, zone: str | None = None) -> Reader:
    """A CSV file with a header; the time column is text in the given format,
    in a zone, or UTC."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=True)
    return Reader(df.withColumn(time, time_converter(F.col(time), fmt, zone)), time, symbol, run)


def time_converter(text: Column, fmt: str, zone: str | None = None) -> Column:
    t = F.to_timestamp_ntz(text, F.lit(fmt))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), t) if zone else t


def read_arrow(spark: SparkSession, tables: object, time: str, symbol: str | None = None, run: RunSpec | None = None) -> Reader:
    """In-memory Arrow tables, or the bytes or path of an IPC stream."""
    import pyarrow as pa

    if isinstance(tables, (bytes, str)):
        source = pa.ipc.open_stream(pa.BufferReader(tables) if isinstance(tables, bytes) else pa.OSFile(tables))
        tables = source.read_all()
    table = pa.concat_tables(tables, promote_options="default") if isinstance(tables, list) else tables
    return Reader(spark.createDataFrame(table), time, symbol, run)


def read_database(spark: SparkSession, options: dict[str, str], time: str, table: str | None = None, query: str | None = None, symbol: str | None = None, run: RunSpec | None = None, constraint: str | None = None) -> Reader:
    """A table or query over JDBC; conditions on time and symbol are pushed to
    the database."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    df = spark.read.format("jdbc").options(**options).option(*(("dbtable", table) if table else ("query", query))).load()
    return Reader(df.where(constraint) if constraint else df, time, symbol, run)


def timestamp_of(date: Column, time_of_day: Column) -> Column:
    """A time from a date and a time of day in nanoseconds."""
    return date.cast("timestamp_ntz") + F.expr("interval '1' microsecond") * (time_of_day / 1000).cast("long")


def record_batches(df: DataFrame, ts: str = "ts", columns: list[str] | None = None) -> Series:
    """Rows of equal time as one list of structs a tick, in time order."""
    cols = columns or [c for c in df.columns if c != ts]
    rows = df.groupBy(F.col(ts).cast("timestamp_ntz").alias("ts")).agg(F.lit(0).alias("cycle"), F.collect_list(F.struct(*cols)).alias("value"))
    return Series(rows)


def from_json(x: Series, schema: str, epoch: dict[str, str] | None = None) -> Series:
    """Struct values from JSON text; epoch names fields that hold times as
    integers, by unit (ns, us, ms, s)."""
    return x.with_value(json_struct(F.col("value"), schema, epoch))


def json_struct(text: Column, schema: str, epoch: dict[str, str] | None = None) -> Column:
    v = F.from_json(text, schema)
    scale = {"ns": 1e-3, "us": 1.0, "ms": 1e3, "s": 1e6}
    for name, unit in (epoch or {}).items():
        t = F.lit("1970-01-01").cast("timestamp_ntz") + F.expr("interval '1' microsecond") * (v[name] * scale[unit]).cast("long")
        v = v.withField(name, t)
    return v


def to_json(x: Series) -> Series:
    return x.with_value(F.to_json("value"))


def from_pandas(spark: SparkSession, pdf, value: str, time: str = "ts", keys: tuple[str, ...] = (), drop_na: bool = True) -> Series:
    df = spark.createDataFrame(pdf)
    s = Series.of(df, time, value, keys)
    return drop_nan(s) if drop_na and dict(s.df.dtypes)["value"] == "double" else s


def drop_nan(s: Series) -> Series:
    return s.where(F.col("value").isNotNull() & ~F.isnan("value"))
