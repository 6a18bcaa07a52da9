"""Writers of series."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..series import RunSpec, Series, bound, position, spine


def last_ticks(x: Series, n: int) -> list[tuple]:
    """[(time, value)] of the last n ticks of a series without keys."""
    rows = x.df.orderBy(F.desc("ts"), F.desc("cycle")).limit(n).collect()
    return [(r["ts"], r["value"]) for r in reversed(rows)]


def wide(keys: tuple[str, ...] = (), **columns: Series) -> DataFrame:
    """One row for each cycle, a column for each series; null where it does
    not tick."""
    rows = spine(keys, **columns)
    return rows.select(*keys, "ts", "cycle", *[F.when(F.col(f"{n}_ticked"), F.col(n)).alias(n) for n in columns])


def write_parquet(path: str, time: str = "ts", keys: tuple[str, ...] = (), rotate: Column | None = None, mode: str = "overwrite", column_metadata: dict[str, dict] | None = None, file_visitor: Callable[[str], None] | None = None, **columns: Series) -> None:
    """A row for each cycle, as Parquet; rotate: a folder for each value of an
    expression of the time column, such as its date. column_metadata goes into
    the files' schema; file_visitor gets the path of every file written."""
    df = wide(keys, **columns).withColumnRenamed("ts", time).drop("cycle")
    meta = column_metadata or {}
    df = df.select(*[F.col(c).alias(c, metadata=meta[c]) if c in meta else c for c in df.columns])
    before = set(_files(df.sparkSession, path)) if file_visitor and mode == "append" else set()
    if rotate is not None:
        df.withColumn("bucket", rotate).write.partitionBy("bucket").mode(mode).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    for file in sorted(set(_files(df.sparkSession, path)) - before) if file_visitor else ():
        file_visitor(file)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files below a path that Spark's file system knows."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(root, True) if fs.exists(root) else None, []
    while found is not None and found.hasNext():
        out.append(found.next().getPath().toString())
    return [f for f in out if f.endswith(".parquet")]


def to_record_batches(x: Series, field_map: dict[str, str] | None = None, max_batch_size: int = 65536) -> Series:
    """Lists of structs as lists of batches of at most max_batch_size rows (0:
    one batch); field_map says which fields, under which names. An empty list
    has no batch."""
    v = F.col("value")
    if field_map is not None:
        v = F.transform(v, lambda e: F.struct(*[e[f].alias(n) for f, n in field_map.items()]))
    step = F.lit(max_batch_size) if max_batch_size else F.greatest(F.size(v), F.lit(1))
    batches = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), step), lambda at: F.slice(v, at, step))
    return x.with_value(F.filter(batches, lambda b: F.size(b) > 0))


def write_record_batches(path: str, x: Series, max_file_rows: int = 0, mode: str = "overwrite", **options: str) -> None:
    """The rows of lists of batches, in time order, as Parquet. Tasks write
    ranges of time; max_file_rows bounds a file."""
    ordered = x.df.orderBy("ts", "cycle").select(F.explode(F.flatten("value")).alias("_row"))
    ordered.select("_row.*").write.mode(mode).options(**options).option("maxRecordsPerFile", max_file_rows).parquet(path)


def write_split_columns(folder: str, df: DataFrame, order: list[str], columns: list[str], index: str = "row") -> None:
    """A Parquet file set for each column, each with a row number."""
    rows = df.withColumn(index, F.row_number().over(Window.orderBy(*order)))
    for c in columns:
        rows.select(index, c).write.mode("overwrite").parquet(f"{folder}/{c}.parquet")


def to_pandas(run: RunSpec | None = None, **columns: Series) -> pd.DataFrame:
    """The frame of wide(), by time; small results only."""
    df = wide((), **columns)
    if run:
        df = df.where(F.col("ts").between(F.lit(run.start).cast("timestamp_ntz"), F.lit(run.end).cast("timestamp_ntz")))
    return df.orderBy("ts", "cycle").drop("cycle").toPandas().set_index("ts")


def frames(trigger: Series, window: int | timedelta, wait_all_valid: bool = True, **columns: Series) -> Series:
    """At each tick of trigger, once all columns have ticked (unless
    wait_all_valid is false), the trailing frame: for each column a list of
    its last ticks (ts, value), by number or by time."""
    rows = spine(trigger.keys, _t=trigger, **columns)
    past = Window.partitionBy(*trigger.keys).orderBy("ts", "cycle").rowsBetween(Window.unboundedPreceding, 0)
    parts, ok = [], F.col("_t_ticked")
    for n in columns:
        tick = F.when(F.col(f"{n}_ticked"), F.struct("ts", F.col(n).alias("value")))
        if isinstance(window, int):  # rows up to the next tick have the same number, and no value but the first
            rows = rows.withColumn(f"_n_{n}", F.sum(F.col(f"{n}_ticked").cast("int")).over(past))
            frame = Window.partitionBy(*trigger.keys).orderBy(f"_n_{n}").rangeBetween(-(window - 1), 0)
        else:
            frame = Window.partitionBy(*trigger.keys).orderBy(position()).rangeBetween(bound(window, False, True), 0)
        parts.append(F.collect_list(tick).over(frame).alias(n))
        ok = ok & F.col(f"{n}_valid") if wait_all_valid else ok
    out = rows.withColumn("value", F.struct(*parts)).where(ok)
    return Series(out.select(*trigger.keys, "ts", "cycle", "value"), trigger.keys)


def flatten_array(x: Series) -> Series:
    """Matrices (lists of equally long lists) as flat values with their shape."""
    return x.with_value(F.struct(F.flatten("value").alias("data"), F.array(F.size("value"), F.size(F.get("value", 0))).alias("shape")))


def reshape_array(x: Series) -> Series:
    """Matrices from flat values with their shape."""
    n = F.col("value.shape")[1]
    rows = F.transform(F.sequence(F.lit(0), F.col("value.shape")[0] - 1), lambda i: F.slice(F.col("value.data"), i * n + 1, n))
    return x.with_value(rows)


def print_ticks(tag: str, x: Series, n: int | None = None, out: Callable[[str], None] = print) -> None:
    """All ticks, or the first n, as "time tag:value" lines; a partition is
    on the driver at a time."""
    for r in (x.sorted() if n is None else x.sorted().limit(n)).toLocalIterator():
        out(f"{r['ts']} {tag}:{r['value']}")
