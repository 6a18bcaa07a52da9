"""Series as streams.

History is read in batch and live data with readStream; both run the same step
functions. State lives in Spark's state store and is recovered from the
query's checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.folds import Context, Step
from ..shipping import ship
from ..sources.files import json_struct


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """New files of a folder as a stream of rows."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def timer(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """(ts, cycle, value) at the wall clock."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("cycle"), F.col("value"))


def read_kafka(spark: SparkSession, servers: str, topic: str, replay: str = "latest", start: int | None = None, **options: str) -> DataFrame:
    """(key, value, ts, partition, offset, topic) of a topic, from its start,
    its end, or a time in milliseconds."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    reader = reader.option("startingTimestamp", str(start)) if start is not None else reader.option("startingOffsets", replay)
    return reader.load().select(F.col("key").cast("string"), "value", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "partition", "offset", "topic")


def decode_messages(
    df: DataFrame, schema: str | None = None, field_map: str | dict[str, str] | None = None, meta_field_map: dict[str, str] | None = None, key: str | None = None, epoch: dict[str, str] | None = None,
    time_field: str | None = None, start: Any = None, include_before_start: bool = True, live_from: Any = None, adjust_out_of_order_time: bool = False,
) -> DataFrame:
    """(key, ts, cycle, value) from rows of read_kafka(), batch or stream.

    Messages are JSON objects of the given schema, or without one text.
    field_map says which fields of a message, under which names, make the
    value's struct; a string names the one field that is the value.
    meta_field_map adds partition, offset, timestamp, key or live (not before
    live_from) to the struct. key picks the messages of one key. time_field
    names the field of the struct that holds a tick's time, in place of the
    message's. Ticks before start count as at the start, or not at all. Ticks
    older than one before them in their partition are moved to its time if
    adjust_out_of_order_time; that is for batches, as fold() does it in
    streams. Messages that are no JSON have null fields."""
    meta = meta_field_map or {}
    if unknown := set(meta) - {"partition", "offset", "timestamp", "key", "live"}:
        raise ValueError(f"no metadata of messages: {sorted(unknown)}")
    if time_field is not None and meta.get("timestamp") == time_field:
        raise ValueError("a field holds either the tick's time or the message's")
    if meta and (schema is None or isinstance(field_map, str)):
        raise ValueError("metadata needs values that are structs")
    rows = df if key is None else df.where(F.col("key") == key)
    text = F.col("value").cast("string")
    message = text if schema is None else json_struct(text, schema, epoch)
    if isinstance(field_map, str):
        value = message[field_map]
    elif schema is not None:
        names = field_map or {n: n for n in StructType.fromDDL(schema).fieldNames()}
        live = F.lit(live_from is None) if live_from is None else F.col("ts") >= F.lit(live_from).cast("timestamp_ntz")
        source = {"timestamp": F.col("ts"), "live": live} | {n: F.col(n) for n in ("partition", "offset", "key")}
        value = F.struct(*[message[f].alias(n) for f, n in names.items()], *[source[f].alias(n) for f, n in meta.items()])
    else:
        value = message
    rows = rows.withColumn("_value", value)
    if time_field is not None:
        rows = rows.withColumn("ts", F.col("_value")[time_field].cast("timestamp_ntz"))
    if adjust_out_of_order_time:
        if df.isStreaming:
            raise ValueError("fold() moves the late ticks of a stream")
        rows = rows.withColumn("ts", F.max("ts").over(Window.partitionBy("topic", "partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)))
    if start is not None:
        rows = clamp(rows, start) if include_before_start else rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return rows.select("key", "ts", F.lit(0).alias("cycle"), F.col("_value").alias("value"))


def encode_messages(value: Column, field_map: str | dict[str, str] | None = None) -> Column:
    """A message's bytes: a struct as a JSON object, with its fields under the
    names of field_map; with a string, an object of the value under that name."""
    if isinstance(field_map, str):
        value = F.struct(value.alias(field_map))
    elif field_map is not None:
        value = F.struct(*[value[f].alias(n) for f, n in field_map.items()])
    return F.to_json(value).cast("binary")


def write_kafka(df: DataFrame, servers: str, topic: str, key: Column, value: Column, checkpoint: str) -> StreamingQuery:
    out = df.select(key.cast("string").alias("key"), value.alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def clamp(df: DataFrame, start: Any) -> DataFrame:
    """Ticks before the start count as ticks at the start."""
    return df.withColumn("ts", F.greatest("ts", F.lit(start).cast("timestamp_ntz")))


def tumbling(df: DataFrame, keys: tuple[str, ...], every: str, late: str, **aggs: Column) -> DataFrame:
    """Aggregates over windows that follow each other; rows that come more
    than `late` behind the newest are dropped."""
    at = df.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    out = at.groupBy(*keys, F.window("_at", every).alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *aggs)


def sliding(df: DataFrame, keys: tuple[str, ...], size: str, every: str, late: str, **aggs: Column) -> DataFrame:
    at = df.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    out = at.groupBy(*keys, F.window("_at", size, every).alias("_w")).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *aggs)


def fold(df: DataFrame, keys: tuple[str, ...], step: Step, kind: str, init: dict[str, Any] | None = None, name: str = "name", idle: timedelta | None = None, late: str | None = None) -> DataFrame:
    """tidewheel.operators.fold over a stream of (keys, ts, cycle, name,
    value): `name` says which input ticks. Ticks of one batch are taken in
    time order; those older than a key's last one count as at that time.
    Alarms come before a later tick of their key, and, with `late` (how far
    ticks may come behind the newest of all keys), once no earlier tick can
    come any more. Without it, state may be dropped after a key has been idle,
    by wall clock."""
    if late is not None and idle is not None:
        raise ValueError("state is kept by event time (late) or by wall clock (idle)")
    ship(df.sparkSession)
    types = dict(df.dtypes)
    out = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "ts timestamp_ntz", "cycle int", f"value {kind}"])

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut and late is None:
            state.remove()
            return
        c: Context = pickle.loads(state.get[0]) if state.exists else Context(state={k: v() if callable(v) else v for k, v in (init or {}).items()})
        if state.hasTimedOut:
            c.run_alarms(step, None, pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"))
        else:
            rows = pd.concat(list(parts)).sort_values(["ts", "cycle"], kind="stable")
            for (ts, cycle), group in rows.groupby(["ts", "cycle"], sort=True):
                if c.now is not None and (ts, cycle) <= (c.now, c.cycle):
                    ts, cycle = c.now, c.cycle + 1
                c.advance(step, ts, int(cycle), dict(zip(group[name], group["value"], strict=True)))
        got, c.out = c.out, []
        state.update((pickle.dumps(c),))
        if late is not None and (a := c.next_alarm()):
            # A timeout comes after its millisecond has passed.
            state.setTimeoutTimestamp(max(int(pd.Timestamp(a[0]).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif idle is not None:
            state.setTimeoutDuration(int(idle.total_seconds() * 1000))
        if got:
            made = pd.DataFrame({"ts": [g[0] for g in got], "cycle": [g[1] for g in got], "value": [g[2] for g in got]})
            for k, (n, v) in enumerate(zip(keys, key, strict=True)):
                made.insert(k, n, v)
            yield made.astype({"cycle": "int32"})

    timeout = GroupStateTimeout.EventTimeTimeout if late is not None else GroupStateTimeout.ProcessingTimeTimeout if idle is not None else GroupStateTimeout.NoTimeout
    dealt = df if late is None else df.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    return dealt.groupBy(*keys).applyInPandasWithState(one, out, "state binary", "append", timeout)


def catch_up(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, then stops: the replay of
    history before going live from the same checkpoint."""
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def go_live(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Status(StreamingQueryListener):
    """Collects (level, query, message) of a session's streams: progress is
    info, an ended query with an error is an error."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, str, str]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.seen.append(("info", str(event.id), "started"))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.seen.append(("info", str(event.progress.id), f"batch {event.progress.batchId}: {event.progress.numInputRows} rows"))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.seen.append(("error" if event.exception else "info", str(event.id), event.exception or "ended"))
