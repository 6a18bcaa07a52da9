"""User-written sources and sinks, on Spark's Python data sources."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..series import RunSpec, Series


class _Part(InputPartition):
    pass


def pull(spark: SparkSession, run: RunSpec, kind: str, generate: Callable[[RunSpec, int], Iterator[tuple]], parts: int = 1) -> Series:
    """A source that yields (ts, value) in time order for each of `parts`
    parts, read in parallel."""

    class Pull(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidewheel_pull"

        def schema(self) -> str:
            return f"ts timestamp_ntz, cycle int, value {kind}"

        def reader(self, schema) -> DataSourceReader:
            return PullReader()

    class PullReader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Part(k) for k in range(parts)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            last, cycle = None, 0
            for ts, value in generate(run, partition.value):
                if last is not None and ts < last:
                    raise ValueError("a source goes back in time")
                cycle = cycle + 1 if ts == last else 0
                last = ts
                if run.start <= ts <= run.end:
                    yield ts, cycle, value

    spark.dataSource.register(Pull)
    return Series(spark.read.format("tidewheel_pull").load())


def push_folder(spark: SparkSession, folder: str, kind: str) -> tuple[Callable[[list[tuple]], None], DataFrame]:
    """A push source for outside events: (push, stream). push writes a batch
    of (ISO time, value) to a folder that the stream watches; any process that
    can write there may push."""
    Path(folder).mkdir(parents=True, exist_ok=True)

    def push(rows: list[tuple]) -> None:
        n = len(list(Path(folder).glob("*.json")))
        text = "\n".join(json.dumps({"ts": t, "cycle": 0, "value": v}) for t, v in rows)
        hidden = Path(folder, f"_{n:09d}")
        hidden.write_text(text)
        hidden.rename(Path(folder, f"{n:09d}.json"))

    return push, spark.readStream.schema(f"ts timestamp_ntz, cycle int, value {kind}").json(folder)


def stream_of(spark: SparkSession, name: str, kind: str, read: Callable[[dict], tuple[list[tuple], dict]], start: dict) -> DataFrame:
    """A stream from a function of an offset that gives (rows, next offset):
    the way to sockets, queues and web services. Rows are (ts, cycle, value);
    they are kept by offset for replay."""

    class Stream(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"ts timestamp_ntz, cycle int, value {kind}"

        def simpleStreamReader(self, schema):  # noqa: N802
            return Reader()

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802
            return start

        def read(self, offset: dict):
            rows, after = read(offset)
            return iter(rows), after

        def readBetweenOffsets(self, offset: dict, end: dict):  # noqa: N802
            rows: list[tuple] = []
            while offset != end:
                more, offset = read(offset)
                rows += more
            return iter(rows)

    spark.dataSource.register(Stream)
    return spark.readStream.format(name).load()


def log_ticks(x: Series, tag: str, level: int = logging.INFO, logger: logging.Logger | None = None, n: int | None = None) -> None:
    """All ticks, or the first n, to a logger."""
    out = logger or logging.getLogger("tidewheel")
    for r in (x.sorted() if n is None else x.sorted().limit(n)).toLocalIterator():
        out.log(level, "%s %s:%s", r["ts"], tag, r["value"])
