"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: White space of the word definition used by every operator here.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch at most.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by writing df to the folder that spark.checkpoint.dir
    names, which all executors share. Where none is configured, a local folder
    is set on a single machine, and a cluster is refused."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewheel-"))
    return df.checkpoint()


def bound_batches(spark: SparkSession) -> None:
    """Limits the rows of an Arrow batch of the session, so that a Python
    worker holds few long texts at a time; a lower limit stays. The limit is
    read when a plan is run, so it can't be put back here. Also brings this
    package to the workers."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list | pa.Array]], schema: str, bound: tuple[str, int] | None = None) -> DataFrame:
    """Applies fn to each Arrow batch as a dict of Python lists; fn returns
    the columns of schema. bound: a column and the bytes of it that fn gets at
    a time, see slices."""
    bound_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in (slices(b, *bound) if bound else (b,))):
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """All rows of b in order, in runs whose strings in a column have at most
    so many bytes together; a longer one stands alone, null has none."""
    start = held = 0
    for k, n in enumerate(pc.binary_length(b.column(b.schema.names.index(column))).to_pylist()):
        if k > start and held + (n or 0) > most:
            yield b.slice(start, k - start)
            start, held = k, 0
        held += n or 0
    yield b.slice(start)


def map_column(df: DataFrame, column: str, fn: Callable[[list], list]) -> DataFrame:
    """df with a column replaced by what fn makes of its values; all other
    columns pass through."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.names.index(column)
            yield b.set_column(k, b.schema.field(k), pa.array(fn(b.column(k).to_pylist()), b.schema.field(k).type))

    return df.mapInArrow(run, df.schema)


def keep_where(df: DataFrame, column: str, fn: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of df for which fn, given a column's values, says true."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(fn(b.column(b.schema.names.index(column)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), 64-bit integers, as (node, root)
    with root the least node of the component; nodes without an edge to
    another node are not returned.

    Alternating large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): each step is one shuffle whose
    rows stay within twice the edges, hub nodes are pre-aggregated to their
    least neighbour, and O(log n) rounds are made. Each round is checkpointed.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        """Links the neighbours of each node to the least of them and it."""
        if small:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = near.join(least, "u")
        if small:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        else:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    e = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        e = checkpoint(star(star(e, False), True))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = now
