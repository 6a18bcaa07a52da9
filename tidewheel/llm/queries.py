"""The ten registered queries, each its operator over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op2_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"), redacted=False)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import THRESHOLD, is_held_out, score_documents, train

    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltree import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import shared_passages

    return shared_passages(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_spotsigs, op2_sentencepieces, op3_audio, op4_pii, op5_simhash, op6_quality, op7_html, op8_chaining, op9_mixing, op10_urls)}

ORACLES: dict[str, str] = {"op9_mixing": mixing.ORACLE}
