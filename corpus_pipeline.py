"""A corpus pipeline of five of the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver may
write it as Parquet and read it again as the next one's docs. All stages but
the last return the columns of documents, and further ones, whatever their
names.

In every stage a null text counts as empty, long texts are used whole, null
ids and sources are values like others, and an empty table gives no rows. Rows
that repeat an id and a text become one in the near-dedup stage, which keeps
the least id of a component, rows without one last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import mixing, pii, quality, sentencepieces, simhash
from tidewheel.llm.common import checkpoint, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact_column(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return sentencepieces.encode_texts(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_copies),
    ("PII", redact_personal_data),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The stages are trained, hashed or matched by means that SQL lacks; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is cut off from its
    lineage, as the written table of the stages would be."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
