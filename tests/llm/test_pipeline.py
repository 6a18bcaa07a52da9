"""The pipeline against the same stages in plain Python and DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
import pandas as pd
import sentencepiece

import corpus_pipeline
from tidewheel.llm import mixing, pii, quality, sentencepieces, simhash

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [r for r in docs.collect() if quality.scores([r["text"]], model)[0] >= quality.THRESHOLD]
    ids = sorted(rows, key=lambda r: r["doc_id"])
    fps = [simhash.fingerprint(r["text"]) & (1 << 64) - 1 for r in ids]
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    kept = [(r["doc_id"], pii.redact(r["text"]), r["source"]) for k, r in enumerate(ids) if root[k] == k]
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(kept, columns=["doc_id", "text", "source"]))
    con.sql("create table documents as select * from frame")
    copies = {i: t // s if s else 0 for i, s, _, _, t in con.sql(mixing.ORACLE).fetchall()}
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    want = Counter()
    for i, text, _ in kept:
        want[i, tuple(lib.encode(text))] += copies[i]
    got = Counter((r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == +want and len(rows) < docs.count() and len(kept) < len(rows)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
