"""Texts that no set is made of are not moved."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from partita.llm import near_dedup


def test_texts_without_near_copies_stay_where_they_are(spark, unsent, moved, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"{v:x}" for v in rng.integers(0, 1 << 40, 5000))) for k in range(120)]
    rows += [(1000, rows[7][1] + " end"), (1001, rows[8][1] + " end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = moved()
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=4).collect()}
    spent = moved() - before
    assert got == {k: {1000: 7, 1001: 8}.get(k, k) for k, _ in rows}
    assert spent < sum(len(t) for _, t in rows) / 4, spent


def test_perhaps_loses_no_document(spark):
    docs = spark.range(-2000, 2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = docs.where("doc_id % 40 = 0")
    got = {r.doc_id for r in near_dedup._perhaps(docs, ids, 100).collect()}
    assert got >= set(range(-2000, 2000, 40)) and len(got) < 100 + 4000 / 16
    assert near_dedup._perhaps(docs, ids.limit(0), 0).count() == 0
