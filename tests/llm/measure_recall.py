"""Recall of op1 against brute force; a script, not a test.

python tests/llm/measure_recall.py TABLE_FOLDER            the query on a folder's embeddings
python tests/llm/measure_recall.py made N GROUP NOISE      N vectors of 64 dimensions, half of them in groups of near copies (GROUP 0: none)
"""

from __future__ import annotations

import sys
import tempfile
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def made(n: int, group: int, noise: float, folder: str) -> str:
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 64))
    for at in range(0, n // 2 - group + 1 if group else 0, group or 1):
        x[at : at + group] = x[at] + rng.normal(size=(group, 64)) * noise
    x = rng.permutation(x).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    return folder


def main() -> None:
    from partita.llm.registry import op1_ann

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master("local[6]").config("spark.driver.memory", "4g").config("spark.local.dir", folder).config("spark.sql.shuffle.partitions", "12").config("spark.checkpoint.dir", f"file://{folder}/shared").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tables = made(int(sys.argv[2]), int(sys.argv[3]), float(sys.argv[4]), folder) if sys.argv[1] == "made" else sys.argv[1]
    began, got = time.time(), defaultdict(set)
    for r in op1_ann(spark, tables).collect():
        got[r.query_id].add(r.vec_id)
    took = time.time() - began
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect() if r.embedding and None not in r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = x @ x[q]
        near[q] = -9
        hit += len(got[ids[q]] & set(ids[np.lexsort((ids, -np.round(near, 12)))[:5]].tolist()))
        total += 5
    print(f"{len(ids)} vectors, {took:.0f} s, recall@5 by id {hit / total:.4f}")


if __name__ == "__main__":
    main()
