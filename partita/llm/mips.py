"""Exact top-k by integer inner product: a pivot-distance index with triangle-inequality bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import written
from partita.llm.vectors import matrix, nodes_and_members, usable


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by floats where those are exact, else in integers; products beyond 64 bits raise."""
    most = float(np.abs(x.astype(float)).max()) * float(np.abs(y.astype(float)).max()) * x.shape[1] if len(x) and len(y) else 0.0
    if most < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return x @ y.T
    return (x.astype(object) @ y.astype(object).T).astype(np.int64)  # OverflowError where one doesn't fit


def _pivots(sample: np.ndarray, n: int, turns: int = 5) -> np.ndarray:
    """n centres of a bounded sample by a few turns of k-means."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(turns):
        near = ((sample * sample).sum(1)[:, None] - 2 * sample @ centres.T + (centres * centres).sum(1)).argmin(axis=1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = sample[near == k].mean(axis=0)
    return centres


def top_products(table: DataFrame, is_query, k: int = 10, scale: int = 1024, pivots: int = 64, most_pivots: int = 2048, rings: int = 16, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest inner product, for each query row of `table`.

    Components are floor(scale * x). The query's own row is no candidate; ties go to the smaller vec_id; fewer candidates than k
    are all returned. Vectors that are null, empty or hold null or non-finite components take no part, nor do null vec_ids;
    all others have to be of one length. Products that don't fit 64 bits raise. An empty table gives no rows; other columns are ignored.

    A coordinate sqrt(M^2 - |x|^2) more (0 for queries) turns the largest product into the least distance. Vectors are keyed by
    their nearest pivot (k-means centres of a sample, those of least hash, sixteen vectors a pivot) and by rings of the distance to it.
    A pivot stands for 16,384 vectors; there are `pivots` at least and `most_pivots` at most, so the tables of pivots and cells are bounded. By the triangle inequality no vector of a cell can be nearer to q than the difference between
    q's distance to the pivot and the cell's range of distances. Queries visit cells in the order of that bound: a first turn until 8 k vectors
    are seen, a second until 64 k, and a last one over every cell whose bound still allows the k-th score found. All
    vectors stay in the index; equal ones share a node. Cells are cut into blocks by hash, which meet blocks of queries.
    """
    spark = table.sparkSession
    digits = usable(table, nonzero=False).select("vec_id", F.transform("vec", lambda x: F.floor(x * scale)).cast("array<long>").alias("vec"))
    vectors = written(digits, "vectors")
    nodes, members = nodes_and_members(vectors, k + 1)
    nodes, members = written(nodes, "nodes"), written(members, "members")
    squared = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    most = nodes.agg(F.max(squared)).first()[0]
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = min(most_pivots, max(pivots, nodes.count() // 16_384))
    rows = nodes.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(max(4096, 16 * pivots)).collect()

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])

    centres = _pivots(lifted(np.array([r["vec"] for r in rows], np.int64)), pivots)
    width = max(1.0, float(np.sqrt(4 * most)) / (4 * rings))

    def distances(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(centres)))
        for p, c in enumerate(centres):
            out[:, p] = np.sqrt(((x - c) ** 2).sum(axis=1))
        return out

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(matrix(batch.column("vec"), np.int64)))
                near = d.argmin(axis=1)
                own = d[np.arange(len(d)), near]
                ring = np.minimum(4 * rings - 1, (own / width).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(near * 4 * rings + ring), pa.array(own)], ["id", "vec", "cell", "distance"])

    keyed = written(nodes.mapInArrow(index, "id long, vec array<long>, cell long, distance double"), "index")
    cells = keyed.groupBy("cell").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n")).orderBy("cell").collect()  # at most pivots x 4 rings
    cell, lo, hi, n = (np.array([c[x] for c in cells]) for x in ("cell", "lo", "hi", "n"))
    pivot = cell // (4 * rings)
    sizes = spark.createDataFrame([(int(c), int(-(-m // block))) for c, m in zip(cell, n)], "cell long, blocks long")
    blocks = keyed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = written(blocks.groupBy("cell", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("vec").alias("vecs")), "blocks")
    asked = written(vectors.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec"), "queries")

    def visits(batches: Iterator[pa.RecordBatch], before: int, upto: int | None) -> Iterator[pa.RecordBatch]:
        """The cells of a turn: after those in which `before` vectors lie; up to `upto` vectors, or to the bound of the k-th score."""
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):  # query x cell tables stay small
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), np.int64)
            q = np.column_stack([x.astype(np.float64), np.zeros(len(x))])
            d = distances(q)[:, pivot]
            bound = np.maximum(0.0, np.maximum(d - hi, lo - d) * (1 - 1e-9) - 1e-3)
            order = np.argsort(bound, axis=1, kind="stable")
            seen = np.cumsum(n[order], axis=1) - n[order]  # vectors in the cells before
            take = seen >= before if before else np.ones_like(seen, bool)
            if upto is not None:
                take &= seen < upto
            else:
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                best = ((x.astype(np.float64) ** 2).sum(axis=1)[:, None] + most - np.take_along_axis(bound, order, axis=1) ** 2) / 2
                take &= ~(best * (1 + 1e-9) + 1e-3 < kth[:, None])  # NaN: fewer than k seen, nothing is ruled out
            row, col = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), pa.array(cell[order[row, col]])], ["query_id", "cell"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_numpy()
                asked_ids = batch.column("query_ids")[i].values.to_numpy()
                score = _products(matrix(batch.column("query_vecs")[i].values, np.int64), matrix(batch.column("vecs")[i].values, np.int64))
                m = min(k + 1, len(ids))
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked_ids, m)), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(score, order, axis=1).ravel())], ["query_id", "node", "score"])

    by = Window.partitionBy("query_id")
    found: DataFrame | None = None
    for before, upto in ((0, 8 * k), (8 * k, 64 * k), (64 * k, None)):
        ask = asked
        if upto is None:
            # a node may be the query's own, so the bound is the score of rank k + 1
            kth = found.groupBy("query_id").agg(F.when(F.count("*") > k, F.min("score")).cast("double").alias("kth"))
            ask = asked.join(kth, "query_id", "left")
        turn = written(ask.mapInArrow(lambda b, x=before, y=upto: visits(b, x, y), "query_id long, cell long"), "visits")
        # a cell's queries go in parts of about 256, by hash; a row a cell, so the broadcast is bounded
        parts = turn.groupBy("cell").agg(F.ceil(F.count("*") / 256).alias("parts"))
        turn = turn.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).join(asked, "query_id").groupBy("cell", "part").agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("vec").alias("query_vecs"))
        new = turn.join(blocks, "cell").select("query_ids", "query_vecs", "ids", "vecs").mapInArrow(match, "query_id long, node long, score long")
        every = (found.union(new) if found is not None else new).withColumn("k", F.row_number().over(by.orderBy(F.desc("score"), "node")))
        found = written(every.where(F.col("k") <= k + 1).drop("k"), "found")
    rows = found.join(members, found["node"] == members["id"]).where("vec_id <> query_id").select("query_id", "vec_id", "score")
    ranked = rows.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
