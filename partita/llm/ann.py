"""Approximate nearest neighbours by cosine: an NN-descent graph, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import written
from partita.llm.vectors import matrix, nodes_and_members, usable


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; large and tiny rows are scaled first, so no length over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(vectors: DataFrame) -> DataFrame:
    """(id, unit, err) with the unit vector as 32-bit floats; a cosine of two of them, summed in 32 bits, is off by the sum of their err at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = _unit(matrix(batch.column("vec"))).astype(np.float32)
                err = (u.shape[1] + 2) * 2.0**-24
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in u], pa.binary()), pa.array(np.full(len(u), err))], ["id", "unit", "err"])

    return vectors.mapInArrow(run, "id long, unit binary, err double")


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a packed column, read from Arrow's buffer as it is."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.float32).reshape(len(column), -1)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of each node; `fresh` marks those not yet joined, `added` those not there before.

    Ties go by hash, so that nodes that 32 bits can't tell apart don't all choose the same few.
    """
    best = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.min("added").alias("added"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), F.xxhash64("id", "nbr"), "nbr"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _compare(groups: DataFrame, per_member: int) -> DataFrame:
    """Compares the members of each bounded group: edges (id, nbr, sim) to the nearest members that are nearer than `floor`.

    groups: members array<struct<id, fresh, floor, unit>>. Pairs of two members that aren't fresh were compared before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            column = batch.column("members")
            flat = column.flatten()
            if not len(flat):
                continue
            ids, fresh, floor = (flat.field(n).to_numpy(zero_copy_only=False) for n in range(3))
            unit = _vectors(flat.field(3))
            sizes = np.diff(np.asarray(column.offsets))
            chance = np.random.default_rng(int(ids[0]) & 0xFFFF).random(2 * int(sizes.max()), np.float32) * np.float32(1e-7)
            ends = np.cumsum(sizes)
            for a, b in zip(ends - sizes, ends):
                if b - a < 2:
                    continue
                sim = unit[a:b] @ unit[a:b].T
                ok = (fresh[a:b, None] | fresh[None, a:b]) & (ids[a:b, None] != ids[None, a:b]) & (sim > floor[a:b, None])
                sim[~ok] = -2
                k = min(per_member, b - a - 1)
                # equal nodes choose by chance, each row by its own
                near = np.argpartition(np.lib.stride_tricks.sliding_window_view(chance[: 2 * (b - a) - 1], b - a) - sim, k - 1, axis=1)[:, :k]
                got = np.take_along_axis(sim, near, axis=1)
                row, col = np.nonzero(got > -2)
                out.append((ids[a:b][row], ids[a:b][near[row, col]], got[row, col]))
            if out:
                x, y, s = (np.concatenate(z) for z in zip(*out))
                if not len(x):
                    continue
                # once per pair, and no more than per_member for each node of the batch
                order = np.lexsort((y, -s, x))
                x, y, s = x[order], y[order], s[order]
                once = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                x, y, s = x[once], y[once], s[once]
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                keep = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < per_member
                x, y, s = x[keep], y[keep], s[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(s.astype(np.float32))], ["id", "nbr", "sim"])

    return groups.select("members").mapInArrow(run, "id long, nbr long, sim float")


def _cells(packed: DataFrame, n: int, block: int, starts: int, pivots: int = 512) -> DataFrame:
    """(id, unit, start, cell): nodes keyed by their nearest pivot, `starts` times, and again inside every cell that is large.

    A level gives a cell of m nodes 4 m / (3 block) pivots, `pivots` at most, so levels grow with n and no table of pivots does. Cells
    over four blocks are divided further, unless nine tenths of the cell above fell into them: pivots can't tell those apart.
    """
    frames = []
    for start in range(starts):
        rows = packed.orderBy(F.xxhash64("id", F.lit(start)), "id").limit(min(pivots, -(-4 * n // (3 * block))))
        frames.append(_vectors(pa.array([r["unit"] for r in rows.select("unit").collect()], pa.binary())))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _vectors(batch.column("unit"))
                for start, frame in enumerate(frames):
                    near = (unit @ frame.T).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("unit"), pa.array(np.full(len(near), start, np.int32)), pa.array(near), pa.array(np.full(len(near), n))], ["id", "unit", "start", "cell", "above"])

    def divide(rows: pa.Table, frame: pa.Table) -> pa.Table:
        near = np.empty(0, np.int64)
        if rows.num_rows and frame.num_rows:
            frame = frame.sort_by("id")
            near = (_vectors(rows.column("unit").combine_chunks()) @ _vectors(frame.column("unit").combine_chunks()).T).argmax(axis=1)
        return rows.select(["id", "unit", "start", "cell", "m"]).append_column("near", pa.array(near))

    cells, done, level = written(packed.mapInArrow(cell, "id long, unit binary, start int, cell long, above long"), "cells"), None, 0
    while True:
        large = written(cells.groupBy("start", "cell").agg(F.count("*").alias("m"), F.max("above").alias("above")).where((F.col("m") > 4 * block) & (10 * F.col("m") < 9 * F.col("above"))).select("start", "cell", "m"), "large")
        small = cells.join(large, ["start", "cell"], "left_anti").select("id", "unit", "start", "cell")
        done = small if done is None else done.union(small)
        if large.isEmpty():
            return done
        level += 1
        rows = cells.join(large, ["start", "cell"]).select("id", "unit", "start", "cell", "m", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / 4096)).alias("part"))
        turn = F.row_number().over(Window.partitionBy("start", "cell").orderBy(F.xxhash64("id", "start", F.lit(level)), "id"))
        frame = rows.withColumn("turn", turn).where((F.col("turn") <= pivots) & (F.col("turn") <= F.ceil(4 * F.col("m") / (3 * block))))
        frame = written(frame.select("id", "unit", "start", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / 4096) - 1)).alias("part")), "pivots")
        found = rows.groupBy("start", "cell", "part").cogroup(frame.groupBy("start", "cell", "part")).applyInArrow(divide, "id long, unit binary, start int, cell long, m long, near long")
        cells = written(found.select("id", "unit", "start", F.xxhash64("cell", "near", F.lit(level)).alias("cell"), F.col("m").alias("above")), "cells")


def nn_descent(packed: DataFrame, k: int = 24, sample: int = 12, changes: float = 0.01, block: int = 1024, starts: int = 6) -> DataFrame:
    """The neighbour graph (id, nbr, sim) of `packed` (id, unit): about the k nearest of each.

    Start: each of `starts` times, nodes are keyed by their nearest pivot (see _cells) and cut by hash into blocks of about
    `block`, which are compared in full. Then every round joins each node's neighbours and reverse neighbours with each other
    (of either kind at most `sample` that are fresh and `sample` known ones, drawn by hash), which compares neighbours of
    neighbours, and keeps the best k. Rounds end when at most the share `changes` of the edges is new. The graph is approximate;
    searches on it are measured for recall.
    """
    spark = packed.sparkSession
    n = packed.count()
    if not n:
        return spark.createDataFrame([], "id long, nbr long, sim float")
    cells = _cells(packed, n, block, starts)
    count = cells.groupBy("start", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    blocks = cells.join(count, ["start", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", "start"), F.col("blocks")))
    member = F.struct("id", F.lit(True).alias("fresh"), F.lit(-2.0).cast("float").alias("floor"), "unit")
    first = _compare(blocks.groupBy("start", "cell", "block").agg(F.collect_list(member).alias("members")), min(k, 16))
    graph = written(_top(first.withColumns({"fresh": F.lit(True), "added": F.lit(True)}), k), "graph")
    turn = 0
    while not graph.isEmpty():
        drawn = F.row_number().over(Window.partitionBy("id", "fresh").orderBy(F.xxhash64("id", "nbr", F.lit(turn)), "nbr")) <= sample
        graph = graph.withColumn("drawn", drawn)
        back = F.row_number().over(Window.partitionBy("nbr", "fresh").orderBy(F.xxhash64("nbr", "id", F.lit(turn)), "id"))
        reverse = graph.where("drawn").withColumn("back", back).where(F.col("back") <= sample).select(F.col("nbr").alias("at"), "id", "fresh")
        joined = graph.where("drawn").select(F.col("id").alias("at"), F.col("nbr").alias("id"), "fresh").union(reverse).groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
        floor = graph.groupBy("id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        lit = packed.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0).cast("float")))
        # a node without anything fresh beside it has nothing to compare
        awake = joined.withColumn("awake", F.max("fresh").over(Window.partitionBy("at"))).where("awake").drop("awake")
        groups = awake.join(lit, "id").groupBy("at").agg(F.collect_list(F.struct("id", "fresh", "floor", "unit")).alias("members"))
        found = _compare(groups, k).select("id", "nbr", "sim", F.lit(True).alias("fresh"), F.lit(True).alias("added"))
        graph = written(_top(graph.select("id", "nbr", "sim", (F.col("fresh") & ~F.col("drawn")).alias("fresh"), F.lit(False).alias("added")).union(found), k), "graph")
        turn += 1
        total, added = graph.agg(F.count("*"), F.count_if("added")).first()
        if added <= changes * total:
            break
    return graph.select("id", "nbr", "sim")


def search(packed: DataFrame, graph: DataFrame, asked: DataFrame, ef: int = 192, degree: int = 48, entries: int = 1024, block: int = 512, part: int = 4096) -> DataFrame:
    """(query_id, node, sim): the beam of `ef` nodes that greedy search ends with, for `asked` (query_id, unit).

    Each query starts from the best of at most `entries` nodes (those of least hash) and, where its query_id is a node of the graph,
    from that node, so that a start is near whatever the number of nodes. A step takes the nodes of the beam not
    expanded yet, joins them with their neighbours both ways (the `degree` nearest), measures those and keeps the best ef; it
    ends when no beam has a node left to expand. A query whose beam has none is put aside at once, so that the last steps, which
    few queries need, carry only their beams. Queries go in blocks of `block`, so that a node that many
    queries of a block meet is sent to it once; the nodes that a block meets in a step are cut into parts of about `part`, and the
    block's queries go to those parts only.
    """
    both = graph.select("id", "nbr", "sim").union(graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "sim")).groupBy("id", "nbr").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), F.xxhash64("id", "nbr"), "nbr"))
    links = written(both.withColumn("rank", rank).where(F.col("rank") <= degree).groupBy("id").agg(F.collect_list("nbr").alias("nbrs")), "links")
    n = asked.count()
    blocks = -(-max(1, n) // block)
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries")
    entry = packed.orderBy(F.xxhash64("id", F.lit("entry")), "id").limit(entries).collect()
    if not entry or not n:
        return packed.select(F.col("id").alias("query_id"), F.col("id").alias("node"), F.lit(0.0).alias("sim")).limit(0)
    ids, frame = np.array([r["id"] for r in entry]), _vectors(pa.array([r["unit"] for r in entry], pa.binary()))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = _vectors(batch.column("unit")) @ frame.T
                k = min(ef, len(ids))
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                queries, of = (np.repeat(batch.column(c).to_numpy(), k) for c in ("query_id", "block"))
                yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(of), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(sims, near, axis=1).ravel())], ["query_id", "block", "node", "sim"])

    def meet(found: pa.Table) -> pa.Table:
        """The distinct (node, query) pairs of a block, by node."""
        lists = found.column("nbrs").combine_chunks()
        queries = np.repeat(found.column("query_id").to_numpy(), np.diff(np.asarray(lists.offsets)))
        nodes = lists.flatten().to_numpy()
        order = np.lexsort((queries, nodes))
        nodes, queries = nodes[order], queries[order]
        once = np.concatenate([[True], (nodes[1:] != nodes[:-1]) | (queries[1:] != queries[:-1])])
        nodes, queries = nodes[once], queries[once]
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        met = pa.ListArray.from_arrays(pa.array(np.append(first, len(nodes)), pa.int32()), pa.array(queries))
        return pa.table({"block": pa.array(np.full(len(first), found.column("block")[0].as_py(), np.int32)), "node": pa.array(nodes[first]), "queries": met})

    def measure(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        """Similarities of a block's queries to one part of the nodes it met: those over a query's floor, ef at most."""
        out = []
        if nodes.num_rows and queries.num_rows:
            q = queries.column("query_id").to_numpy()
            order = np.argsort(q)
            sims = _vectors(queries.column("unit").combine_chunks()) @ _vectors(nodes.column("unit").combine_chunks()).T
            lists = nodes.column("queries").combine_chunks()
            col = np.repeat(np.arange(nodes.num_rows), np.diff(np.asarray(lists.offsets)))
            row = order[np.searchsorted(q[order], lists.flatten().to_numpy())]
            wanted = np.full(sims.shape, -9, np.float32)
            wanted[row, col] = sims[row, col]
            wanted[wanted <= queries.column("floor").to_numpy()[:, None]] = -9
            k = min(ef, wanted.shape[1])
            near = np.argpartition(-wanted, k - 1, axis=1)[:, :k]
            got = np.take_along_axis(wanted, near, axis=1)
            r, c = np.nonzero(got > -9)
            out = [q[r], nodes.column("node").to_numpy()[near[r, c]], got[r, c]]
        of = queries.column("block")[0].as_py() if queries.num_rows else 0
        x, y, s = out or (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        return pa.table({"query_id": x, "block": np.full(len(x), of, np.int32), "node": y, "sim": s})

    by = Window.partitionBy("query_id").orderBy(F.desc("sim"), "node")
    entered = asked.mapInArrow(enter, "query_id long, block int, node long, sim float")
    own = asked.join(packed.select("id"), asked["query_id"] == packed["id"], "left_semi").select("query_id", "block", F.col("query_id").alias("node"), F.lit(1.0).cast("float").alias("sim"))
    first = entered.union(own).groupBy("query_id", "block", "node").agg(F.max("sim").alias("sim"))
    beam = written(first.withColumn("k", F.row_number().over(by)).where(F.col("k") <= ef).drop("k").withColumn("done", F.lit(False)), "beam")
    ended = beam.select("query_id", "node", "sim").limit(0)
    while not beam.isEmpty():
        todo = beam.where("NOT done").select("query_id", "block", "node")
        met = todo.join(links, todo["node"] == links["id"]).groupBy("block").applyInArrow(meet, "block int, node long, queries array<long>")
        met = written(met, "met")
        parts = met.groupBy("block").agg(F.ceil(F.count("*") / part).alias("parts"))
        met = met.join(parts, "block").join(packed, met["node"] == packed["id"]).select("block", "node", "queries", "unit", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
        floor = beam.groupBy("query_id").agg(F.when(F.count("*") >= ef, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        lit = asked.join(floor, "query_id").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        new = met.groupBy("block", "part").cogroup(lit.groupBy("block", "part")).applyInArrow(measure, "query_id long, block int, node long, sim float")
        # a beam holds ef nodes at most, so a step expands all that were left
        every = beam.withColumn("done", F.lit(True)).union(new.withColumn("done", F.lit(False))).groupBy("query_id", "block", "node").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))
        kept = every.withColumn("k", F.row_number().over(by)).where(F.col("k") <= ef).drop("k")
        step = written(kept.withColumn("live", F.max(~F.col("done")).over(Window.partitionBy("query_id"))), "beam")
        ended = ended.union(step.where("NOT live").select("query_id", "node", "sim"))
        beam = step.where("live").drop("live")
    return ended


def _candidates(packed: DataFrame, graph: DataFrame, asked: DataFrame, k: int, ef: int = 192, entries: int = 1024) -> DataFrame:
    """(query_id, node): every found node that may be one of the k nearest, as far as 32 bits can tell.

    A node may be if its similarity is no further below the k-th than the error of both. Queries for which a full beam ends
    before that are searched again with a beam twice as long, so that a large group of near copies is found whole.
    """
    n, worst = packed.agg(F.count("*"), F.max("err")).first()
    out = None
    while True:
        beam = search(packed, graph, asked.select("query_id", "unit"), ef, entries=entries)
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "node"))
        kth = beam.withColumn("turn", turn).groupBy("query_id").agg(F.count("*").alias("found"), F.min("sim").alias("last"), F.max(F.when(F.col("turn") == k, F.col("sim"))).alias("kth"))
        reach = F.coalesce(F.col("kth") - 2 * (F.col("err") + F.lit(worst or 0.0)) , F.lit(-2.0)).alias("reach")
        kth = written(kth.join(asked.select("query_id", "err"), "query_id").select("query_id", reach, ((F.col("found") >= ef) & (F.col("last") >= reach)).alias("cut")), "reach")
        again = kth.where("cut").select("query_id")
        whole = kth if ef >= n else kth.where("NOT cut")
        part = beam.join(whole, "query_id").where("sim >= reach").select("query_id", "node")
        out = part if out is None else out.union(part)
        if ef >= n or again.isEmpty():
            return out
        asked, ef = written(asked.join(again, "query_id", "left_semi"), "asked"), 2 * ef


def nearest(table: DataFrame, is_query, k: int = 5, block: int = 1024, entries: int = 1024, ef: int = 192) -> DataFrame:
    """query_id, rank, vec_id and score (cosine in double precision) of about the k nearest rows of each query row of `table`.

    The query's own row is no candidate. Ties go to the smaller vec_id; equal vectors share a node of the graph. Vectors that
    are null, empty, zero or hold null or non-finite components take no part, nor do null vec_ids; all others have to be of
    one length. With fewer candidates than k all are returned; an empty table gives no rows. Other columns are ignored.
    """
    vectors = written(usable(table, nonzero=True), "vectors")
    nodes, members = nodes_and_members(vectors, k + 1)
    nodes, members = written(nodes, "nodes"), written(members, "members")
    # queries of one vector are one search
    queries = vectors.where(is_query(F.col("vec_id"))).withColumnRenamed("vec_id", "query_id").join(nodes, "vec").select("query_id", F.col("id").alias("own"))
    queries = written(queries, "queries")
    packed = written(_packed(nodes), "units")
    asked = packed.join(queries.select(F.col("own").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "query_id")
    best = _candidates(packed, written(nn_descent(packed, block=block), "graph"), written(asked, "asked"), k + 1, ef, entries)
    both = best.join(nodes.toDF("node", "y"), "node").join(nodes.toDF("query_id", "x"), "query_id").select("query_id", "node", "x", "y")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = matrix(batch.column("x")), matrix(batch.column("y"))
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(cosine)], ["own", "node", "score"])

    scored = both.mapInArrow(score, "own long, node long, score double")
    # the k + 1 best nodes hold the k + 1 best rows, for a node's id is its least vec_id
    turn = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "node"))
    scored = scored.withColumn("turn", turn).where(F.col("turn") <= k + 1)
    found = scored.join(members, scored["node"] == members["id"]).select("own", "vec_id", "score")
    rows = queries.join(found, "own").where("vec_id <> query_id").select("query_id", "vec_id", "score")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
