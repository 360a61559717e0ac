"""Near-duplicate documents: minhash signatures, a multi-index Hamming join, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import fresh, slices, written
from partita.llm.components import connected_components
from partita.llm.shingles import MinHash, shingle_sets

#: Bits of a sketch: the set of the shingle hashes modulo this number.
SKETCH = 2048


def sketch(hashes: np.ndarray) -> bytes:
    bits = np.zeros(SKETCH, np.uint8)
    bits[hashes & np.uint64(SKETCH - 1)] = 1
    return np.packbits(bits).tobytes()


def signatures(docs: DataFrame, words: int, length: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature, sketch) of every row; set_id is a 128-bit digest of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sign = MinHash(length)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, ids, signs, bits = [], [], [], []
                for s in shingle_sets(batch.column("text"), words):
                    n.append(len(s))
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signs.append(sign(s).tobytes() if len(s) else None)
                    bits.append(sketch(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (ids, signs, bits))], ["doc_id", "n_shingles", "set_id", "signature", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature binary, sketch binary")


class Chunks:
    """A signature cut into chunks, of which every choice of `errors` positions is left out in turn: one key each.

    Two signatures that differ in at most `guaranteed` positions have a chunk with at most `errors` differences (pigeonhole),
    so they share a key; others may. With up to three positions left in a chunk, keys hold the values themselves.
    """

    def __init__(self, length: int, chunk: int, errors: int):
        if length % chunk or not 0 <= errors < chunk:
            raise ValueError("chunks have to divide the signature and hold more positions than errors")
        self.chunk, self.errors, self.count = chunk, errors, length // chunk
        self.left = list(combinations(range(chunk), errors))
        self.guaranteed = self.count * (errors + 1) - 1
        # which choice covers the differences of a chunk, as bits; -1: too many
        self.cover = np.array([next((m for m, left in enumerate(self.left) if all(p in left for p in range(chunk) if code >> p & 1)), -1) for code in range(1 << chunk)])

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """A column for each chunk and choice."""
        sig = signs.reshape(-1, self.count, self.chunk).astype(np.uint64)
        out = np.empty((len(sig), self.count * len(self.left)), np.int64)
        for slot in range(out.shape[1]):
            c, left = slot // len(self.left), self.left[slot % len(self.left)]
            mask = [p for p in range(self.chunk) if p not in left]
            key = np.full(len(sig), slot, np.uint64)
            with np.errstate(over="ignore"):
                for p in mask:
                    key = (key << np.uint64(16)) | sig[:, c, p] if len(mask) <= 3 else (key * np.uint64(0x9E3779B97F4A7C15)) ^ sig[:, c, p]
            out[:, slot] = key.view(np.int64)
        return out

    def first_slot(self, differ: np.ndarray) -> np.ndarray:
        """The first column in which two signatures meet, from where they differ (a row a pair); -1: none."""
        code = differ.reshape(-1, self.count, self.chunk) @ (1 << np.arange(self.chunk))
        cover = self.cover[code]
        c = (cover >= 0).argmax(axis=1)
        m = cover[np.arange(len(c)), c]
        return np.where(m >= 0, c * len(self.left) + m, -1)


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _possible(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: int) -> np.ndarray:
    """Whether two sets may be similar: each bit that one sketch lacks is an element that its set lacks. Never wrong about a similar pair."""
    common = np.minimum(na - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return 100 * common >= similarity * (na + nb - common)


def bucket_rows(reps: DataFrame, chunks: Chunks) -> DataFrame:
    """(key, id): a row for each key of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunks.keys(_signs(batch.column("signature")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("id").take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))], ["key", "id"])

    return reps.select("id", "signature").mapInArrow(run, "key long, id long")


def _near_leaders(stars: DataFrame, reps: DataFrame, distance: int, similarity: int) -> DataFrame:
    """(a, b, d): the pairs whose signatures differ in at most `distance` positions and whose sets may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = (_signs(batch.column("xsignature")) != _signs(batch.column("ysignature"))).sum(axis=1).astype(np.int32)
                nx, ny = batch.column("xn").to_numpy(), batch.column("yn").to_numpy()
                ok = (d <= distance) & _possible(nx, ny, _bits(batch.column("xsketch")), _bits(batch.column("ysketch")), similarity)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(ok)) for c in "ab"), pa.array(d[ok])], ["a", "b", "d"])

    x, y = (reps.select(F.col("id").alias(side), *[F.col(c).alias(f"{name}{c}") for c in ("n", "signature", "sketch")]) for side, name in (("a", "x"), ("b", "y")))
    return stars.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long, d int")


def _cross_pairs(rows: DataFrame, chunks: Chunks, distance: int, similarity: int, few: int | None) -> DataFrame:
    """(a, b, d, ca, cb, more): pairs of different components that a block's rows allow; each pair comes from the first bucket in which it meets.

    rows: key, i, j (a block), role (x, y or both), id, component, main, n, signature, sketch. An x row meets the y rows of its
    block. few: at most so many pairs of two components from a batch, the nearest ones; `more` tells that there were others.
    """
    names = ["a", "b", "d", "ca", "cb", "more"]

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, i, j, role, ids, comp, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "role", "id", "component", "n"))
        main = t.column("main").to_numpy(zero_copy_only=False)
        signs, bits = _signs(t.column("signature")), _bits(t.column("sketch"))
        edge = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        group = np.cumsum(edge) - 1
        xs, ys = np.flatnonzero(((role == 0) & ~main) | (role == 1)), np.flatnonzero(role != 1)
        ny = np.bincount(group[ys], minlength=group[-1] + 1)
        first = np.cumsum(ny) - ny
        takes = ny[group[xs]]
        upto = np.cumsum(takes)
        slots, found, at = chunks.keys(signs), [], 0
        while at < len(xs):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 18), side="right")))
            own, k = xs[at:end], takes[at:end]
            ends = np.cumsum(k)
            x = np.repeat(own, k)
            y = ys[np.repeat(first[group[own]] - (ends - k), k) + np.arange(int(ends[-1]))]
            ok = (comp[x] != comp[y]) & (main[y] | (ids[x] < ids[y])) & (100 * np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            differ = signs[x] != signs[y]
            d = differ.sum(axis=1)
            ok = d <= distance
            x, y, d, differ = x[ok], y[ok], d[ok], differ[ok]
            ok = slots[x, chunks.first_slot(differ)] == key[x]
            x, y, d = x[ok], y[ok], d[ok]
            ok = _possible(n[x], n[y], bits[x], bits[y], similarity)
            found.append(np.stack([x[ok], y[ok], d[ok]]))
            at = end
        x, y, d = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        lo, hi = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
        more = np.zeros(len(x), bool)
        if few is not None and len(x):
            order = np.lexsort((d, hi, lo))
            x, y, d, lo, hi = (v[order] for v in (x, y, d, lo, hi))
            start = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            count = np.diff(np.append(start, len(x)))
            keep = np.arange(len(x)) - np.repeat(start, count) < few
            x, y, d, lo, hi, more = (v[keep] for v in (x, y, d, lo, hi, np.repeat(count > few, count)))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])), pa.array(d.astype(np.int32)), pa.array(lo), pa.array(hi), pa.array(more)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            last = [t.column(c)[-1].as_py() for c in ("key", "i", "j")]
            same = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last)])
            cut = t.num_rows - int(same.sum())  # the last block may go on
            if cut:
                yield pairs(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "a long, b long, d int, ca long, cb long, more boolean")


def _blocks(buckets: DataFrame, found: DataFrame, reps: DataFrame, block: int, only: DataFrame | None = None) -> DataFrame:
    """The rows of _cross_pairs for the buckets that hold more than one component (`only`: of these components).

    Inside a bucket's largest component nothing has to be compared, so it stands on one side only; either side is cut into
    blocks of about `block` rows.
    """
    placed = buckets.join(found, buckets["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    if only is not None:
        placed = placed.join(only, "component", "left_semi")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("key").agg(F.count("*").alias("components"), F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("main")).where("components > 1")
    sizes = sizes.select("key", F.col("main.component").alias("chief"), F.ceil((F.col("m") - F.col("main.m")) / block).alias("nx"), F.ceil(F.col("m") / block).alias("ny"))
    rows = placed.join(sizes, "key").withColumn("main", F.col("component") == F.col("chief"))
    small = F.col("nx") * F.col("ny") == 1
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    part = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)))
    places = lambda role, i, j: F.transform(i, lambda p: F.transform(j, lambda q: F.struct(F.lit(role).alias("role"), p.alias("i"), q.alias("j"))))
    x, y = places(1, part("nx"), to("ny")), places(2, to("nx"), part("ny"))
    every = F.when(small, places(0, part("nx"), part("ny"))).otherwise(F.concat(F.when(F.col("main"), F.slice(x, 1, 0)).otherwise(x), y))
    rows = rows.select("key", "id", "component", "main", F.explode(F.flatten(every)).alias("p")).select("key", "p.i", "p.j", "p.role", "id", "component", "main")
    return rows.join(reps.select("id", "n", "signature", "sketch"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _perhaps(rows: DataFrame, ids: DataFrame, n: int, column: str = "doc_id") -> DataFrame:
    """The rows whose `column` is one of the `n` values of `ids`, and one in sixteen of the others or more, up to all of them.

    A bit for a hash of each value, in bitmaps of 4 KB that Spark aggregates: 8 MB at most whatever n is, so that they can be broadcast.
    """
    bits = min(1 << 26, max(1 << 15, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    spot, maps = fresh(rows, "bitmap"), fresh(rows, "bucket")
    made = ids.groupBy(F.bitmap_bucket_number(place).alias(maps)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(spot))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(spot), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn(maps, F.bitmap_bucket_number(place)).join(F.broadcast(made), maps)
    return held.where(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position(pmod(xxhash64({column}), {bits}L)) % 8 as int))")) != 0).select(*rows.columns)


def _sets(docs: DataFrame, reps: DataFrame, again: DataFrame | None, words: int) -> DataFrame:
    """(id, shingles) of the sets `reps`, made again from the texts of their documents; again: the doc_ids of several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = list(shingle_sets(batch.column("text"), words))
                full = [k for k, s in enumerate(found) if len(s)]  # a row without words may share the doc_id
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(full, pa.int64())), pa.array([found[k].view(np.int64) for k in full], pa.list_(pa.int64()))], ["id", "shingles"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in slices(whole, "text"):
                found = list(shingle_sets(batch.column("text"), words))
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["set_id", "shingles"])

    wanted = written(reps.select("set_id", "id", "doc_id"), "wanted")
    # texts that aren't wanted are left out where they are read, not after they have been dealt out by doc_id
    # (a semi-join would be pushed below the join with the bitmaps)
    texts = _perhaps(docs, wanted, wanted.count())
    alone = wanted if again is None else wanted.join(again, "doc_id", "left_anti")
    sets = texts.join(alone.select("doc_id", "id"), "doc_id").select("id", "text").mapInArrow(run, "id long, shingles array<long>")
    if again is not None:  # which of the texts made a set is told by its digest
        several = wanted.join(again, "doc_id", "left_semi")
        made = texts.join(several.select("doc_id").distinct(), "doc_id").select("text").mapInArrow(digests, "set_id binary, shingles array<long>")
        made = made.groupBy("set_id").agg(F.first("shingles").alias("shingles"))
        sets = sets.union(made.join(several.select("set_id", "id"), "set_id").select("id", "shingles"))
    return written(sets, "shingles")


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, again: DataFrame | None, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. Sets are made for the ends of these pairs only."""
    sets = _sets(docs, reps.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"), again, words)
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", (F.size("x") + F.size("y")).alias("sum"), F.size(F.array_intersect("x", "y")).alias("common"))
    return written(both.where(100 * F.col("common") >= similarity * (F.col("sum") - F.col("common"))).select("a", "b"), "links")


def _still_apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that the components `found` (node, component) don't join, with their components ca < cb."""
    here = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    pairs = pairs.select("a", "b").distinct().join(here("a"), "a", "left").join(here("b"), "b", "left")
    pairs = pairs.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
    return pairs.select("a", "b", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components `found` (node, component), joined by further links."""
    return connected_components(links.union(found.select("node", "component")))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, length: int = 40, chunk: int = 4, errors: int = 1, distance: int = 19, leaders: int = 3, few: int = 256, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`.

    Documents are linked if their sets of word shingles reach the Jaccard similarity (percent); component_id is the smallest
    doc_id that links reach, kept marks the row whose doc_id that is. A text of fewer words than a shingle is one shingle.

    1. Every row gets a minhash signature of `length` positions of 16 bits. Rows of one set share a representative.
    2. Signatures are cut into chunks of `chunk` positions, with a key for each choice of `errors` positions left out: all pairs
       within `distance` positions meet in a bucket (chunks x (errors + 1) - 1 has to be at least that, or this raises). At
       similarity 0.8, sets differ in more than 19 of 40 positions once in 30,000.
    3. Members meet their buckets' least ones; for each member the `leaders` nearest are confirmed on full sets. Thousands of
       copies thus cost a few links each, not all pairs. Components follow.
    4. Pairs of a bucket within `distance` that lie in different components are compared too, first the 4 and then the `few` nearest
       pairs of each two components; if two that have more pairs are still apart then, every pair of those two: no link is
       lost, for pairs inside a component can't change it. Sizes and sketches (bits that one set has and the other lacks) rule out pairs that can't reach the
       similarity; the rest is confirmed on full sets.

    Null and empty texts have no shingles and link with nothing (component_id is the own doc_id). Rows that share a doc_id
    are one document with several sets. Rows with a null doc_id are left alone: null component_id, kept. Other columns are
    ignored; an empty table gives no rows.
    """
    chunks = Chunks(length, chunk, errors)
    if distance > chunks.guaranteed:
        raise ValueError("the chunks don't guarantee this distance")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(signatures(docs, words, length), "signatures")
    known = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    one = known.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("signature", "sketch")], F.first("n_shingles").alias("n"))
    reps = written(one.withColumn("id", F.monotonically_increasing_id()), "sets")

    keys = bucket_rows(reps, chunks)
    shared = written(keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("key", "leader"), "shared")
    buckets = written(_perhaps(keys, shared, shared.count(), "key").join(shared, "key"), "buckets")
    # only sets that share a bucket go on
    ids = written(buckets.select("id").distinct(), "members")
    members = written(_perhaps(reps, ids, ids.count(), "id").join(ids, "id"), "members")
    near = _near_leaders(buckets.where("leader <> id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), members, distance, similarity)
    turn = F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))
    near = written(near.withColumn("turn", turn).where(F.col("turn") <= leaders).select("a", "b"), "near")
    again = written(known.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "again")
    again = None if again.isEmpty() else again

    confirmed = lambda pairs: _confirmed(pairs, docs, members, again, words, similarity)
    links = confirmed(near)
    if again is not None:
        several = known.join(again, "doc_id", "left_semi").select("doc_id", "set_id").distinct().join(reps.select("set_id", "id"), "set_id")
        links = links.union(several.join(several.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b"))
    found = connected_components(links)
    turn = F.row_number().over(Window.partitionBy("ca", "cb").orderBy("d", "a", "b"))
    apart = written(_cross_pairs(_blocks(buckets, found, members, block), chunks, distance, similarity, few).withColumn("turn", turn).where(F.col("turn") <= few + 1), "apart")
    # the nearest pairs of two components mostly link; the others are looked at where those didn't
    for low, high in ((0, min(4, few)), (min(4, few), few)):
        turn = written(_still_apart(apart.where((F.col("turn") > low) & (F.col("turn") <= high)), found), "turn")
        if not turn.isEmpty():
            found = _merged(found, confirmed(turn))
    # two components of which pairs were left out: are they one by now?
    doubtful = written(_still_apart(apart.where((F.col("turn") > few) | F.col("more")), found).select("ca", "cb").distinct(), "doubtful")
    if not doubtful.isEmpty():  # of all other components, every pair has been confirmed or ruled out
        only = doubtful.select(F.explode(F.array("ca", "cb")).alias("component")).distinct()
        rest = _cross_pairs(_blocks(buckets, found, members, block, only), chunks, distance, similarity, None).join(doubtful, ["ca", "cb"], "left_semi")
        rest = written(rest.select("a", "b").join(apart.where(F.col("turn") <= few), ["a", "b"], "left_anti"), "rest")
        found = _merged(found, confirmed(rest))

    whole = reps.join(found, F.col("id") == F.col("node"), "left").select("set_id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = whole.join(least, "component").select("set_id", "component_id")
    out = rows.join(whole, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
