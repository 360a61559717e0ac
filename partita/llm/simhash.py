"""SimHash near-duplicates: fingerprints of word shingles, a byte-position inverted index with count filtering, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.common import slices, written
from partita.llm.components import connected_components

#: Bytes of a fingerprint, each a position of the index.
POSITIONS = 8
_SPACE = re.compile(rb"[ \t-\r]")


def _words(data: bytes, block: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, a block at a time."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + block)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """The 64-bit SimHash of a text: a bit is set if more than half of the shingles' XXH64 have it."""
    import xxhash

    ones, n, carry, total = np.zeros(64, np.int64), 0, [], 0
    for found in _words((text or "").encode().lower()):  # bytes.lower and bytes.split know ASCII only, as wanted
        total += len(found)
        run = carry + found
        runs = map(b" ".join, zip(*(run[k:] for k in range(words))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        carry = run[-(words - 1) :] if words > 1 else []
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carry if words > 1 else []), seed) if total else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _bytes(at: tuple[int, ...]) -> Column:
    """The bytes of column fp at these positions, side by side."""
    out = F.lit(0).cast("long")
    for p in at:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")))
    return out


def postings(fps: DataFrame, shared: int, lead: int) -> DataFrame:
    """(key, fp): the lists of the index, each for `lead` positions and their bytes.

    Two fingerprints that agree in at least `shared` of the 8 bytes agree in at least `lead` of the first lead + 8 - shared,
    so the lists over those positions bring all such pairs together.
    """
    choices = list(combinations(range(lead + POSITIONS - shared), lead))
    keys = [F.lit(slot << 8 * lead).cast("long") + _bytes(at) for slot, at in enumerate(choices)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def longer_postings(lists: DataFrame, shared: int, lead: int) -> DataFrame:
    """Lists of `lead` positions cut into lists of `shared` ones: the pairs that reach `shared` share the rest of it elsewhere."""
    first = list(combinations(range(lead + POSITIONS - shared), lead))
    rest = [[tuple(x) for x in combinations([p for p in range(POSITIONS) if p not in at], shared - lead)] for at in first]
    more, slot = len(rest[0]), F.shiftright("key", 8 * lead)
    keys = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
    for s, choices in enumerate(rest):
        keys = keys.when(slot == s, F.array(*[F.shiftleft(F.lit(s * more + k).cast("long"), 8 * shared).bitwiseOR(F.shiftleft(F.col("key").bitwiseAND(F.lit((1 << 8 * lead) - 1)), 8 * (shared - lead))).bitwiseOR(_bytes(at)) for k, at in enumerate(choices)]))
    return lists.select(F.explode(keys).alias("key"), "fp")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: every node with the least node of its component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(ids))
    return ids[rest], ids[label[rest]]


def dense_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of different fingerprints that vary in at most 24 bits, by looking up what lies within the distance of each: no pairs are made.

    The work is the number of fingerprints times that of the bit patterns (2,324 for three of 24 bits), whatever the density.
    """
    vary = [k for k in range(64) if int(np.bitwise_or.reduce(fps ^ fps[0])) >> k & 1]
    value = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(vary):
        value |= (fps >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << len(vary), len(fps), np.int32)
    place[value] = np.arange(len(fps))
    masks = [sum(1 << k for k in some) for m in range(1, distance + 1) for some in combinations(range(len(vary)), m)]
    label = np.arange(len(fps) + 1)
    while True:
        before = label.copy()
        for mask in masks:
            label[:-1] = np.minimum(label[:-1], label[place[value ^ mask]])
        label = label[label]
        if (label == before).all():
            break
    rest = np.flatnonzero(label[:-1] != np.arange(len(fps)))
    return fps[rest], fps[label[rest]]


def verified_links(lists: DataFrame, shared: int, distance: int, dense: int = 8192, pairs: int = 1 << 18) -> DataFrame:
    """(a, b): links that connect the fingerprints of each list that lie within the distance.

    A list's pairs are made and tallied inside a task, `pairs` at a time: those with `shared` equal bytes are verified by their
    bits, and only links that connect anew leave the task. Lists of more than `dense` fingerprints look their neighbours up.
    """

    def tallied(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        behind = np.repeat(edge[1:], size) - np.arange(len(key)) - 1  # a fingerprint meets those behind it in its list
        upto, at = np.cumsum(behind), 0
        while at < len(key):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + pairs, side="right")))
            n = behind[at:end]
            ends = np.cumsum(n)
            x = np.repeat(np.arange(at, end), n)
            y = x + 1 + np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            differ = fp[x] ^ fp[y]
            count = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
            ok = (count >= shared) & (np.bitwise_count(differ) <= distance)
            if ok.any():
                yield forest(fp[x[ok]], fp[y[ok]])
            at = end

    def found(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, fp = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        large = np.repeat(np.diff(edge) > dense, np.diff(edge))
        for lo, hi in zip(edge[:-1], edge[1:]):
            if hi - lo > dense:
                yield dense_links(fp[lo:hi], distance)
        if not large.all():
            yield from tallied(key[~large], fp[~large])

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in found(t):
            parts.append(part)
            held += len(part[0])
            if held > pairs:
                parts = [forest(*map(np.concatenate, zip(*parts)))]
                held = len(parts[0][0])
        if parts:
            a, b = forest(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if len({batch.column("key")[0], batch.column("key")[-1], held[0].column("key")[0]}) == 1:
                continue  # one list goes on
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last list may go on
            if cut:
                yield from links(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from links(pa.Table.from_batches(held))

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def simhash_duplicates(docs: DataFrame, words: int = 5, distance: int = 3, seed: int = 42, lead: int = 3, most: int = 2048, salts: int = 32) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of `docs`.

    Fingerprints come from the XXH64 of word shingles (ASCII letters lower-cased, ASCII white space between, repeats counted);
    those that differ in at most `distance` bits are linked, and component_id is the smallest doc_id that links reach.

    1. Rows of one fingerprint become one entry of the index.
    2. A differing bit spoils one byte at most, so linked fingerprints agree in at least 8 - distance positional bytes. A list of
       a single byte would hold a 256th of all entries and its pairs their square; the lists are for `lead` positions at once, over
       as many positions as the guarantee needs, 20 lists an entry.
    3. Lists of more than `most` entries are cut into lists of 8 - distance positions, at most 2^24 entries each by their
       bits alone; still long ones look neighbours up instead of making pairs. The long lists are found by a count that is summed before the
       shuffle, and are met in `salts` parts.
    4. Inside a list, equal positional bytes are tallied per pair, pairs that reach the minimum are verified by their bits.
       Each task passes on only links that connect anew, so thousands of copies cost a few links each. Components follow.

    Null and empty texts, and texts without words, have the fingerprint zero and link like any other. A text of fewer words than a
    shingle is one shingle. Rows that share a doc_id are linked by their fingerprints only. Rows with a null doc_id link too; their
    component_id is the smallest doc_id that isn't null, or null if there is none. Other columns are ignored; an empty table gives no rows.
    """
    shared = POSITIONS - distance
    if not 1 <= lead < shared:
        raise ValueError("lists need at least one position, and fewer than linked fingerprints share")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(fingerprints(docs, words, seed), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "entries")

    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    short = postings(fps.select("fp"), shared, lead)
    hot = written(short.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), "long_lists")
    longer = None
    if not hot.isEmpty():
        salted, hot = short.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")), hot.select("key", every_salt)
        longer = longer_postings(salted.join(hot, ["key", "salt"], "left_semi").select("key", "fp"), shared, lead)
        short = salted.join(hot, ["key", "salt"], "left_anti").select("key", "fp")
    links = verified_links(short, shared, distance)
    links = written((links if longer is None else links.union(verified_links(longer, shared, distance))).distinct(), "links")

    found = connected_components(links)
    grouped = fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", "n", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
    # only what has company is looked up, once for each salt, so that copies of one text spread over tasks
    known = grouped.join(least, "component").select("fp", "component_id", every_salt)
    whole = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(known, ["fp", "salt"], "left")
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
