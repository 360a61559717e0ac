"""Phrase collocations: prefix-free parsing into a dictionary of chunks, weighted n-gram counts, scores per language."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import packed, slices, unpacked, written
from partita.llm.encoding import _spread
from partita.llm.shingles import mixed

#: Characters that end a piece: marks and line ends. Words are split at space and tab.
_BREAKS = r"[.,;:!?\n-\r]"
_BREAK = re.compile(_BREAKS)
#: The token that stands for a break; no word can be it.
_MARK = "."


class Plan(NamedTuple):
    """How much of a corpus goes where; the numbers grow with its bytes, so that a slice and a bucket stay of one size."""

    longest: int  # words of a phrase
    least: int  # occurrences of a phrase
    trigger: int  # a word in so many starts a chunk
    chunk: int  # words of a chunk at most
    slices: int  # parts of the dictionary
    buckets: int  # parts of the n-gram hashes
    bits: int  # of an n-gram hash


def plan(size: int, longest: int, least: int, trigger: int = 12, chunk: int = 1024) -> Plan:
    """For a corpus of `size` bytes: 8 MB a slice, 16 MB a bucket, and hash bits so that n-grams fill less than a hundredth of the hashes."""
    return Plan(longest, least, trigger, chunk, max(1, size >> 23), max(1, size >> 24), min(48, 6 + max(16, size.bit_length())))


def _merged(t: pa.Table) -> pa.Table:
    """One row a chunk, its occurrences summed. Chunks are told apart by codes, which takes less memory than a hash aggregate of their texts."""
    if not t.num_rows:
        return t
    t = t.combine_chunks()
    chunk, lang = (pc.dictionary_encode(t.column(c).chunk(0)) for c in ("chunk", "lang"))
    own = t.column("own").to_numpy().astype(np.int64)
    key = np.asarray(chunk.indices, dtype=np.int64) * len(lang.dictionary) + np.asarray(lang.indices)
    if len(chunk.dictionary) * len(lang.dictionary) * (int(own.max()) + 1) >= 1 << 62:
        raise ValueError("too many chunks in one slice")
    _, first, at = np.unique(key * (int(own.max()) + 1) + own, return_index=True, return_inverse=True)
    n = np.bincount(at, t.column("n").to_numpy()).astype(np.int64)
    return t.take(pa.array(first)).set_column(3, "n", pa.array(n)).combine_chunks()


def _segments(text: str | None, most: int = 1 << 22) -> list[str]:
    """A text, cut at breaks if it is long: phrases don't cross them."""
    text, out, at = text or "", [], 0
    while len(text) - at > most and (cut := _BREAK.search(text, at + most)):
        out.append(text[at : cut.end()])
        at = cut.end()
    return [*out, text[at:]]


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _parsed(langs: list[str], texts: list[str], p: Plan) -> pa.Table:
    """lang, own, chunk and n of the chunks of texts.

    A word whose hash is a multiple of `trigger` starts a chunk, whatever stands around it, so equal passages give equal chunks. A chunk
    owns the words up to the next one and carries the longest - 1 words after them: an n-gram is counted where it starts.
    """
    low = pc.ascii_lower(pa.array(texts, pa.large_string()))
    cut = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _BREAKS, f" {_MARK} "))
    coded = pc.dictionary_encode(cut.values)
    words = coded.dictionary.to_pylist()
    mark, empty = (np.fromiter((w == s for w in words), bool, len(words)) for s in (_MARK, ""))
    code = np.asarray(coded.indices, dtype=np.int32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.asarray(cut.offsets, dtype=np.int64)))
    # a break after a break or at the start of a text says nothing
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    after = np.concatenate([[True], mark[code[:-1]]]) if len(doc) else fresh
    keep = ~empty[code] & ~(mark[code] & (fresh | after))
    code, doc = code[keep], doc[keep]
    if not len(code):
        return pa.table({"lang": pa.array([], pa.string()), "own": pa.array([], pa.int32()), "chunk": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})
    starts_text = np.concatenate([[True], doc[1:] != doc[:-1]])
    begin = starts_text | ((_hashes(words) % np.uint64(p.trigger) == 0) & ~mark)[code]
    at = np.arange(len(code))
    begin |= (at - np.maximum.accumulate(np.where(begin, at, 0))) % p.chunk == 0
    first = np.flatnonzero(begin)
    end = np.append(first[1:], len(code))
    text_end = np.append(np.flatnonzero(starts_text)[1:], len(code))[np.cumsum(starts_text)[first] - 1]
    size = np.minimum(end + p.longest - 1, text_end) - first
    tokens = coded.dictionary.take(pa.array(code[_spread(first, size)]))
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    chunk = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), pa.scalar(" ", pa.large_string()))
    lang = pa.array(langs, pa.string()).take(pa.array(doc[first]))
    return pa.table({"lang": lang, "own": pa.array((end - first).astype(np.int32)), "chunk": chunk.cast(pa.large_string()), "n": pa.array(np.ones(len(first), np.int64))})


def chunk_rows(docs: DataFrame, p: Plan, most: int = 16 << 20) -> DataFrame:
    """(slice, data): the chunks of `docs` (lang, text), those of a task's next `most` bytes together and split by slice."""

    def flushed(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        import xxhash

        t = _merged(pa.concat_tables(parts))
        to = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in t.column("chunk").to_pylist()), np.uint64, t.num_rows) % np.uint64(p.slices)
        order = np.argsort(to, kind="stable")
        found, at = np.unique(to[order], return_index=True)
        t = t.take(pa.array(order))
        for k, lo, hi in zip(found.tolist(), at, [*at[1:], t.num_rows]):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed(t.slice(lo, hi - lo))], pa.binary())], ["slice", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what an earlier stage has left in this worker
        parts, held = [], 0
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                cut = [_segments(t) for t in batch.column("text").to_pylist()]
                langs = [lang for lang, s in zip(batch.column("lang").to_pylist(), cut) for _ in s]
                part = _parsed(langs, [x for s in cut for x in s], p)
                parts, held = [*parts, part], held + part.nbytes
                if held > most:
                    yield from flushed(parts)
                    parts, held = [], 0
                    pa.default_memory_pool().release_unused()
        if parts:
            yield from flushed(parts)

    return docs.mapInArrow(run, "slice long, data binary")


class Grams:
    """A slice of the dictionary in codes: what its n-grams are, where they start, and how often."""

    FIELDS = ("words", "langs", "code", "size", "own", "n", "lang")

    def __init__(self, row: dict[str, pa.Array], p: Plan):
        self.p, self.row = p, row
        self.words, self.langs = row["words"], row["langs"]
        self.code, size, own, n, lang = (row[c].to_numpy(zero_copy_only=False) for c in self.FIELDS[2:])
        chunk = np.repeat(np.arange(len(size), dtype=np.int32), size)
        at = np.arange(len(chunk), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        self.own, self.left = at < own[chunk], size[chunk] - at  # whether an n-gram may start here, and words up to the end of the chunk
        self.weight, self.lang = n[chunk], lang[chunk]

    @classmethod
    def of(cls, t: pa.Table, p: Plan) -> Grams:
        cut = pc.ascii_split_whitespace(t.column("chunk").combine_chunks())
        cut = cut.combine_chunks() if isinstance(cut, pa.ChunkedArray) else cut
        coded = pc.dictionary_encode(cut.values)
        langs = pc.dictionary_encode(t.column("lang").combine_chunks())
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        size = pa.array(np.diff(np.asarray(cut.offsets)).astype(np.int32))
        own, n = (t.column(c).combine_chunks() for c in ("own", "n"))
        return cls(dict(zip(cls.FIELDS, (coded.dictionary, langs.dictionary, coded.indices.cast(pa.int32()), size, own, n, langs.indices.cast(pa.int32())))), p)

    def packed(self) -> bytes:
        return packed(pa.table({c: pa.ListArray.from_arrays([0, len(v)], v) for c, v in ((c, self.row[c]) for c in self.FIELDS)}))

    @classmethod
    def unpacked(cls, data: bytes, p: Plan) -> Grams:
        t = unpacked([data])
        return cls({c: t.column(c).chunk(0).values for c in cls.FIELDS}, p)

    def starts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """m, starts and hashes of the n-grams of m words, from one word on."""
        names = self.words.to_pylist()
        mark, word = np.fromiter((w == _MARK for w in names), bool, len(names)), _hashes(names)
        start = np.flatnonzero(self.own & ~mark[self.code])
        h = _hashes(self.langs.to_pylist())[self.lang[start]]
        with np.errstate(over="ignore"):
            for m in range(1, self.p.longest + 1):
                if m > 1:
                    ok = self.left[start] >= m
                    start, h = start[ok], h[ok]
                    ok = ~mark[self.code[start + (m - 1)]]
                    start, h = start[ok], h[ok]
                h = mixed(h * np.uint64(3) ^ word[self.code[start + (m - 1)]])
                yield m, start, h >> np.uint64(64 - self.p.bits)

    def _distinct(self, m: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One start of each different n-gram, and its occurrences."""
        if m == 1:  # words are told apart by their codes: no sort
            key = self.lang[start].astype(np.int64) * len(self.words) + self.code[start]
            total = np.bincount(key, self.weight[start])
            one = np.empty(len(total), np.int64)
            one[key] = start
            have = np.flatnonzero(total)
            return one[have], total[have].astype(np.int64)
        codes = [self.lang[start], *(self.code[start + k] for k in range(m))]
        widths = [len(self.langs).bit_length(), *[len(self.words).bit_length()] * m]
        if sum(widths) <= 63:
            key = np.zeros(len(start), np.int64)
            for c, w in zip(codes, widths):
                key = key << w | c
            order = np.argsort(key)
            key = key[order]
            differ = key[1:] != key[:-1]
        else:
            order = np.lexsort(codes)
            differ = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in codes])
        first = np.flatnonzero(np.concatenate([[True], differ]))
        return start[order[first]], np.add.reduceat(self.weight[start][order], first)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The different hashes by size, sorted, and their occurrences, of which `least` are told from no more."""
        hashes, counts = [], []
        for m, start, h in self.starts():
            if not len(start):
                continue
            if m == 1:
                place = np.zeros(len(self.code), h.dtype)
                place[start] = h
                start, n = self._distinct(m, start)
                h = place[start]
                order = np.argsort(h)
                h, n = h[order], n[order]
            else:
                order = np.argsort(h)
                h, n = h[order], self.weight[start][order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            hashes.append(h[first])
            counts.append(np.minimum(np.add.reduceat(n, first), self.p.least))
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h, n = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(h, kind="stable")
        return h[order], n[order]

    def phrases(self, frequent: np.ndarray) -> Iterator[pa.Table]:
        """lang, size, phrase and n of the n-grams whose hash is frequent, and of all words of a language together (size 0)."""
        for m, start, h in self.starts():
            if m == 1 and len(start):
                total = np.bincount(self.lang[start], self.weight[start], len(self.langs)).astype(np.int64)
                have = np.flatnonzero(total)
                yield pa.table({"lang": self.langs.take(pa.array(have)), "size": pa.array(np.zeros(len(have), np.int32)), "phrase": pa.array([""] * len(have), pa.string()), "n": pa.array(total[have])})
            if not len(start) or not len(frequent):
                continue
            start = start[_found(frequent, h)] if m > 1 else start
            if not len(start):
                continue
            if m == 1:
                own = np.zeros(len(self.code), h.dtype)
                own[start] = h
            one, n = self._distinct(m, start)
            if m == 1:
                ok = _found(frequent, own[one])
                one, n = one[ok], n[ok]
            parts = [self.words.take(pa.array(self.code[one + k])) for k in range(m)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", self.words.type))
            yield pa.table({"lang": self.langs.take(pa.array(self.lang[one])), "size": pa.array(np.full(len(one), m, np.int32)), "phrase": phrase.cast(pa.string()), "n": pa.array(n.astype(np.int64))})


def _squeezed(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte in as many bytes as they need, and counts; compressed, with few bytes besides."""
    step = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    raw = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() + n.tobytes()
    return struct.pack("<BBI", width, n.itemsize if len(n) else 0, len(h)) + pa.compress(raw, "zstd", asbytes=True)


def _expanded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, item, size = struct.unpack_from("<BBI", data)
    raw = np.frombuffer(pa.decompress(data[6:], size * (width + item), "zstd", asbytes=True), np.uint8)
    step = np.zeros((size, 8), np.uint8)
    step[:, :width] = raw[: size * width].reshape(width, size).T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64), raw[size * width :].view(f"<u{item or 1}")


def _found(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def dictionary(rows: DataFrame, p: Plan, part: int = 4 << 20) -> DataFrame:
    """(slice, bucket, data): each slice of the dictionary with its parse frequencies (bucket -1, a row for each `part` bytes), and its n-gram hashes by bucket."""

    def run(t: pa.Table) -> pa.Table:
        k = t.column("slice")[0].as_py()
        merged, out, found = _merged(unpacked(t.column("data").to_pylist())), [], []
        cut = np.flatnonzero(np.diff(np.cumsum(pc.binary_length(merged.column("chunk")).to_numpy()) // part, prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], merged.num_rows]):  # a part of a slice at a time
            grams = Grams.of(merged.slice(lo, hi - lo).combine_chunks(), p)
            found.append(grams.counted())
            out.append((-1, grams.packed()))
        both = np.concatenate([h << np.uint64(16) | n.astype(np.uint64) for h, n in found]) if found else np.zeros(0, np.uint64)
        del merged, found
        both.sort()
        h, n = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        h, n = h[first], np.minimum(np.add.reduceat(n, first), p.least) if len(h) else n
        n = n.astype("u1" if p.least < 256 else "<u2")
        found, at = np.unique((h >> np.uint64(max(0, p.bits - 32))) * np.uint64(p.buckets) >> np.uint64(min(32, p.bits)), return_index=True)
        for b, lo, hi in zip(found.tolist(), at, [*at[1:], len(h)]):
            out.append((b, _squeezed(h[lo:hi], n[lo:hi])))
        pa.default_memory_pool().release_unused()
        return pa.table({"slice": pa.array([k] * len(out), pa.int64()), "bucket": pa.array([b for b, _ in out], pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    return rows.groupBy("slice").applyInArrow(run, "slice long, bucket long, data binary")


def frequent_hashes(rows: DataFrame, p: Plan) -> DataFrame:
    """(slice, data): for each slice those of its hashes that occur `least` times in all slices together."""

    def run(t: pa.Table) -> pa.Table:
        of = t.column("slice").to_pylist()
        parts = [_expanded(d) for d in t.column("data").to_pylist()]
        low, high = min(int(h[0]) for h, _ in parts), max(int(h[-1]) for h, _ in parts)
        often, edges = [], np.linspace(low, high + 1, 17).astype(np.uint64)
        places = [[0, *np.searchsorted(h, edges[1:16]), len(h)] for h, _ in parts]
        for k in range(16):  # a sixteenth of the bucket's range at a time
            h, n = (np.concatenate([x[side][at[k] : at[k + 1]] for x, at in zip(parts, places)]) for side in (0, 1))
            if len(h):
                order = np.argsort(h)
                h, n = h[order], n[order].astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                often.append(h[first[np.add.reduceat(n, first) >= p.least]])
        often = np.concatenate(often)
        out = [(k, own) for k, (x, _) in zip(of, parts) if len(own := x[_found(often, x)])]
        return pa.table({"slice": pa.array([k for k, _ in out], pa.int64()), "data": pa.array([_squeezed(x, np.zeros(0, np.uint8)) for _, x in out], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(run, "slice long, data binary")


def phrase_counts(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, size, phrase, n): the exact occurrences of all phrases of up to `longest` words that occur `least` times in their language.

    Size 0, with an empty phrase: all word occurrences of a language.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    p = plan(size, longest, least)
    rows = written(dictionary(chunk_rows(docs, p), p), "dictionary")
    often = frequent_hashes(rows.where("bucket >= 0"), p)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        kept = [_expanded(d)[0] for d in right.column("data").to_pylist()]
        often = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
        found = [t for data in left.column("data").to_pylist() for t in Grams.unpacked(data, p).phrases(often)]
        schema = pa.schema({"lang": pa.string(), "size": pa.int32(), "phrase": pa.string(), "n": pa.int64()})
        return pa.concat_tables(found) if found else schema.empty_table()

    chunks = rows.where("bucket < 0").select("slice", "data")
    counts = chunks.groupBy("slice").cogroup(often.groupBy("slice")).applyInArrow(run, "lang string, size int, phrase string, n long")
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def _ranked(df: DataFrame, keys: list[str], order: list, top: int, parts: int = 64) -> DataFrame:
    """The first `top` rows of each group with their rank: first inside parts of a group, so that no task holds a whole one."""
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    some = df.withColumn("part", F.pmod(F.xxhash64(*df.columns), F.lit(parts))).withColumn("rank", place(*keys, "part")).where(F.col("rank") <= top).drop("part")
    return some.withColumn("rank", place(*keys)).where(F.col("rank") <= top)


def _with_counts(cuts: DataFrame, known: DataFrame, total: int, side: str, name: str, salts: int, share: int = 4096) -> DataFrame:
    """`cuts` with the occurrences of the phrase in column `side`, as column `name`; that phrase is always among the known ones.

    A phrase that is over a `share`-th of all `total` words may be part of many others. There are at most `share` such phrases of one
    length, so they are broadcast, and their cuts are spread over `salts` keys that match nothing; all other phrases have one row.
    """
    count = F.col("n") * share > total
    often = known.where(count).select("lang", F.col("phrase").alias(side), F.col("n").alias("often"))
    rest = known.where(~count).select("lang", F.col("phrase").alias(side), F.lit(0).alias("salt"), "n")
    cuts = cuts.join(F.broadcast(often), ["lang", side], "left")
    cuts = cuts.withColumn("salt", F.when(F.col("often").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")))
    return cuts.join(rest, ["lang", side, "salt"], "left").withColumn(name, F.coalesce("often", "n")).drop("often", "salt", "n")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, salts: int = 16) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the strongest phrases of each language.

    Words are what space and tab leave of the pieces between marks and line ends, ASCII letters lower-cased. A phrase of 2 to `longest` words with
    a >= `least` occurrences is scored by its weakest cut in two: floor(1000000 * a * a / (l * r)), l and r the occurrences of the parts,
    ties to the earliest cut. A phrase inside a longer one that has `inside` percent of its occurrences goes. Ranks go by score, a (both
    descending) and phrase (by bytes); n is the number of words of the language.

    1. Texts are parsed into chunks that start at words picked by their hash and overlap by longest - 1 words; equal passages give equal
       chunks, which are counted instead of repeated. Chunks are dealt by their hash into slices of the dictionary (pre-aggregated in tasks).
    2. Each slice hashes the n-grams that start in its chunks, weighted by the chunks' frequencies. Counts of hashes,
       summed in buckets over all slices, tell which can be frequent at all; no frequent phrase is lost, for equal phrases share their hash.
    3. Each slice gets back those of its own hashes, and counts the phrases themselves: hashes only rule out, counts are of words.

    A null or empty text has no words; a null language is `und`. Repeated rows count as often as they stand there. Other columns are
    ignored; an empty table gives no rows. Counts are longs, products decimals of 38 digits (a beyond about 10^15 raises).
    """
    if not 0 < least < 1 << 16:
        raise ValueError("least has to be between 1 and 65535")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = written(phrase_counts(docs, longest, least), "counts")
    known = counts.where("size > 0").select("lang", "phrase", "n")
    total = counts.where("size = 0").agg(F.sum("n")).first()[0] or 0
    found = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    join = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    inner = found.where("size > 2").select("lang", "a", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at")).groupBy("lang", join(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = found.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))

    cuts = kept.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = _with_counts(cuts, known, total, side, name, salts)
    wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    score = cuts.select("lang", "phrase", "k", F.col("a").alias("count"), F.col("l").alias("left"), F.col("r").alias("right"), *[v.alias(c) for c, v in wide.items()])
    score = score.withColumn("score", F.expr("(a * a * 1000000BD) div (l * r)"))
    worst = score.groupBy("lang", "phrase").agg(F.max("count").alias("a"), F.min(F.struct("score", "k", "left", "right")).alias("cut"))
    worst = worst.select("lang", "phrase", "a", F.col("cut.left").alias("l"), F.col("cut.right").alias("r"), F.col("cut.score").alias("score"))
    first = _ranked(worst, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return first.join(counts.where("size = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
