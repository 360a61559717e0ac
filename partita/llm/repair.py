"""Token ids in grammar-compressed shards: Re-Pair rules, expansion lengths, a document index for random access.

A shard is one binary value: a header of eight 64-bit integers (magic, documents, rules, symbols, base, bytes of a symbol, 0, 0), then
doc_ids (64 bits; a validity byte each follows), the symbol at which each document starts (64 bits, one more at the end),
the rules' two sides (32 bits), the rules' expansion lengths (64 bits), and the symbols. Ids from `base` on are rules.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import shared_folder, slices
from partita.llm.encoding import kept_encoder

MAGIC = 0x52455041


class Shard:
    """A compressed shard. documents are expanded one at a time or all at once."""

    def __init__(self, doc_ids: list, starts: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int):
        self.doc_ids, self.starts, self.rules, self.lengths, self.symbols, self.base = doc_ids, starts, rules, lengths, symbols, base
        self._flat: np.ndarray | None = None

    @property
    def tokens(self) -> int:
        return int(self._sizes(self.symbols).sum())

    def to_bytes(self) -> bytes:
        wide = self.base + len(self.rules) > 1 << 16
        head = np.array([MAGIC, len(self.doc_ids), len(self.rules), len(self.symbols), self.base, 4 if wide else 2, 0, 0], "<i8")
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        valid = np.array([d is not None for d in self.doc_ids], "u1")
        return b"".join(x.tobytes() for x in (head, ids, valid, self.starts.astype("<i8"), self.rules.astype("<u4"), self.lengths.astype("<i8"), self.symbols.astype("<u4" if wide else "<u2")))

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, docs, rules, symbols, base, width, _, _ = np.frombuffer(data, "<i8", 8).tolist()
        if magic != MAGIC:
            raise ValueError("not a shard")
        at, out = 64, []
        for kind, n in (("<i8", docs), ("u1", docs), ("<i8", docs + 1), ("<u4", 2 * rules), ("<i8", rules), (f"<u{width}", symbols)):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        ids, valid, starts, sides, lengths, syms = out
        return cls([int(i) if v else None for i, v in zip(ids, valid)], starts, sides.reshape(-1, 2), lengths, syms, base)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        sizes = np.ones(len(symbols), np.int64)
        rule = symbols >= self.base
        sizes[rule] = self.lengths[symbols[rule].astype(np.int64) - self.base]
        return sizes

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The token ids of some symbols. The rules' expansions are laid out once, in their order (a rule uses earlier ones)."""
        if self._flat is None:
            self._at = np.concatenate([[0], np.cumsum(self.lengths)])
            self._flat = np.empty(int(self._at[-1]), np.int32)
            for k, (x, y) in enumerate(self.rules.tolist()):
                at = int(self._at[k])
                for side in (x, y):
                    if side < self.base:
                        self._flat[at] = side
                        at += 1
                    else:
                        n = int(self.lengths[side - self.base])
                        self._flat[at : at + n] = self._flat[(s := int(self._at[side - self.base])) : s + n]
                        at += n
        sizes = self._sizes(symbols)
        wide = symbols.astype(np.int64)
        if not len(self.rules):
            return symbols.astype(np.int32)
        rule = np.repeat(wide >= self.base, sizes)
        ends = np.cumsum(sizes)
        begin = np.where(wide >= self.base, self._at[np.clip(wide - self.base, 0, len(self.rules))], 0)
        source = np.repeat(begin - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.where(rule, self._flat[np.clip(source, 0, len(self._flat) - 1)], np.repeat(wide, sizes)).astype(np.int32)

    def document(self, k: int) -> np.ndarray:
        """Random access: only this document's symbols are expanded."""
        return self.expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids and where each document starts."""
        ends = np.concatenate([[0], np.cumsum(self._sizes(self.symbols))])
        return self.expand(self.symbols), ends[self.starts]


def _apart(at: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Which of the places `at` of pairs may be replaced: in a run of one symbol only every second from its left."""
    same = np.flatnonzero(equal)
    free = np.ones(len(at), bool)
    if len(same):
        place = at[same]
        first = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1]))
        free[same[(np.arange(len(same)) - np.repeat(first, np.diff(np.append(first, len(same))))) % 2 == 1]] = False
    return free


def _short(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 19-bit hash of pairs."""
    return ((x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA77)) >> np.uint32(13)).astype(np.intp)


def _beside(right: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """The places right and left of ascending places, those inside 0 to n - 1, each once."""
    first = np.ones(len(left), bool)
    first[1:] = left[1:] != right[:-1]
    return np.concatenate([right[right < n], left[first & (left >= 0)]])


def compress(doc_ids: list, ids: np.ndarray, starts: np.ndarray, base: int, least: int = 9, symbols: int | None = None) -> Shard:
    """Re-Pair over one shard: rounds replace the most frequent pairs by new symbols until no pair occurs `least` times.

    With symbols of two bytes, a rule (16 bytes) for a pair that occurs under nine times saves nothing. A round replaces the
    pairs that reach a bound; where two of them overlap, the more frequent one goes first, and a pair of which too few are left
    then waits for another round (the most frequent pair never does). A pair of equal symbols is replaced left to right. The bound falls to an eighth
    when no pair reaches it or a round replaced little. Pairs are first counted by a short hash, and exactly only where that count
    reaches the bound. Pairs never reach over the end of a document. It ends early only when `symbols` numbers are used up:
    65,536, or for larger vocabularies so many more than `base`. Ids from `base` on raise.
    """
    symbols = symbols or (1 << 16 if base < 60_000 else base + (1 << 16))
    seq = ids.astype(np.uint32)
    if len(seq) and int(seq.max()) >= base:
        raise ValueError("the vocabulary has ids from the base of the rules on")
    starts = np.asarray(starts, np.int64)
    rules: list[tuple[int, int]] = []
    lengths: list[int] = []
    size = lambda s: 1 if s < base else lengths[s - base]
    kind, shift = (np.uint32, 16) if symbols <= 1 << 16 else (np.uint64, 32)
    # n: pairs by short hash, kept up to date; the last number stands for pairs over the end of a document, which never count
    hashes = 1 << 19
    short = _short(seq[:-1], seq[1:])
    ends = starts[(starts > 0) & (starts < len(seq))] - 1
    short[ends] = hashes
    n = np.bincount(short, minlength=hashes + 1)
    bound = max(least, len(seq))
    while len(rules) < symbols - base:
        n[hashes] = 0
        if (top := int(n.max())) < least:
            break
        bound = max(least, min(bound, top))
        at = np.flatnonzero((n >= bound)[short])
        at = at[_apart(at, seq[at] == seq[at + 1])]
        codes = (seq[at].astype(kind) << kind(shift)) | seq[at + 1]
        pairs = np.sort(codes)
        edge = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
        count = np.diff(np.append(edge, len(pairs)))
        often = np.flatnonzero(count >= bound)
        if not len(often):
            if bound == least:
                break
            bound = max(least, bound // 8)
            continue
        keys, count = pairs[edge[often]], count[often]
        place = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == codes)
        at, place = at[hit], place[hit]
        # of pairs that overlap the more frequent one is replaced
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(keys))
        turn, beside = rank[place], np.diff(at) == 1
        first = np.ones(len(at), bool)
        first[:-1] &= ~beside | (turn[:-1] > turn[1:])
        first[1:] &= ~beside | (turn[1:] > turn[:-1])
        at, place = at[first], place[first]
        left = np.bincount(place, minlength=len(keys))
        made = np.flatnonzero(left >= max(least, bound // 2))
        made = made[np.argsort(-left[made], kind="stable")][: symbols - base - len(rules)]
        number = np.zeros(len(keys), np.uint32)
        number[made] = np.arange(base + len(rules), base + len(rules) + len(made))
        for pair in keys[made].tolist():
            x, y = pair >> shift, pair & ((1 << shift) - 1)
            rules.append((x, y))
            lengths.append(size(x) + size(y))
        new = number[place]
        at, new = at[new > 0], new[new > 0]
        # the pairs that go: each replaced one and its neighbours, of which two replaced pairs side by side share one
        n -= np.bincount(np.concatenate([short[at], short[_beside(at + 1, at - 1, len(short))]]), minlength=hashes + 1)
        seq[at] = new
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, starts = seq[keep], starts - np.searchsorted(at + 1, starts)
        keep = np.ones(len(short), bool)
        keep[at] = False
        short = short[keep]
        now = at - np.arange(len(at))
        near = _beside(now, now - 1, len(short))
        near = near[short[near] < hashes]
        short[near] = _short(seq[near], seq[near + 1])
        n += np.bincount(short[near], minlength=hashes + 1)
        if len(at) < len(seq) // 100:
            bound = max(least, bound // 8)
    return Shard(doc_ids, starts, np.array(rules, np.uint32).reshape(-1, 2), np.array(lengths, np.int64), seq, base)


def write_shards(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, shard_tokens: int = 1 << 20) -> None:
    """Writes the ids of all documents, in ascending doc_id order, as shards under `path` (part, shard, n_tokens, n_docs, payload).

    Rules are numbered from the size of the vocabulary on. A null text counts as empty: its end id alone. Null
    doc_ids come first, rows of one doc_id in the order of their text's hash. Rows are range-partitioned by doc_id; a task
    writes shards of about `shard_tokens` ids as it goes, so memory is bounded by a shard, or by one longer document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = kept_encoder(vocabulary, False, 750_000), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(sizes)])
            made = compress(names, np.concatenate(ids), starts, encoder.size)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([int(starts[-1])], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([made.to_bytes()], pa.binary())], ["part", "shard", "n_tokens", "n_docs", "payload"])

        for whole in batches:
            for batch in slices(whole, "text"):
                flat, bounds = encoder.encode(batch.column("text").to_pylist())
                n = np.diff(bounds)
                ends = np.insert(flat, bounds[1:], end_id)  # after each document
                ids.append(ends)
                sizes += (n + 1).tolist()
                names += batch.column("doc_id").to_pylist()
                if sum(map(len, ids)) >= shard_tokens:
                    yield flush()
                    ids, names, sizes, shard = [], [], [], shard + 1
        if names:
            yield flush()

    rows.mapInArrow(run, "part int, shard int, n_tokens long, n_docs long, payload binary").write.option("compression", "zstd").parquet(path)


def read_shards(shards: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' own bytes.

    start counts the ids of all documents before it: inside the shard, of the shards before it in its part, and of the parts
    before that. The running sums are over one row a shard and one row a part. keep_ids adds the ids.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = (Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("first"))
    here = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(*upto)), F.lit(0)).alias("before"))
    place = here.join(parts, "part").select("part", "shard", (F.col("first") + F.col("before")).alias("at"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, at in zip(batch.column("payload"), batch.column("at").to_pylist()):
                shard = Shard.from_bytes(payload.as_buffer())
                flat, starts = shard.documents()
                whole, cuts = memoryview(flat.astype("<u4", copy=False)).cast("B"), (4 * starts).tolist()
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1] + at), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([flat[a:b] for a, b in zip(starts[:-1], starts[1:])], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return shards.select("part", "shard", "payload").join(place, ["part", "shard"]).select("payload", "at").mapInArrow(run, schema)


def token_files(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes the shards into a new shared folder and reads them back: one row per row of `docs`. An empty table gives none."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-shards")
    write_shards(docs, vocabulary, path, **options)
    return read_shards(spark.read.schema("part int, shard int, n_tokens long, n_docs long, payload binary").parquet(path))
