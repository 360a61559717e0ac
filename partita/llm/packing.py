"""Hierarchical packing of documents into windows of several lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from partita.llm.common import slices
from partita.llm.encoding import ChunkEncoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


#: Fixed value: the special token of the byte-level vocabulary, which texts may spell out.
SPECIAL = {"<|endoftext|>": 50256}


def ranks_encoder(path: str, pattern: str, special: Mapping[str, int] = SPECIAL) -> ChunkEncoder:
    """Byte-level BPE from a rank file; the ids are those of the tokenizer file of the same vocabulary, special strings included."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return ChunkEncoder(lambda texts: [coding.encode(t, allowed_special="all") if any(x in t for x in special) else coding.encode_ordinary(t) for t in texts], spaced=True, special=special)


class Packer:
    """Packs the documents of one task; pieces() hands out what is packed so far.

    A document longer than the longest tier is cut into full windows first. The rest goes to the smallest tier that holds it.
    Tiers are packed from the longest down: each document opens a window, and the gap behind it is filled from the pools of
    the shorter tiers, largest fitting piece first; where none fits, one is cut to measure, and where there are none, a piece of the
    tier itself. So a pool holds one unfilled window at most after each packing. Only full windows leave before the end; what is over then is joined into windows of the longest tier, and the last of these is cut into full windows of
    power-of-two lengths. Windows of a tier are dealt in order to step groups of `step_tokens` tokens, so that all groups of
    a tier hold the same number of tokens; a group's number is its own among all tiers and tasks.
    """

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = sorted(tiers, reverse=True), step_tokens
        self.base, self.windows, self.made = task << 36, 0, defaultdict(int)
        self.pool: dict[int, deque] = {t: deque() for t in self.tiers}
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, most = len(ids), self.tiers[0]
        full = n - n % most
        for at in range(0, full, most):
            self._emit([(doc_id, at, ids[at : at + most], n)], most)
        if full < n:
            tier = min(t for t in self.tiers if t >= n - full)
            self.pool[tier].append((doc_id, full, ids[full:], n))

    def _emit(self, window: list[tuple], tier: int) -> None:
        group = self.base + (tier.bit_length() << 30) + self.made[tier] // max(1, self.step_tokens // tier)
        self.made[tier] += 1
        at = 0
        for doc_id, start, ids, n in window:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.base + self.windows, at, tier, group))
            at += len(ids)
        self.windows += 1

    def _fill(self, window: list[tuple], gap: int, tier: int, shorter: list[int]) -> int:
        """Fills a gap from the pools of `shorter` tiers, and where they are empty by cutting pieces of the tier itself; gives what stays open."""
        while gap:
            source = next((t for t in shorter if self.pool[t] and len(self.pool[t][0][2]) <= gap), None)
            if source is None:
                source = next((t for t in (*reversed(shorter), tier) if self.pool[t]), None)
                if source is None:
                    return gap
            doc_id, start, ids, n = self.pool[source].popleft()
            took = min(gap, len(ids))
            window.append((doc_id, start, ids[:took], n))
            if took < len(ids):
                left = (doc_id, start + took, ids[took:], n)
                self.pool[min(t for t in self.tiers if t >= len(ids) - took)].append(left)
            gap -= took
        return 0

    def pack(self) -> None:
        """Turns the pools into full windows; pieces of windows that can't be filled yet go back to their pools."""
        for k, tier in enumerate(self.tiers):
            shorter = self.tiers[k + 1 :]
            while self.pool[tier]:
                first = self.pool[tier].popleft()
                window = [first]
                if self._fill(window, tier - len(first[2]), tier, shorter):
                    for piece in window:
                        self.pool[min(t for t in self.tiers if t >= len(piece[2]))].appendleft(piece)
                    break
                self._emit(window, tier)

    def finish(self) -> None:
        self.pack()
        most = self.tiers[0]
        rest = [piece for t in self.tiers for piece in self.pool[t]]
        total = sum(len(piece[2]) for piece in rest)
        sizes = [most] * (total // most) + [1 << b for b in reversed(range(most.bit_length())) if total % most >> b & 1]
        pieces = deque(rest)
        for size in sizes:
            window, gap = [], size
            while gap:
                doc_id, start, ids, n = pieces.popleft()
                window.append((doc_id, start, ids[:gap], n))
                if len(ids) > gap:
                    pieces.appendleft((doc_id, start + gap, ids[gap:], n))
                gap -= min(gap, len(ids))
            self._emit(window, size)
        self.pool = {t: deque() for t in self.tiers}

    def pieces(self) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = list(zip(*self.out)) or [()] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


_kept: dict[tuple, ChunkEncoder] = {}


def pack_documents(docs: DataFrame, ranks: str, pattern: str, end_id: int = 0, tiers: tuple[int, ...] = (128, 256, 512, 1024), step_tokens: int = 65536) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its window (sequence_id, offset).

    A null text counts as empty; every document has at least its end id. Repeated rows are packed as documents of their own;
    a null doc_id stays null; other columns are ignored; an empty table gives no rows. Tiers have to be powers of two. Each
    input partition packs its own documents (no shuffle, no state between tasks), so a retried task gives the same rows;
    memory is bounded by a slice of 4 MB of text and one unfilled window a tier.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers have to be powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept.get((ranks, pattern)) or _kept.setdefault((ranks, pattern), ranks_encoder(ranks, pattern))
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                flat, bounds = encoder.encode(batch.column("text").to_pylist())
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                    packer.add(doc_id, np.append(flat[a:b], np.int32(end_id)))
                packer.pack()
                yield packer.pieces()
        packer.finish()
        yield packer.pieces()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
