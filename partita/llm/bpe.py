"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from partita.llm.common import slices
from partita.llm.encoding import ChunkEncoder


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """BPE with a word-end suffix, read from a tokenizer file: merges, vocabulary and special tokens.

    encode(text): special-token strings are cut out first; the rest is brought to NFC, lower-cased letter by letter and cut
    into words, whose UTF-8 bytes are merged by rank. decode(ids): the vocabulary strings, a space between them.
    """

    SPACE = r"\t-\r \x85\xa0  -     　"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.byte = byte_symbols()
        self._word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{self.SPACE}\p{{L}}\p{{N}}]+")
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: str) -> list[int]:
        """The ids of one word. The queue holds (rank, position); entries whose pair has changed since are stale and skipped."""
        symbol: list[str | None] = [self.byte[b] for b in word.encode()]
        symbol[-1] += self.end
        n, rank = len(symbol), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if symbol[i] is None or j >= n or rank.get((symbol[i], symbol[j])) != r:
                continue
            symbol[i] += symbol[j]
            symbol[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(queue, (q, i))
            if (h := before[i]) >= 0 and (q := rank.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(queue, (q, h))
        return [self.vocab[s] for s in symbol if s is not None]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self._cut.split(text) if any(x in text for x in self.special) else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                low = (part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")).lower()
                for word in self._word.findall(low):
                    ids += self.merge(word)
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_kept: dict[str, tuple[WordBpe, ChunkEncoder]] = {}


def _kept_bpe(path: str) -> tuple[WordBpe, ChunkEncoder]:
    if path not in _kept:
        bpe = WordBpe(path)
        _kept[path] = bpe, ChunkEncoder(lambda chunks: [bpe.encode(c) for c in chunks], spaced=False, special=bpe.special)
    return _kept[path]


def bpe_round_trip(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32 bits), decoded_sha256.

    keep_ids adds the ids and the decoded text. A null text counts as empty: no ids, digests of nothing. Repeated rows give
    repeated results, a null doc_id stays null, other columns of `docs` are ignored. No shuffle; memory is bounded by
    slices of 8 MB of text (or one document) and a cache of 250,000 chunks.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = _kept_bpe(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, bounds = encoder.encode(batch.column("text").to_pylist())
                n, ids_sha, decoded_sha, ids, decoded = [], [], [], [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    own = flat[a:b]
                    text = bpe.decode(own.tolist())
                    n.append(len(own))
                    ids_sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    decoded_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids.append(own)
                        decoded.append(text)
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
