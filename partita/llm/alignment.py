"""Alignment of two tokenizers' tokens by byte ranges, and how often their ids are linked in a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import packed, slices, unpacked, written
from partita.llm.encoding import _MARKS, _RARE, _UNEVEN, ChunkEncoder, _place, _spread

#: How a piece vocabulary spells the space.
_SPACE = "▁"


class Vocabularies(NamedTuple):
    """The files of both vocabularies: A as ranks with its split pattern and as a tokenizer file, B as a piece model."""

    ranks: str
    pattern: str
    tokenizer: str
    pieces: str


def _byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bytes:
    """The bytes of every token of a vocabulary, end to end."""

    def __init__(self, tokens: Sequence[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.blob[_spread(self.start[ids], self.size[ids])]


class PairEncoder:
    """encode(texts): the ids of space + text in vocabulary A and of text in vocabulary B, which adds the space, with bounds by text.

    Texts are cut at spaces and line feeds once for both; chunks come from bounded caches. Neither vocabulary merges over such a cut: A's
    split pattern doesn't, and no piece of B reaches over one (checked as the model is read; otherwise texts go whole). Texts
    with runs of white space, or with rare characters on which libraries may differ, are encoded whole.
    """

    def __init__(self, v: Vocabularies, limit: int = 250_000):
        import base64
        import os

        import sentencepiece
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(v.ranks, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        coding = tiktoken.Encoding("ranks", pat_str=v.pattern, mergeable_ranks=ranks, special_tokens={})
        library = Tokenizer.from_file(v.tokenizer)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True
        model = sentencepiece.SentencePieceProcessor(model_file=v.pieces)
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        letters = _byte_of_letter()
        vocabulary = library.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            tokens[k] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = Bytes(tokens), Bytes(spelled)
        plain = [p for k, p in enumerate(pieces) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        self.apart = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p or any(x.isalpha() and y in _MARKS for x, y in zip(p, p[1:])) for p in plain)

        def pieces_of(chunks: Sequence[str]) -> list[list[int]]:
            """A leading space is what the model adds itself; other chunks go behind a line feed, which nothing merges with."""
            found = model.encode([c[1:] if c[:1] == " " else "\n" + c for c in chunks], num_threads=1)
            return [ids if c[:1] == " " else ids[2:] for c, ids in zip(chunks, found)]

        self.a = ChunkEncoder(lambda chunks: [coding.encode_ordinary(c) for c in chunks], spaced=True, limit=limit)
        self.b = ChunkEncoder(pieces_of, spaced=True, limit=limit)
        rare = f"{_RARE}|[\\x{{10000}}-\\x{{10ffff}}]"
        self.rare, self.whole = rare, f"{_UNEVEN}|{rare}" if self.apart else ""
        self.a_rare = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        self.a_whole = lambda texts: [coding.encode_ordinary(t) for t in texts]
        self.b_whole = lambda texts: model.encode(texts, num_threads=1)

    def encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        own = pa.array(texts, pa.large_string())
        match = lambda regex: np.flatnonzero(pc.match_substring_regex(own, regex).to_numpy(zero_copy_only=False)).tolist()
        whole, rare = match(self.whole), set(match(self.rare))
        ready = [t.replace("\n", " \n") for t in texts]
        for k in whole:
            ready[k] = ""
        cut = pc.split_pattern(pa.array(ready, pa.large_string()), " ")
        offsets = np.asarray(cut.offsets, dtype=np.int64)
        coded = pc.dictionary_encode(cut.values)
        chunks = [c if c[:1] == "\n" or not c else " " + c for c in coded.dictionary.to_pylist()]
        code = np.asarray(coded.indices, dtype=np.int64)
        a_found = dict(zip(sorted(rare), self.a_rare([" " + texts[k] for k in sorted(rare)])))
        common = [k for k in whole if k not in rare]
        a_found |= dict(zip(common, self.a_whole([" " + texts[k] for k in common])))
        b_found = dict(zip(whole, self.b_whole([texts[k] for k in whole]))) if whole else {}
        return [_flat(e, chunks, code, offsets, found) for e, found in ((self.a, a_found), (self.b, b_found))]


def _flat(encoder: ChunkEncoder, chunks: list[str], code: np.ndarray, offsets: np.ndarray, whole: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts from those of their chunks, and bounds; texts in `whole` have their own."""
    one, two = encoder._codes(chunks)
    n_one = encoder.start[one + 1] - encoder.start[one]
    n_two = np.where(two < 0, 0, encoder.start[two + 1] - encoder.start[two])
    size = n_one + n_two
    runs = np.cumsum(size) - size
    own = np.empty(int(size.sum()), np.int32)
    _place(own, runs, encoder.ids, encoder.start[one], n_one)
    _place(own, runs + n_one, encoder.ids, np.where(two < 0, 0, encoder.start[two]), n_two)
    took = size[code]
    flat = own[_spread(runs[code], took)]
    bounds = np.concatenate([[0], np.cumsum(took)])[offsets]
    if whole:
        pieces, at, n = [], 0, np.diff(bounds)
        for k in sorted(whole):
            pieces += [flat[at : bounds[k]], np.asarray(whole[k], np.int32)]
            at, n[k] = bounds[k + 1], len(whole[k])
        flat = np.concatenate([*pieces, flat[at:]])
        bounds = np.concatenate([[0], np.cumsum(n)])
    return flat, bounds


def _same(ids: np.ndarray, bounds: np.ndarray, tokens: Bytes, text: np.ndarray, text_bounds: np.ndarray) -> np.ndarray:
    """Which texts are the joined bytes of their tokens."""
    ends = np.concatenate([[0], np.cumsum(tokens.size[ids])])[bounds]
    same = np.diff(ends) == np.diff(text_bounds)
    doc = np.repeat(np.arange(len(same)), np.diff(bounds))
    at = np.repeat(same, np.diff(text_bounds))
    differ = tokens.joined(ids[same[doc]]) != text[at]
    if differ.any():
        same[np.repeat(np.arange(len(same)), np.where(same, np.diff(text_bounds), 0))[differ]] = False
    return same


class Aligned(NamedTuple):
    """What a batch of texts gives: per text counts and the digest, and (text, pair, times) of the linked id pairs, sorted."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digest: list[str]
    doc: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    def __init__(self, v: Vocabularies):
        self.encoder = PairEncoder(v)
        self.n_b = len(self.encoder.b_bytes.size)
        n_a = len(self.encoder.a_bytes.size)
        self.names = [b"%d%s" % (k, end) for n, end in ((n_a, b","), (n_a, b"|"), (self.n_b, b","), (self.n_b, b";")) for k in range(n)]
        self.base = np.array([0, n_a, 2 * n_a, 2 * n_a + self.n_b])

    def __call__(self, texts: Sequence[str | None]) -> Aligned:
        """Both tokenizers cut the same bytes, so tokens are intervals end to end.

        Interval coalescing: all tokens by their start, the running maximum of the ends; a group starts where a start reaches it.
        """
        n = len(texts)
        texts = [t or "" for t in texts]
        (a, a_bounds), (b, b_bounds) = self.encoder.encode(texts)
        raw = [b" " + t.encode() if t else b"" for t in texts]
        text = np.frombuffer(b"".join(raw), np.uint8)
        text_bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, n))])
        ok = np.diff(text_bounds) > 0
        ok &= _same(a, a_bounds, self.encoder.a_bytes, text, text_bounds) & _same(b, b_bounds, self.encoder.b_bytes, text, text_bounds)
        doc_a, doc_b = (np.repeat(np.arange(n), np.diff(x)) for x in (a_bounds, b_bounds))
        a, doc_a, b, doc_b = a[ok[doc_a]].astype(np.int64), doc_a[ok[doc_a]], b[ok[doc_b]].astype(np.int64), doc_b[ok[doc_b]]
        n_a, n_b = (np.bincount(x, minlength=n) for x in (doc_a, doc_b))
        if not len(a):
            none = np.zeros(0, np.int64)
            return Aligned(n_a, n_b, n_a, n_a, [""] * n, none, none, none)
        end_a, end_b = np.cumsum(self.encoder.a_bytes.size[a]), np.cumsum(self.encoder.b_bytes.size[b])
        start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])

        start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
        order = np.lexsort((start,))
        upto = np.maximum.accumulate(end[order])
        group = np.empty(len(start), np.int64)
        group[order] = np.concatenate([[0], np.cumsum(start[order][1:] >= upto[:-1])])
        in_a, in_b = group[: len(a)], group[len(a) :]
        many_a, many_b = np.bincount(in_a), np.bincount(in_b)
        first_a = np.flatnonzero(np.diff(in_a, prepend=-1))
        n_groups = np.bincount(doc_a[first_a], minlength=n)

        lo = np.searchsorted(end_b, start_a, side="right")
        links = np.searchsorted(start_b, end_a, side="left") - lo
        n_links = np.bincount(doc_a, links, n).astype(np.int64)
        width = len(self.encoder.a_bytes.size) * self.n_b
        key = np.repeat(doc_a * width + a * self.n_b, links) + b[_spread(lo, links)]
        key, times = np.unique(key, return_counts=True)

        last_a, last_b = (np.diff(x, append=-1) != 0 for x in (in_a, in_b))
        written_out = np.empty(len(start), np.int64)
        written_out[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[in_a]] = a + self.base[last_a.astype(int)]
        written_out[np.arange(len(b)) + np.cumsum(many_a)[in_b]] = b + self.base[2 + last_b.astype(int)]
        names = list(map(self.names.__getitem__, written_out.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        digest = [hashlib.sha256(b"".join(names[at - k : at])[:-1]).hexdigest() if k else "" for at, k in zip(ends, (n_a + n_b).tolist())]
        return Aligned(n_a, n_b, n_groups, n_links, digest, key // width, key % width, times)


_kept: dict[Vocabularies, Aligner] = {}


def _aligner(v: Vocabularies) -> Aligner:
    """The worker's aligner; its caches live as long as the Python worker."""
    if v not in _kept:
        _kept[v] = Aligner(v)
    return _kept[v]


def aligned_slices(docs: DataFrame, v: Vocabularies, most: int = 2_000_000) -> DataFrame:
    """(slice, pairs, docs, rows, entries): runs of texts with about `most` (text, pair) entries.

    pairs and docs: the different id pairs of a slice (A id times B's size, plus B id) and how many of its texts hold each. rows: the
    texts with their counts and digests; entries: their pairs, as places in `pairs`, and how often each is linked.
    """

    def row(k: int, parts: list[tuple[pa.Array, Aligned]]) -> pa.RecordBatch:
        join = lambda name: np.concatenate([getattr(x, name) for _, x in parts])
        pairs, at, n = np.unique(join("pair"), return_inverse=True, return_counts=True)
        held = np.concatenate([np.bincount(x.doc, minlength=len(ids)) for ids, x in parts])
        ids = pa.concat_arrays([ids for ids, _ in parts])
        rows = pa.table({"doc_id": ids, **{c: join(c) for c in ("n_a", "n_b", "n_groups", "n_links")}, "digest": [d for _, x in parts for d in x.digest], "held": held})
        entries = pa.table({"at": at.astype(np.uint32), "times": join("times").astype(np.uint32)})
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pairs], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([packed(rows)], pa.binary()), pa.array([packed(entries)], pa.binary())], ["slice", "pairs", "docs", "rows", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, k, parts, held = _aligner(v), TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                part = align(batch.column("text").to_pylist())
                parts, held = [*parts, (batch.column("doc_id"), part)], held + len(part.pair)
                if held > most:
                    yield row(k, parts)
                    parts, held, k = [], 0, k + 1
        if parts:
            yield row(k, parts)

    return docs.mapInArrow(run, "slice long, pairs array<long>, docs array<long>, rows binary, entries binary")


def align_tokenizers(docs: DataFrame, v: Vocabularies, b_size: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of `docs`.

    Byte offsets at which tokens of A (space + text) and of B (text, B adds the space) both end cut the tokens into groups; an A and a B
    token whose bytes overlap are linked. The count of an id pair is the number of rows that hold it linked; n_best counts the links whose
    pair has the highest count of its A id (ties included), count_sum adds the counts over the links. groups_sha256 digests
    `a1,a2|b1;a3|b2,b3`. b_size: the size of vocabulary B.

    Texts are aligned once, in batches, and written by slices. Pair counts are summed inside slices before the shuffle, so a pair
    stands there once a slice; counts go back to the slices in the same way. The highest counts of A ids are broadcast: a row an id, at
    most the size of vocabulary A.

    Null and empty texts, and texts that the joined bytes of either side don't give back, have no tokens: zeros and an empty
    groups_sha256. Rows with equal or null doc_ids are rows of their own. Special-token strings are plain text. Other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = written(aligned_slices(docs, v), "aligned")
    held = parts.select("slice", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("slice", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = written(held.groupBy("pair").agg(F.sum("docs").alias("count")), "pair_counts")
    a_id = F.floor(F.col("pair") / b_size)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("most"))
    known = counts.join(F.broadcast(most), a_id == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = held.select(F.col("slice").alias("to"), "pair").join(known, "pair")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        count, best = (right.column(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("count", "best"))
        rows, entries = (unpacked(left.column(c).to_pylist()) for c in ("rows", "entries"))
        at, times = (entries.column(c).to_numpy().astype(np.int64) for c in ("at", "times"))
        bounds = np.concatenate([[0], np.cumsum(rows.column("held").to_numpy())])
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        n_best, total = summed(times * best[at]), summed(times * count[at])
        return pa.table({**{c: rows.column(c).cast(pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": n_best, "count_sum": total, "groups_sha256": rows.column("digest").cast(pa.string())})

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return parts.select("slice", "rows", "entries").groupBy("slice").cogroup(back.groupBy("to")).applyInArrow(run, out)
