"""Encoding of whole texts through a bounded cache of white-space chunks.

Both public vocabularies cut a text at white space before they merge, so the ids of a text are the ids of its chunks one
after the other. Each batch is cut and factorised by Arrow; only chunks that the cache lacks reach the tokenizer. Texts for
which the cut is not that simple (special-token strings, rare white space, runs of spaces) are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII marks that end a chunk; the apostrophe is left out, for it starts contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space beyond ASCII, and the ASCII separators on which the libraries differ (RE2).
_RARE = r"[\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = r"[ \n][ \n]|^[ \n]|[ \n]$|[\t\v\f\r]|^$|" + _RARE


class ChunkEncoder:
    """encode(texts) gives the ids of all texts as one array, and where each text starts.

    encode_many: chunks or whole texts to lists of ids. spaced: chunks carry their leading space (byte-level vocabularies);
    otherwise white space is dropped and texts are lower-cased. limit: cached chunks, after which the cache starts anew.
    special: the special-token strings of the vocabulary; texts that spell one out are encoded whole. size: of the vocabulary.
    encode_words: chunks of letters only to their ids in one array and the number of each, or None where it can't tell them apart.
    """

    def __init__(self, encode_many: Callable[[Sequence[str]], Sequence[Sequence[int]]], spaced: bool, limit: int = 250_000, special: Iterable[str] = (), size: int | None = None, encode_words: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray] | None] | None = None):
        self.encode_many, self.spaced, self.limit, self.size, self.encode_words = encode_many, spaced, limit, size, encode_words
        self.whole = "|".join([_UNEVEN if spaced else _RARE, *map(re.escape, sorted(special))])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 20, np.int32)
        self.start = np.zeros(1, np.int64)

    def _add(self, chunks: list[str]) -> None:
        words = [c for c in chunks if c.isalpha()] if self.encode_words else []
        joined = self.encode_words(words) if words else None
        rest = [c for c in chunks if not c.isalpha()] if joined else chunks
        found = self.encode_many(rest)
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(n.sum()))
        if joined:
            chunks, flat, n = rest + words, np.concatenate([flat, joined[0]]), np.concatenate([n, joined[1]])
        used, first = int(self.start[-1]), len(self.known)
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(flat)), np.int32)])
        self.ids[used : used + len(flat)] = flat
        self.start = np.concatenate([self.start, used + np.cumsum(n)])
        self.known.update(zip(chunks, range(first, first + len(chunks))))

    def _codes(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache numbers of a chunk's word and of the marks behind it, which every vocabulary here keeps apart; -1 without marks."""
        if len(self.known) > self.limit:
            self._clear()
        first, second = [], []
        for chunk in chunks:
            core = chunk.rstrip(_MARKS)
            if core != chunk and core[-1:].isalpha():
                first.append(core)
                second.append(chunk[len(core) :])
            else:
                first.append(chunk)
                second.append(None)
        marks = set(second) - {None}
        if new := sorted((set(first) | marks).difference(self.known)):
            self._add(new)
        tail = {m: self.known[m] for m in marks} | {None: -1}
        return np.fromiter(map(self.known.__getitem__, first), np.int64, len(first)), np.fromiter(map(tail.__getitem__, second), np.int64, len(second))

    def _plain(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Texts made ready to be cut at spaces, and the numbers of those that have to be encoded whole."""
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.whole)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if self.spaced:
            ready = [("\n" + t).replace("\n", " \n")[1:] for t in texts]
        else:
            ready = [t.lower() if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        for k in whole:
            ready[k] = ""
        return ready, whole

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in texts]
        ready, whole = self._plain(texts)
        ready = pa.array(ready, pa.large_string())
        cut = pc.split_pattern(ready, " ") if self.spaced else pc.ascii_split_whitespace(ready)
        offsets = np.asarray(cut.offsets, dtype=np.int64)
        coded = pc.dictionary_encode(cut.values)
        chunks = coded.dictionary.to_pylist()
        if self.spaced:
            chunks = [c if c[:1] == "\n" or not c else " " + c for c in chunks]
        one, two = self._codes(chunks)
        n_one = self.start[one + 1] - self.start[one]
        n_two = np.where(two < 0, 0, self.start[two + 1] - self.start[two])
        # the ids of this batch's chunks, each as one run
        size = n_one + n_two
        runs = np.cumsum(size) - size
        own = np.empty(int(size.sum()), np.int32)
        _place(own, runs, self.ids, self.start[one], n_one)
        _place(own, runs + n_one, self.ids, np.where(two < 0, 0, self.start[two]), n_two)
        code = np.asarray(coded.indices, dtype=np.int64)
        took = size[code]
        ends = np.concatenate([[0], np.cumsum(took)])
        flat = own[_spread(runs[code], took)]
        bounds = ends[offsets]
        if self.spaced:  # the line feed set before each text
            keep = np.ones(len(flat), bool)
            simple = np.ones(len(texts), bool)
            simple[whole] = False
            keep[bounds[:-1][simple]] = False
            gone = np.cumsum(simple)
            flat, bounds = flat[keep], bounds - np.concatenate([[0], gone])
        if whole:
            found, pieces, at = self.encode_many([texts[k] for k in whole]), [], 0
            n = np.diff(bounds)
            for k, ids in zip(whole, found):
                pieces += [flat[at : bounds[k]], np.asarray(ids, np.int32)]
                at, n[k] = bounds[k], len(ids)
            flat = np.concatenate([*pieces, flat[at:]])
            bounds = np.concatenate([[0], np.cumsum(n)])
        return flat, bounds


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _place(into: np.ndarray, at: np.ndarray, source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    into[_spread(at, lengths)] = source[_spread(starts, lengths)]


def library_encoder(path: str, spaced: bool, limit: int = 250_000) -> ChunkEncoder:
    """A ChunkEncoder on the tokenizers library; one thread, for Spark runs a task a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    size = tok.get_vocab_size(with_added_tokens=True)
    many = lambda x: [e.ids for e in tok.encode_batch_fast(list(x), add_special_tokens=False)]
    suffix = json.loads(tok.to_str())["model"].get("end_of_word_suffix")
    last = np.zeros(size, bool)
    last[[i for token, i in tok.get_vocab().items() if suffix and token.endswith(suffix)]] = True

    def words(chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Words go to the library by the line, 500 at a time; the id that carries the word-end suffix is the last of its word."""
        flat = np.concatenate([np.asarray(ids, np.int32) for ids in many(["\n".join(chunks[at : at + 500]) for at in range(0, len(chunks), 500)])])
        ends = np.flatnonzero(last[flat])
        return (flat, np.diff(ends, prepend=-1)) if len(ends) == len(chunks) and ends[-1] == len(flat) - 1 else None

    return ChunkEncoder(many, spaced, limit, special, size, words if suffix and not spaced else None)


_kept: dict[tuple, ChunkEncoder] = {}


def kept_encoder(path: str, spaced: bool, limit: int) -> ChunkEncoder:
    """The worker's encoder for a vocabulary; its cache lives as long as the Python worker."""
    if (path, spaced) not in _kept:
        _kept[path, spaced] = library_encoder(path, spaced, limit)
    return _kept[path, spaced]
