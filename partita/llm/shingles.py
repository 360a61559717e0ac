"""Word shingles, their sets and minhash signatures, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text (ASCII letters lower-cased, ASCII white space between), and bounds."""
    import xxhash

    # an array of its own: Arrow's ascii_lower misreads the offsets of slices
    low = pc.ascii_lower(pa.array([t or "" for t in texts.to_pylist()], pa.large_string()))
    cut = pc.ascii_split_whitespace(low)
    coded = pc.dictionary_encode(cut.values)
    words = coded.dictionary.to_pylist()
    value = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    code = np.asarray(coded.indices, dtype=np.int64)
    offsets = np.asarray(cut.offsets, dtype=np.int64)
    if "" in words:
        full = code != words.index("")
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        code = code[full]
    return value[code], offsets


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    h, offsets = word_hashes(texts)
    n = len(h)
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, n - words + 1), np.uint64)
        for k in range(words):
            run = mixed(run ^ h[k : k + len(run)])
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= words:
                yield np.unique(run[a : b - words + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for x in h[a:b]:
                    short = mixed(short ^ x)
                yield short
            else:
                yield np.empty(0, np.uint64)


class MinHash:
    """Signatures of `length` minhashes, each cut to 16 bits."""

    def __init__(self, length: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 63, length, dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.xor), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(hashes), 2048):  # stays in the processor's cache
                part = hashes[at : at + 2048]
                for k in range(len(low)):
                    low[k] = min(low[k], ((part ^ self.xor[k]) * self.mul[k]).min())
            return (mixed(low) >> np.uint64(48)).astype(np.uint16)
