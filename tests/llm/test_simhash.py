"""SimHash duplicates against plain Python: fingerprints, links at every distance, long and dense lists, awkward rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from partita.llm import simhash


def plain_fingerprint(text, words):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, distance):
    """The least place that links reach, for every place."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def near(rng, n, centres):
    """Fingerprints around some centres, one to five bits away."""
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = list(base)
    while len(out) < n:
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        out.append(x)
    return out


TEXTS = ["", None, "  \t\n", "One", "one TWO", "one two three four", "One  two\tthree\nfour", "É é İ x", "a b c " * 400, "ab\x0bcd\x0cef gh", "x\x1cy z q", "nb sp is one word", "w" * 70_000 + " end of it"]


@pytest.mark.parametrize("words", [1, 3, 5])
def test_fingerprints(words):
    rng = random.Random(words)
    texts = TEXTS + [" ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(1, 60))) for _ in range(30)]
    assert [simhash.fingerprint(t, words, 42) for t in texts] == [plain_fingerprint(t, words) for t in texts]


def test_words_across_blocks():
    data = b"ab  cd\tef " * 50
    assert [w for part in simhash._words(data, block=7) for w in part] == data.split()


@pytest.mark.parametrize("most", [2048, 3])
def test_links_equal_all_pairs(spark, most, monkeypatch):
    rng = random.Random(most)
    fps = list(dict.fromkeys(near(rng, 400, 40)))
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words, seed: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    rows = [(i, str(np.uint64(x).view(np.int64))) for i, x in enumerate(fps)]
    got = {r.doc_id: r.component_id for r in simhash.simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    assert [got[i] for i in range(len(fps))] == components(fps, 3)


def test_every_pair_within_the_distance_meets(spark):
    rng, rows = random.Random(1), []
    for k in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        rows += [(k, x) for x in (a, b)]
    fps = spark.createDataFrame([(k, int(np.uint64(x).view(np.int64))) for k, x in rows], "k int, fp long")
    for lists in (simhash.postings(fps, 5, 3), simhash.longer_postings(simhash.postings(fps, 5, 3), 5, 3)):
        pairs = lists.join(fps, "fp").groupBy("key", "k").agg(F.countDistinct("fp").alias("n")).where("n = 2").select("k").distinct()
        assert pairs.count() == 300


def test_dense_lists_look_up_what_pairs_find():
    rng = random.Random(5)
    fps = np.array(sorted({rng.getrandbits(12) | rng.getrandbits(8) << 50 for _ in range(300)}), np.uint64)
    a, b = simhash.dense_links(fps, 3)
    label = {int(x): int(x) for x in fps} | {int(x): int(y) for x, y in zip(a, b)}
    want = components([int(x) for x in fps], 3)
    assert [label[int(x)] for x in fps] == [int(fps[w]) for w in want]


def test_rows_that_are_awkward(spark):
    same = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(7, same), (3, same), (3, same), (None, same), (5, ""), (2, None), (9, " "), (None, "alone and odd"), (11, "one other text entirely of its own")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_duplicates(df, words=3).collect()), key=str)
    want = [(i, f"{plain_fingerprint(t, 3):016x}", 3 if t == same else 2 if not (t or "").strip() else i) for i, t in rows]
    assert got == sorted(want, key=str)
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_duplicates(df, distance=7, lead=3)
