"""Corpus operators and pipeline stages against plain Python on small tables."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from partita.llm import licenses, line_dedup, mips, packing, quality, sharding
from tests.llm.test_llm import components_of, near_texts

SCHEMA = "doc_id long, text string, n_lines int, n_dropped int, quality_score double, turn string, n_chars long"


def frame(spark, texts, ids=None):
    """A table with extra columns whose names the operators use themselves."""
    rows = [(i, t, -1, -2, -3.0, "t", -4) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# op4


def banded(text, template, diagonal, band):
    """The longest common subsequence whose matches lie within `band` of a diagonal, and all (first, last) that reach it."""
    best = {}  # (j, i) matched last: (matches, first)
    top = (0, None, None)
    for j, want in enumerate(template):
        for i in range(max(0, diagonal + j - band), min(len(text), diagonal + j + band + 1)):
            if text[i] == want:
                before = [(m, f) for (jj, ii), (m, f) in best.items() if jj < j and ii < i]
                m, f = max(before, default=(0, None), key=lambda c: (c[0], -1 if c[1] is None else c[1]))
                best[j, i] = (m + 1, i if f is None else f)
    for (j, i), (m, f) in best.items():
        top = max(top, (m, f, i), key=lambda c: (c[0], -9 if c[1] is None else c[1] - c[2]))
    return top


def test_op4_against_alignment_everywhere():
    """Every template at every diagonal, without an index: the same texts get the same licenses, with as many words matched."""
    rng = np.random.default_rng(2)
    templates = {"a": "one two three four five six seven eight nine ten", "b": "red green blue", "c": "go"}
    scanner = licenses.Scanner(templates)
    for _ in range(60):
        words = [str(w) for w in rng.choice(["x", "y", "red", "two", "z"], 12)]
        name = "abc"[int(rng.integers(0, 3))]
        copy = templates[name].split()
        for _ in range(int(rng.integers(0, 3)) if name == "a" else 0):
            at = int(rng.integers(0, len(copy)))
            copy[at : at + 1] = [[], ["q"], [copy[at], "q"]][int(rng.integers(0, 3))]
        at = int(rng.integers(0, 12))
        words[at:at] = copy
        codes = [scanner.number.get(w, 0) for w in words]
        got = Counter((scanner.names[t], m) for t, m, _, _ in scanner.scan(np.array(codes)))
        for t, template in enumerate(scanner.codes):
            found = [banded(codes, template, d, scanner.band) for d in range(-len(template), len(codes))]
            good = [c for c in found if c[0] >= scanner.coverage * len(template)]
            kept = []
            for m, first, last in sorted(set(good), key=lambda c: (-c[0], c[1])):
                if all(last < f or first > z for _, f, z in kept):
                    kept.append((m, first, last))
            mine = sorted(m for (n, m), k in got.items() for _ in range(k) if n == scanner.names[t])
            assert len(mine) <= len(kept) and max(mine, default=0) <= max((m for m, _, _ in kept), default=0)
            if scanner.names[t] == name and templates[name] in " ".join(words):
                assert len(template) in mine  # an unchanged copy is always found, whole
            if not kept:
                assert not mine


def test_op4_awkward_rows(spark):
    mit = licenses.TEMPLATES["mit-text"]
    rows = [(None, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (2, "word " * 20000 + mit + " word" * 20000, "x"), (3, "all rights reserved " * 3000, "x"), (4, "go", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.scan_licenses(docs).collect()
    assert Counter(r.doc_id for r in got if r.license == "mit") == {None: 1, 1: 2}
    whole = [r for r in got if r.license == "mit-text"]
    assert [(r.doc_id, r.coverage) for r in whole] == [(2, 1.0)] and rows[3][1][whole[0].start : whole[0].stop] == mit
    assert sum(r.license == "all-rights-reserved" and r.doc_id == 3 for r in got) == 3000
    assert [(r.doc_id, r.license, r.start, r.stop) for r in licenses.scan_licenses(docs, {"g": "Go!", "none": "..."}).collect()] == [(4, "g", 0, 2)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


# op8


def features(text, bits):
    """Feature numbers, a word at a time."""
    words = (text or "").split()
    core = [zlib.crc32(w.strip(quality._MARKS).lower().encode(), 1) for w in words]
    look = [zlib.crc32(quality._look(w).encode(), 2) for w in words]
    out, low = [], 0xFFFFFFFF
    for k, w in enumerate(words):
        if k == 0:
            pair, form = core[0] ^ 0xC2B2AE3D, look[0] ^ 0x27D4EB2F
        else:
            pair = 0x5BD1E995 if w == words[k - 1] else ((core[k - 1] * 0x9E3779B1) & low) ^ core[k]
            form = ((look[k - 1] * 0x85EBCA77) & low) ^ look[k]
        out += [core[k], look[k], pair, form]
    return [((f * 0x2C1B3C6D) & low) >> (32 - bits) for f in out]


def plain_scores(texts, labels, s):
    """One shard of follow-the-regularised-leader, a weight at a time, and the dot products."""
    z, n = Counter(), Counter()

    def weight(f):
        return 0.0 if abs(z[f]) <= s.l1 else -(z[f] - math.copysign(s.l1, z[f])) / ((s.beta + math.sqrt(n[f])) / s.alpha + s.l2)

    ids, turn = sorted(labels), np.random.default_rng(1)
    for _ in range(s.epochs):
        for k in turn.permutation(len(ids)):
            fs = features(texts[ids[k]], s.bits)
            x = {f: c * s.scale / max(1, len(fs)) for f, c in Counter(fs).items()} | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - labels[ids[k]]) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * w[f]
                n[f] += g * g
    out = []
    for t in texts:
        fs = features(t, s.bits)
        out.append(1 / (1 + math.exp(-(weight("bias") + sum(weight(f) for f in fs) * s.scale / max(1, len(fs))))))
    return out


def labelled():
    rng = np.random.default_rng(4)
    good, bad = ["The", "house", "stands", "near", "river,", "quietly."], ["BUY", "now!!!", "cheap", "$$$", "click", "click"]
    texts = [" ".join(rng.choice(good if i % 2 else bad, int(rng.integers(1, 30)))) for i in range(60)] + ["", None, "   ", "word " * 5000]
    labels = {i: i % 2 for i in range(50) if zlib.crc32(str(i).encode()) % 5}
    return texts, labels


def test_op8_against_plain_python(spark):
    texts, labels = labelled()
    table = spark.createDataFrame([(i, q) for i, q in labels.items()], "doc_id long, quality int")
    s = quality.Settings(bits=14, shards=1)
    got = {r.doc_id: r.quality_score for r in quality.score_quality(frame(spark, texts), table, s).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], plain_scores(texts, labels, s), atol=1e-5)


def test_op8_repeated_rows_and_empty_table(spark):
    texts, labels = labelled()
    table = spark.createDataFrame([(i, q) for i, q in labels.items()], "doc_id long, quality int")
    docs = frame(spark, texts)
    twice = quality.score_quality(docs.union(docs), table).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("quality_score").alias("scores")).collect()
    assert all((r.n, r.scores) == (2, 1) for r in twice) and len(twice) == len(texts)
    assert quality.score_quality(docs.limit(0), table).count() == 0


# op10


def test_op10_shards_are_the_recomputed_draws(spark):
    ids = [*range(300), None, 7, 7]
    docs = spark.createDataFrame([(i, "t", 1) for i in ids], "doc_id long, text string, shard int")
    weights = [1.0, 2.0, 0.5]

    def shard(key, ws):
        h = xxhash.xxh64_intdigest(("null" if key is None else str(key)).encode(), seed=42)
        u = [((xxhash.xxh64_intdigest(struct.pack("<i", s), seed=h) & ((1 << 53) - 1)) + 0.5) / 2**53 for s in range(len(ws))]
        return min(range(len(ws)), key=lambda s: -math.log(u[s]) / ws[s])

    rows = sharding.shard_records(docs, weights, 1.5).collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    assert all(r.shard == shard(r.doc_id, weights) and r.grown_shard == shard(r.doc_id, [*weights, 1.5]) for r in rows)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


# op5, op7


def test_op5_products_beyond_64_bits_raise(spark):
    rows = [(100, [3e15, 1.0]), (1, [3e15, 1.0])]
    with pytest.raises(Exception, match="(?i)overflow|too large|too big|int"):
        mips.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 100 == 0).collect()
    null = spark.createDataFrame([(None, [1.0]), (100, [2.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in mips.top_products(null, lambda v: v % 100 == 0).collect()] == [(100, 1, 3, 2 << 20)]


def plain_lines(texts, ids, least):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    docs = {}
    for i, t in zip(ids, texts):
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    gone = {k for k, v in docs.items() if k and len(v) >= least}
    return ["\n".join(line for line in (t or "").split("\n") if key(line) not in gone) for t in texts]


def test_op7_long_texts_and_repeats(spark):
    texts = [f"Menu \nbody {i}\n\n MENU\t" for i in range(12)] + ["menu\n" * 20000 + "end", None, "", "Äpfel\nÄPFEL"]
    ids = [*range(12), 20, 21, 22, 23]
    docs = frame(spark, texts, ids)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, 10).collect()}
    assert [got[i] for i in ids] == plain_lines(texts, ids, 10)
    kept = line_dedup.dedup_lines(docs, 10, counts=("a", "b"))
    assert kept.columns == [*docs.columns, "a", "b"] and kept.where("n_lines <> -1").count() == 0


# op6


def test_op6_tiers_and_step_groups(spark):
    import public_tokenizers

    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"], int(n))) for n in rng.integers(1, 900, 200)] + [None, "", "word " * 4000]
    pieces = packing.pack_documents(frame(spark, texts).coalesce(1), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, step_tokens=4096).collect()
    size = Counter()
    for p in pieces:
        size[p.sequence_id] += p.length
    tier = {p.sequence_id: p.tier for p in pieces}
    assert all(size[s] == t and t & (t - 1) == 0 and t <= 1024 for s, t in tier.items())
    assert {512, 1024} <= set(tier.values()) and len({(p.tier, p.step_group) for p in pieces}) == len({p.step_group for p in pieces})
    groups = Counter((p.tier, p.step_group) for p in {(p.sequence_id, p.tier, p.step_group): p for p in pieces}.values())
    for t in (256, 512, 1024):  # all groups of a tier but its last hold the same number of windows
        counts = [n for (tt, _), n in sorted(groups.items()) if tt == t]
        assert all(n == max(1, 4096 // t) for n in counts[:-1])
    assert packing.pack_documents(frame(spark, texts).limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# pipeline


def awkward():
    texts, _ = labelled()
    texts = texts + near_texts()[:40] + ["shared line\nown %d" % i for i in range(11)]
    return texts


def test_quality_stage_keeps_what_the_plain_classifier_keeps(spark, tmp_path):
    import corpus_pipeline

    texts, labels = labelled()
    spark.createDataFrame([(i, q) for i, q in labels.items()], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [*texts, "BUY now!!! cheap"], [*range(len(texts)), None])
    out = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.where("quality_score <> -3.0").count() == 0
    s = quality.Settings(shards=1)
    want = plain_scores(texts, labels, s)
    far = {i for i, p in enumerate(want) if abs(p - s.threshold) > 0.25}  # four averaged shards may differ near the threshold
    got = {r.doc_id for r in out.collect()}
    assert {i for i in far if want[i] >= s.threshold} == got & far
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_lines_stage_equals_plain_python(spark):
    import corpus_pipeline

    texts = awkward()
    docs = frame(spark, texts)
    rows = corpus_pipeline.lines_stage(spark, docs, "").collect()
    want = plain_lines(texts, range(len(texts)), 10)
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(want))
    assert all(r.n_chars == len(r.text) and (r.n_lines, r.n_dropped) == (-1, -2) for r in rows)
    assert corpus_pipeline.lines_stage(spark, docs.limit(0), "").count() == 0


def test_near_copies_stage_equals_all_pairs(spark):
    import corpus_pipeline

    texts = [t for t in near_texts()[:70]]
    docs = frame(spark, texts).union(frame(spark, ["no id", "no id", texts[8]], [None, None, None])).union(frame(spark, [texts[9]], [9]))
    out = corpus_pipeline.near_copies_stage(spark, docs, "")
    _, component = components_of(texts, 5, 80)
    got = Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns and got == Counter({i: 1 for i, c in enumerate(component) if c == i}) + Counter({None: 3})
    assert corpus_pipeline.near_copies_stage(spark, docs.limit(0), "").count() == 0


def test_packing_stage_holds_every_id_once(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = awkward()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for p in corpus_pipeline.packing_stage(spark, frame(spark, texts), "").collect():
        pieces.setdefault(p.doc_id, []).append(p)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and own[-1].start + own[-1].length == len(ids)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in own)
    assert corpus_pipeline.packing_stage(spark, frame(spark, texts).limit(0), "").count() == 0
