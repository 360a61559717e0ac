"""The corpus operators against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from partita.llm import ann, bpe, components, encoding, licenses, line_dedup, mips, near_dedup, packing, quality, repair, sharding

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "Hello  World <|endoftext|> x'S it's 12 don't!!\n\n a_b ΑΣ İ ﬁ é", "", None, "   ", "<|startoftext|>foo<|ENDOFTEXT|>", "😀a​b\x00c\x85d　e", "\na b\n", "a\nb c.d, e!!\n'tis x'll. y’s  ",
    "tab\tx", "é Σας ΟΔΟΣ", "x\x1cy z\x1f", "½ Ⅷ² 12a3 b4.", " lead", "trail ", "a\n\nb", "a \nb", "'s", "x's.", "--- a--- é... ü!?", "same same same", "same same same", "long " * 3000,
]


def tok(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(ODD)] + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, size int").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("path, spaced", [(WORD, False), (BYTE, True)])
def test_chunked_encoding_equals_the_library(path, spaced):
    texts = [t or "" for t in ODD]
    ids, bounds = encoding.library_encoder(path, spaced, limit=5).encode(texts)
    want = [e.ids for e in tok(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


def test_op2_round_trip(docs):
    got, t = by_id(bpe.bpe_round_trip(docs, WORD, keep_ids=True)), tok(WORD)
    for i, text in enumerate(ODD):
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert None in got and bpe.bpe_round_trip(docs.limit(0), WORD).count() == 0


def test_op3_files_round_trip(docs):
    t, at = tok(WORD), 0
    rows = {r.doc_id: r for r in repair.read_shards(_shards(docs), keep_ids=True).collect()}
    for i in [None, *range(len(ODD))]:
        ids = t.encode("no id" if i is None else ODD[i] or "", add_special_tokens=False).ids + [1]
        r = rows[i]
        assert (r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert repair.token_files(docs.limit(0), WORD).count() == 0


def _shards(docs):
    from partita.llm.common import shared_folder

    path = shared_folder(docs.sparkSession, "shards")
    repair.write_shards(docs, WORD, path, shard_tokens=50)
    return docs.sparkSession.read.parquet(path)


def test_grammar_gives_every_document_back():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 50, 40)
    parts = [np.concatenate([base, rng.integers(0, 50, n)]) for n in (0, 1, 5, 90)] * 20
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    shard = repair.Shard.from_bytes(repair.compress(list(range(len(parts))), np.concatenate(parts), starts, 50, least=4).to_bytes())
    assert len(shard.rules) and len(shard.symbols) < 0.7 * starts[-1]
    assert all((shard.document(k) == p).all() for k, p in enumerate(parts))
    flat, found = shard.documents()
    assert (flat == np.concatenate(parts)).all() and (found == starts).all()


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 40, 300)
    parts = [text] * 200 + [np.concatenate([np.full(n, 3), rng.integers(0, 40, 7)]) for n in range(400)] + [np.empty(0, int)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    shard = repair.compress(list(range(len(parts))), np.concatenate(parts), starts, 50)
    seen = Counter()
    for a, b in zip(shard.starts[:-1], shard.starts[1:]):
        row, last = shard.symbols[a:b].tolist(), None
        for k, pair in enumerate(zip(row, row[1:])):
            if pair[0] != pair[1] or last != k - 1:  # pairs of one symbol from the left, without overlap
                seen[pair] += 1
                last = k if pair[0] == pair[1] else None
            else:
                last = None
    assert max(seen.values()) < 9 and len(shard.rules) + 50 < 1 << 16
    assert shard.lengths.max() >= 300 and all((shard.document(k) == p).all() for k, p in enumerate(parts))


def test_grammar_of_runs_and_periods():
    """One id a hundred thousand times, and a period of 64, shrink to a few symbols; ids beyond the vocabulary raise."""
    for ids in (np.full(100_000, 7), np.tile(np.arange(64), 2_000)):
        shard = repair.Shard.from_bytes(repair.compress([1], ids, np.array([0, len(ids)]), 100).to_bytes())
        assert len(shard.symbols) < 40 and (shard.document(0) == ids).all()
    with pytest.raises(ValueError):
        repair.compress([1], np.array([5, 100]), np.array([0, 2]), 100)


def test_special_strings_of_any_vocabulary(tmp_path):
    """Special-token strings that start otherwise than usual are found as well."""
    t = Tokenizer.from_file(WORD)
    t.add_special_tokens(["[MASK]"])
    t.save(str(tmp_path / "t.json"))
    texts = ["plain words", "one [MASK] two", "[MASK]", "x[MASK]y <|endoftext|>"]
    want = [e.ids for e in tok(str(tmp_path / "t.json")).encode_batch(texts, add_special_tokens=False)]
    ids, bounds = encoding.library_encoder(str(tmp_path / "t.json"), False).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    _, own = bpe._kept_bpe(str(tmp_path / "t.json"))
    ids, bounds = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


def test_op6_pieces_cover_every_id_once(docs):
    t = tok(BYTE)
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i in [None, *range(len(ODD))]:
        ids, at = t.encode("no id" if i is None else ODD[i] or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_op7_against_python(spark):
    space = " \t\n\x0b\x0c\r"
    texts = ["Same Line\nown %d\n\n  same LINE\t\nÉ" % i for i in range(12)] + [None, "", "é", "\n", "same line"] * 2
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(space))
    counts = Counter(k for t in texts for k in {low(x) for x in (t or "").split("\n")})
    got = by_id(line_dedup.dedup_lines(docs, 10))
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (low(x) and counts[low(x)] >= 10)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_op7_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a\nb")] * 20 + [(None, "a\nb")], "doc_id long, text string")
    assert {r.text for r in line_dedup.dedup_lines(docs, 3).collect()} == {"a\nb"}
    assert {r.text for r in line_dedup.dedup_lines(docs, 2).collect()} == {""}


def test_op8_held_out_accuracy(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{n}.parquet") for n in ("documents", "labels"))
    s = quality.score_quality(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    right = [(r.quality_score >= 0.3) == (r.quality == 1) for r in s]
    assert len(right) > 40 and np.mean(right) > 0.95


def test_op8_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in quality.score_quality(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(3, None), (1, 1), (2, 0), (2, 1), (99, 1)], "doc_id long, quality int")
    rows = quality.score_quality(docs.withColumn("quality_score", F.lit("x")), some).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.quality_score <= 1 for r in rows)


def components_of(texts, words, least):
    """All pairs, by hand."""
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= least * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    out = ["", None, "   ", "a b", "A  b", "a b c", "x"]
    for n in (12, 60, 200):
        base = list(rng.choice(words, n))
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12):
            t = list(base)
            for at in rng.choice(n, min(edits, n), replace=False):
                t[at] = str(rng.choice(words))
            out.append(" ".join(t))
    hot = list(rng.choice(words, 80))
    for i in range(120):  # a crowd of copies, some too far apart
        t = list(hot)
        for at in rng.choice(80, int(rng.integers(0, 6)), replace=False):
            t[at] = f"q{i}{at}"
        out.append(" ".join(t))
    return out


def test_op9_against_all_pairs(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(5)
    for words, few in ((4, 1), (5, 16)):
        n, want = components_of(texts, words, 80)
        got = by_id(near_dedup.near_duplicates(docs, words=words, leaders=1, few=few, block=16))
        assert [got[i].n_shingles for i in range(len(texts))] == n
        assert [got[i].component_id for i in range(len(texts))] == want
        assert all(got[i].kept == (got[i].component_id == i) for i in range(len(texts)))


def planted(rng, length, distance, spread):
    """Two signatures that differ in `distance` positions: spread evenly over the chunks (the worst case), or anywhere."""
    a = rng.integers(0, 1 << 16, length, dtype=np.uint16)
    order = np.arange(length).reshape(-1, 4).T.ravel() if spread else rng.permutation(length)
    b = a.copy()
    b[order[:distance]] ^= np.uint16(1)
    return a, b


def test_op9_guarantee(spark):
    """Every pair within the distance shares a key, and the first shared one is told right; a farther pair may share none."""
    rng, chunks = np.random.default_rng(3), near_dedup.Chunks(40, 4, 1)
    assert chunks.guaranteed == 19
    for distance in range(20):
        for spread in (True, False, False, False):
            a, b = planted(rng, 40, distance, spread)
            x, y = chunks.keys(np.stack([a, b]))
            assert (x == y).any() and chunks.first_slot((a != b)[None])[0] == (x == y).argmax()
    a, b = planted(rng, 40, 20, True)
    assert not np.equal(*chunks.keys(np.stack([a, b]))).any() and chunks.first_slot((a != b)[None])[0] == -1
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), distance=20)


def test_op9_cross_pairs_are_all_pairs_within_the_distance(spark):
    """Pairs at every distance, in components of their own and in blocks of a few rows: those within 19 come out, once each."""
    rng, rows, want, n = np.random.default_rng(4), [], set(), 0
    full = np.packbits(np.ones(near_dedup.SKETCH, np.uint8)).tobytes()
    for distance in range(24):
        for spread in (True, False):
            for sign in planted(rng, 40, distance, spread):
                rows.append((n, 10, sign.tobytes(), full))
                n += 1
            if distance <= 19:
                want.add((n - 2, n - 1))
    crowd = rng.integers(0, 1 << 16, 40, dtype=np.uint16)
    for k in range(30):  # thirty in one bucket, all within the distance
        sign = crowd.copy()
        sign[k % 8] ^= np.uint16(k + 1)
        rows.append((n + k, 10, sign.tobytes(), full))
    want |= {(n + i, n + j) for i in range(30) for j in range(i + 1, 30)} - {(n, n + 1)}
    reps, chunks = spark.createDataFrame(rows, "id long, n long, signature binary, sketch binary").repartition(3), near_dedup.Chunks(40, 4, 1)
    found = spark.createDataFrame([(n, n), (n + 1, n)], "node long, component long")
    blocks = near_dedup._blocks(near_dedup.bucket_rows(reps, chunks), found, reps, 7)
    got = [(r.a, r.b) for r in near_dedup._cross_pairs(blocks, chunks, 19, 80, None).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_op9_sketch_bound_never_excludes_a_similar_pair():
    rng = np.random.default_rng(5)
    for n in (1, 5, 50, 3000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            b = np.union1d(rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.6, 1)))], rng.integers(0, 1 << 62, int(n * rng.uniform(0, 0.2)), dtype=np.uint64))
            common = len(np.intersect1d(a, b))
            x, y = (np.frombuffer(near_dedup.sketch(s), np.uint64)[None] for s in (a, b))
            possible = near_dedup._possible(np.array([len(a)]), np.array([len(b)]), x, y, 80)[0]
            assert possible or 100 * common < 80 * (len(a) + len(b) - common)


def test_op9_edges(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d e f g")] * 3 + [(5, "other words stand here now")] + [(9, "other words stand here now"), (None, "a b c d e f g"), (7, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 7 and {(r.doc_id, r.component_id) for r in got} == {(5, 5), (9, 5), (None, None), (7, 7)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (3, 3), (8, 8)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 70: 50, 100: 50}


def test_op10_law(spark, docs):
    rows = sharding.shard_records(docs, [1.0] * 8).collect()
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    for r in rows:
        t = ("no id" if r.doc_id is None else ODD[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 1, zlib.crc32(t), "key")
    assert sharding.shard_records(docs.limit(0), [1.0]).count() == 0


def test_op10_weights_and_moves(spark):
    ids = spark.range(20000)
    n = Counter(r.s for r in ids.select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).collect())
    assert 0.72 < n[1] / 20000 < 0.78
    moved = ids.where(sharding.rendezvous(F.col("id"), [1.0] * 8) != sharding.rendezvous(F.col("id"), [1.0] * 9)).count()
    assert 0.09 < moved / 20000 < 0.13


VECTORS = "vec_id long, embedding array<float>, score string"


def vector_rows(n=600, dims=12):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=dims)], "s") for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, same, "s") for i in range(60)]
    rows += [(2000, None, None), (2050, [0.0] * dims, None), (2100, [float("nan")] + [1.0] * (dims - 1), None), (2150, [None] + [1.0] * (dims - 1), None), (2200, [float("inf")] + [1.0] * (dims - 1), None)]
    return rows


def test_op1_recall(spark):
    rows = vector_rows()
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, VECTORS).repartition(4), lambda v: v % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids = np.array([i for i, *_ in rows if i < 2000])
    x = np.array([v for i, v, _ in rows if i < 2000], np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        s = np.round(u @ u[ids == q][0], 12)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        hit += len({int(ids[k]) for k in order} & {v for v, _ in found})
        total += 5
        assert all(abs(score - s[ids == v][0]) < 1e-9 for v, score in found) and len(found) == 5
    assert hit / total >= 0.9
    empty = spark.createDataFrame([], VECTORS)
    assert ann.nearest(empty, lambda v: v % 50 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:3], VECTORS), lambda v: v == 0).count() == 2


def test_op1_graph_converges_from_a_poor_start(spark):
    x = np.random.default_rng(5).normal(size=(3000, 12))
    packed = ann._packed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")).cache()
    cells = ann._cells(packed, 3000, 16, 1, pivots=4)
    assert cells.count() == 3000 and cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 64
    found = defaultdict(set)
    for r in ann.nn_descent(packed, block=16, starts=2).collect():
        found[r.id].add(r.nbr)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    want = np.argsort(-sims, axis=1)[:, :10]
    assert np.mean([len(found[i] & set(want[i].tolist())) / 10 for i in range(3000)]) > 0.95


def test_op1_recall_with_more_nodes_than_entries(spark):
    x = np.random.default_rng(6).normal(size=(3000, 12)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], VECTORS).repartition(4)
    got = defaultdict(set)
    for r in ann.nearest(table, lambda v: v % 50 == 0, 5, block=64, entries=16, ef=48).collect():
        got[r.query_id].add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.mean([len(got[q] & {int(i) for i in np.argsort(-(u @ u[q]))[:6]}) / 5 for q in range(0, 3000, 50)]) >= 0.9


def test_op1_settles_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(200, 12)), rng.normal(size=12) + 1e-4 * rng.normal(size=(500, 12))]).astype(np.float32)
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], VECTORS).repartition(4), lambda v: v % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(200, 700, 50):
        assert got[q] == [i for i in np.argsort(((u - u[q]) ** 2).sum(axis=1)) if i != q][:5]


def test_op5_is_exact(spark):
    rows = vector_rows() + [(2300, [0.0] * 12, None)]
    got = [tuple(r) for r in mips.top_products(spark.createDataFrame(rows, VECTORS).repartition(4), lambda v: v % 100 == 0, 10, block=50).orderBy("query_id", "rank").collect()]
    ok = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(np.int64)) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in ok:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert mips.top_products(spark.createDataFrame([], VECTORS), lambda v: v % 100 == 0).count() == 0


def test_op4_spans(spark):
    t = ["x " * 30 + "Released under the MIT license. y", "This work is (licensed) under the  GNU General Public License, version three.", "all rights", None, "", "All Rights Reserved; all rights reserved", "released under an MIT License"]
    rows = licenses.scan_licenses(spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.license, t[r.doc_id][r.start : r.stop]) for r in rows)
    assert got == [(0, "mit", "Released under the MIT license."), (1, "gpl-3.0", "This work is (licensed) under the  GNU General Public License, version"), (5, "all-rights-reserved", "All Rights Reserved;"), (5, "all-rights-reserved", "all rights reserved")]
    assert all(r.coverage >= 0.8 for r in rows)


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, data), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    pieces = corpus_pipeline.packing_stage(spark, docs, data)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
