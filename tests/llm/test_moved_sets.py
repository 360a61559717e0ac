"""What near-duplicate search moves: keys of buckets, sets of pairs, and in its last pass only components that are still in doubt."""

from __future__ import annotations

import numpy as np

from partita.llm import near_dedup


def edited(rng, words, edits):
    out = list(words)
    for at in np.linspace(5, len(words) - 10, edits).astype(int):
        out[at] = f"e{rng.integers(0, 1 << 40):x}"
    return out


def test_last_pass_takes_doubtful_components_only(spark, monkeypatch):
    """Two groups of three with nine pairs too far apart stay in doubt at `few` = 1; two documents with one such pair don't."""
    rng = np.random.default_rng(11)
    one, two = ([f"{v:x}" for v in rng.integers(0, 1 << 40, 400)] for _ in range(2))
    far, other = edited(rng, one, 12), edited(rng, two, 12)
    texts = {1: one, 2: [*one, "x"], 3: [*one, "y"], 4: far, 5: [*far, "z"], 6: [*far, "u"], 7: two, 8: other}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    calls, blocks = [], near_dedup._blocks

    def spy(buckets, found, reps, *more):
        rows = blocks(buckets, found, reps, *more)
        calls.append({r.doc_id for r in rows.select("id").distinct().join(reps, "id").select("doc_id").collect()})
        return rows

    monkeypatch.setattr(near_dedup, "_blocks", spy)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=4, leaders=1, few=1).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    assert len(calls) == 2 and calls[0] >= {7, 8} and calls[1] == {1, 2, 3, 4, 5, 6}


def test_keys_without_a_bucket_move_once(spark, unsent, moved):
    """Forty keys of eight bytes a document, next to a signature and a sketch."""
    rng = np.random.default_rng(12)
    rows = [(k, " ".join(f"{v:x}" for v in rng.integers(0, 1 << 40, 30))) for k in range(4000)]
    rows += [(5000 + k, rows[k][1] + " end") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    before = moved()
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words=4).collect()}
    spent = moved() - before
    assert got == {k: k - 5000 if k >= 5000 else k for k, _ in rows}
    assert spent < 950 * len(rows), spent / len(rows)


def test_a_row_without_words_beside_a_near_copy(spark):
    """A doc_id whose other row is empty is no document of several sets."""
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (2, None), (2, " "), (3, ""), (3, " ".join(["start", *words]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in got) == [(1, 1, 57), (2, 1, 58), (2, 2, 0), (2, 2, 0), (3, 1, 58), (3, 3, 0)]
