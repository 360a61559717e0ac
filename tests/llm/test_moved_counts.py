"""Counts of phrases are joined without copies of each."""

from __future__ import annotations

from collections import Counter

from partita.llm import collocations


def test_counts_join_the_cuts_without_copies(spark, unsent, moved):
    # a word of half of all occurrences among phrases, and many that occur least
    words = [f"w{k}" for k in range(3000)]
    text = " . ".join(f"the {w}" for w in words for _ in range(2))
    df = spark.createDataFrame([("en", text), (None, "the w1 . the w1")], "lang string, text string")
    before = moved()
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.score) for r in collocations.collocations(df, longest=2, least=2, top=5000).collect()}
    spent = moved() - before
    want = {("en", f"the {w}"): (2, 6000, 2, 1000000 * 4 // 12000) for w in words} | {("und", "the w1"): (2, 2, 2, 1000000)}
    assert got == want
    assert spent < 600_000, spent
    counts = Counter({"the": 6000} | {w: 2 for w in words})
    known = spark.createDataFrame([("en", w, n) for w, n in counts.items()], "lang string, phrase string, n long")
    cuts = spark.createDataFrame([("en", f"the {w}", "the", w) for w in words], "lang string, phrase string, head string, tail string")
    for share in (1, 4096):  # all counts joined, one broadcast
        both = collocations._with_counts(collocations._with_counts(cuts, known, 12000, "head", "l", 16, share), known, 12000, "tail", "r", 16, share)
        assert {(r.phrase, r.l, r.r) for r in both.collect()} == {(f"the {w}", 6000, 2) for w in words}
