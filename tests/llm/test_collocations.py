"""Collocations against plain counting: chunks, n-grams, weakest cuts, phrases inside longer ones, awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from partita.llm import collocations as co


def plain(rows, longest, least, inside, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + m] for q, b in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * b >= inside * found[q[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n=120):
    rng, out = random.Random(seed), []
    words = ["alpha", "Beta", "gamma", "é", "x y", "ÄÖ", "zig", "zag", "o'clock", "-"]
    shared = "new york city hall opens, daily. Zig zag zig zag zig zag"
    for _ in range(n):
        w = [rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "!?", "\n", "\t", "  "]) for _ in range(rng.randint(0, 80))]
        out.append((rng.choice(["en", "en", "de", None]), " ".join(w) + rng.choice(["", shared, "\n" + shared * 3])))
    return out + [("en", None), (None, ""), ("fr", "..."), ("fr", "only few words"), ("und", "zig zag"), ("de", shared * 300)]


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (2, 3, 7), (4, 5, 40)])
def test_equals_plain_counting(spark, longest, least, top):
    rows = corpus(longest)
    df = spark.createDataFrame([(i, lang, text, "n") for i, (lang, text) in enumerate(rows)], "n long, lang string, text string, phrase string").repartition(3)
    assert rows_of(co.collocations(df, longest, least, 50, top)) == plain(rows, longest, least, 50, top)


def test_many_slices_and_buckets(spark, monkeypatch):
    rows = corpus(9)
    small = lambda size, longest, least: co.Plan(longest, least, 3, 5, 7, 5, 14)  # noqa: E731 - hashes of 14 bits clash all the time
    own = co.dictionary
    monkeypatch.setattr(co, "plan", small)
    monkeypatch.setattr(co, "dictionary", lambda rows, p: own(rows, p, 300))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert rows_of(co.collocations(df)) == plain(rows, 3, 10, 50, 2000)


def test_equal_passages_become_one_chunk():
    passage = " ".join(f"w{i}" for i in range(400))
    p = co.Plan(3, 10, 12, 1024, 1, 1, 40)
    once, twice = (co._merged(co._parsed(["en"] * k, [f"lead {x} in {passage} out {x}" for x in range(k)], p)) for k in (1, 20))
    assert twice.num_rows < once.num_rows + 3 * 20 and max(twice.column("n").to_pylist()) == 20
    assert sum(o * n for o, n in zip(twice.column("own").to_pylist(), twice.column("n").to_pylist())) == 20 * 405


def test_long_texts_are_cut_at_breaks():
    text = "ab cd. " * 1000
    assert "".join(co._segments(text, 100)) == text and len(co._segments(text, 100)) > 50
    assert co._segments("a" * 500, 100) == ["a" * 500] and co._segments(None) == [""]


def test_empty_tables_and_ties(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    rows = [("en", "b a. a b. ")] * 10
    assert rows_of(co.collocations(spark.createDataFrame(rows, "lang string, text string"))) == plain(rows, 3, 10, 50, 2000) == [("en", 1, "a b", 10, 20, 20, 40, 250000), ("en", 2, "b a", 10, 20, 20, 40, 250000)]
