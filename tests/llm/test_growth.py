"""What must not grow: time with the kept lines of a text, pools with the documents of one length."""

from __future__ import annotations

import time

import numpy as np
import pytest

from partita.llm import line_dedup, packing


def test_kept_lines_cost_the_same_each(spark):
    def took(n):
        rows = [(k, "\n".join(["common", *(f"line {k} {i}" for i in range(n)), "Common ", "last"])) for k in range(10)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.perf_counter()
        got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_docs=10).collect()}
        spent = time.perf_counter() - began
        assert all(got[k].text == "\n".join(f"line {k} {i}" for i in range(n)) and got[k].n_dropped == 3 and got[k].n_lines == n + 3 for k in range(10))
        return spent

    took(100)
    small, large = took(2_500), took(50_000)
    assert large < 20 * small + 20


def test_many_dropped_among_many_kept(spark):
    common = [f"shared {i}" for i in range(400)]
    rows = [(k, "\n".join(x for i in range(400) for x in (common[i], f"own {k} {i}"))) for k in range(10)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()}
    assert all(got[k].text.split("\n") == [f"own {k} {i}" for i in range(400)] and got[k].n_dropped == 400 for k in range(10))


@pytest.mark.parametrize("length", [600, 300, 128, 100, 1023, 1024, 3000, 1])
def test_documents_of_one_length_pack_as_they_come(length):
    packer, most = packing.Packer(0, (128, 256, 512, 1024), 65536), 0
    for k in range(4000):
        packer.add(k, np.arange(length))
        if k % 50 == 49:
            packer.pack()
            most = max(most, sum(len(piece[2]) for pool in packer.pool.values() for piece in pool))
    assert most <= 2 * 1024
    packer.finish()
    seen = {}
    for doc, start, n, _, total, _, _, _, _ in packer.out:
        assert total == length
        seen.setdefault(doc, []).append((start, n))
    assert all(sum(n for _, n in v) == length and sorted(v)[0][0] == 0 for v in seen.values()) and len(seen) == 4000
