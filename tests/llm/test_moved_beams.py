"""Beams that have ended are not carried on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from partita.llm import ann


def test_only_beams_with_nodes_left_are_carried_on(spark, monkeypatch):
    # points along a half circle, each linked to the next: a query walks to the end of the line, the farther the longer
    angle = np.linspace(0, np.pi, 20)
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    packed = ann._packed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")).cache()
    graph = spark.createDataFrame([(i, i + 1, float(x[i] @ x[i + 1])) for i in range(19)], "id long, nbr long, sim float")
    entry = packed.orderBy(F.xxhash64("id", F.lit("entry")), "id").first().id
    ids = sorted(range(20), key=lambda i: abs(i - entry))[:14] + [0, 19]
    unit = {r.id: r.unit for r in packed.collect()}
    # ids of their own, so that no query starts from its node
    asked = spark.createDataFrame([(1000 + i, bytes(unit[i])) for i in sorted(set(ids))], "query_id long, unit binary")
    beams, write = [], ann.written

    def watched(df, name):
        out = write(df, name)
        if name == "beam":
            beams.append(out.select("query_id").distinct().count())
        return out

    monkeypatch.setattr(ann, "written", watched)
    got = {}
    for r in ann.search(packed, graph, asked, ef=4, entries=1).collect():
        got.setdefault(r.query_id, set()).add(r.node)
    for q in set(ids):
        order = sorted(range(20), key=lambda i: (-float(x[q] @ x[i]), i))
        assert q in got[1000 + q] and got[1000 + q] <= set(order[:5]) and len(got[1000 + q]) == 4
    assert len(beams) > 5 and beams[-1] <= 3 and beams == sorted(beams, reverse=True)
