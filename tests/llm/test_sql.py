"""The registered corpus queries over whole tables: those with SQL against DuckDB, the others against plain Python."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from partita.llm.registry import ORACLES, QUERIES


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = c.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    assert plain(df.select(columns).collect()) == plain(tuple(r[i] for i in at) for r in cur.fetchall())


def test_op11_over_the_whole_table(spark, data):
    rows = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op11_simhash"](spark, data).collect())
    fp, label = np.array([f for _, f, _ in rows], np.uint64), [i for i, _, _ in rows]
    changed = True
    while changed:
        changed = False
        for k in range(len(rows)):
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[k]) <= 3)
            least = min(label[j] for j in near)
            changed |= any(label[j] != least for j in near)
            for j in near:
                label[j] = least
    assert [c for _, _, c in rows] == label
