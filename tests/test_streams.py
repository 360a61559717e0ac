"""Streams in event time, and findings that come in batches: the rows are those of one batch over everything."""

from __future__ import annotations

import datetime
import os
import random
import time

import pytest

from partita.operators import audit, harmony
from partita.streaming import live

CHORD = "score_id long, chord_index int, measure int, beat double, s int, a int, t int, b int, at timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def chord(score, i, at=None):
    voices = (60 + (i * 7 + score) % 20, 55 + (i * 5) % 13, 50 + (i * 3 + score) % 11, None if i % 9 == 4 else 40 + (i * 11) % 17)
    return (score, i, 1 + i // 4, float(i % 4), *voices, START + datetime.timedelta(seconds=i if at is None else at))


def played(spark, folder, files, delay):
    """The rows of the live rules after the files have come one after the other."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, CHORD).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
        os.utime(f"{folder}/in/{k}", (time.time() + k, time.time() + k))
        for f in os.listdir(f"{folder}/in/{k}"):
            os.utime(f"{folder}/in/{k}/{f}", (time.time() + k, time.time() + k))
    stream = spark.readStream.schema(CHORD).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    name = f"live{os.path.basename(folder)}".replace("-", "_")
    q = live.live_violations(stream, delay).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def found(df, scores):
    return sorted((r.score_id, r.chord_index, r.kind, r.voices, r.prev_index if "prev_index" in df.columns else None) for r in df.collect() if r.score_id in scores)


def test_swapped_and_late_chords_give_the_batch_rows(spark, rocks, tmp_path):
    rng = random.Random(2)
    rows = [chord(score, i) for score in (1, 2, 3) for i in range(18)]
    rows.sort(key=lambda r: (r[-1] + datetime.timedelta(seconds=rng.uniform(0, 6)), r[0]))  # up to six seconds late
    files = [rows[k : k + 9] for k in range(0, len(rows), 9)] + [[chord(99, 0, at=1000)], [chord(99, 1, at=2000)]]  # the last ones push the watermark on
    got = played(spark, str(tmp_path), files, "10 seconds")
    batch = harmony.violations(spark.createDataFrame([(*r[:8], None, None) for r in rows], CHORD.replace(", at timestamp", "") + ", tonic_midi int, mode string"), ("M1", "V1", "P1", "P2"))
    assert found(got, {1, 2, 3}) == found(batch, {1, 2, 3}) and len(found(batch, {1, 2, 3})) > 30


def test_chords_beyond_the_delay_are_left_out(spark, rocks, tmp_path):
    files = [[chord(1, 0), chord(1, 1)], [chord(1, 40)], [chord(1, 41)], [chord(1, 2)], [chord(99, 0, at=1000)], [chord(99, 1, at=2000)]]
    got = played(spark, str(tmp_path), files, "5 seconds")
    kept = [chord(1, i) for i in (0, 1, 40, 41)]
    batch = harmony.violations(spark.createDataFrame([(*r[:8], None, None) for r in kept], CHORD.replace(", at timestamp", "") + ", tonic_midi int, mode string"), ("M1", "V1", "P1", "P2"))
    assert found(got, {1}) == found(batch, {1})


BOX = "image_id long, {id} int, class_id int,{conf} x1 double, y1 double, x2 double, y2 double"


def test_findings_settle_and_stay(spark, tmp_path):
    rng = random.Random(4)
    box = lambda: (lambda x, y: (x, y, x + 0.2, y + 0.2))(rng.random(), rng.random())
    truth = spark.createDataFrame([(i, k, k % 3, *box()) for i in range(6) for k in range(8)], BOX.format(id="line_no", conf=""))
    old, new = ([(i, k, k % 3, round(rng.random(), 3), *box()) for i in some for k in range(8)] for some in (range(6), (2, 4)))
    schema, path = BOX.format(id="det_id", conf=" conf double,"), f"{tmp_path}/out"
    write = live.audit_batches(truth, path)
    for number, rows in ((0, [r for r in old if r[0] < 3]), (1, [r for r in old if r[0] >= 3]), (2, new)):
        write(spark.createDataFrame(rows, schema), number)
    table = live.compact_findings(spark, path, f"{tmp_path}/sorted")
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    last = spark.createDataFrame([r for r in old if r[0] not in (2, 4)] + new, schema)
    want = rows(audit.confidence_findings(truth, last))
    assert rows(table) == want
    severity = [r.severity for r in table.collect()]
    assert severity == sorted(severity, reverse=True)
    write(spark.createDataFrame(new, schema), 2)  # the batch comes again
    assert rows(live.compact_findings(spark, path, f"{tmp_path}/sorted")) == want
    write(spark.createDataFrame([r for r in new if r[0] == 2], schema).where("conf < 0"), 3)  # nothing in it
    assert rows(live.settled_findings(spark, path)) == want
