"""Properties and edge cases of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from partita.functions import geometry as G
from partita.functions import pitch
from partita.operators import assembly, dataset, detection, harmony, reports
from partita.sources import readers, writers

CHORDS = "score_id long, chord_index int, s int, a int, t int, b int, tonic_midi int, mode string, measure int, beat double"


def chords(spark, rows, tonic=None, mode="major"):
    return spark.createDataFrame([(1, i, *r, tonic, mode, 1, float(i + 1)) for i, r in enumerate(rows)], CHORDS)


def kinds(df):
    return sorted((r.rule_id, r.kind, r.severity, r.voices) for r in df.collect())


def test_tritone_in_an_inner_voice_gives_two_rows(spark):
    found = harmony.violations(chords(spark, [(72, 60, 55, 48), (72, 66, 55, 48)]), ("M1",))
    assert kinds(found) == [("M1", "leap_inner", "error", "A"), ("M1", "leap_tritone", "error", "A")]


def test_parallel_fifths_need_motion_in_both_voices(spark):
    moving = harmony.violations(chords(spark, [(67, 64, 55, 48), (69, 64, 55, 50)]), ("P1",))
    assert [r.voices for r in moving.collect()] == ["S-B"]
    still = harmony.violations(chords(spark, [(67, 64, 55, 48), (67, 64, 55, 48)]), ("P1",))
    assert still.count() == 0


def test_transposition_changes_no_interval_rule(spark):
    rows = [(72, 67, 55, 40), (62, 69, 50, 52), (79, 60, 58, 45), (70, 66, 59, 47)]
    rules = ("M1", "V1", "P1", "P2")
    assert kinds(harmony.violations(chords(spark, rows), rules)) == kinds(harmony.violations(chords(spark, [tuple(v + 5 for v in r) for r in rows]), rules))


def test_leading_tone_and_doubling(spark):
    c = chords(spark, [(71, 62, 59, 53), (69, 64, 60, 57)], tonic=60)
    assert ("L1", "leading_unresolved", "error", "S") in kinds(harmony.violations(c, ("L1",)))
    assert kinds(harmony.violations(c, ("D1",))) == [("D1", "leading_doubled", "error", "")]


def test_cadences(spark):
    assert harmony.cadences(chords(spark, [(71, 65, 62, 55), (72, 64, 55, 48)], 60)).first().cadence is None  # a seventh chord is no triad
    assert harmony.cadences(chords(spark, [(71, 67, 62, 55), (72, 67, 64, 48)], 60)).first().cadence == "PAC"
    assert harmony.cadences(chords(spark, [(71, 67, 62, 55), (72, 67, 64, 48)])).first().cadence is None
    assert harmony.cadences(chords(spark, [], 60)).count() == 0


def test_partitions_change_nothing(spark):
    rows = [(60 + (i * 7) % 20, 55 + (i * 5) % 13, 50 + (i * 3) % 11, 40 + (i * 11) % 17) for i in range(40)]
    c = chords(spark, rows, 60)
    assert kinds(harmony.violations(c.repartition(1))) == kinds(harmony.violations(c.repartition(16)))


def test_messages_name_the_voice(spark):
    row = harmony.violations(chords(spark, [(60, 60, 55, 48), (74, 60, 55, 48)]), ("M1",)).first()
    assert row.message.startswith("S 聲部") and row.detail == "from 60 to 74, diff=14 semitones."


BOXES = "image_id long, line_no int, class_id int, cx double, cy double, w double, h double"


def boxes(spark, rows):
    b = spark.createDataFrame(rows, BOXES)
    c = G.to_corners(G.box("", ("cx", "cy", "w", "h")))
    return b.select("*", *c.named("x1", "y1", "x2", "y2"))


def test_iou_is_symmetric_and_bounded(spark):
    b = boxes(spark, [(1, i, 0, 0.3 + 0.01 * i, 0.5, 0.2, 0.1) for i in range(6)])
    p, q = (b.select("image_id", *[F.col(c).alias(n + c) for c in ("x1", "y1", "x2", "y2")]) for n in "pq")
    rows = p.join(q, "image_id").select(G.iou(G.box("p"), G.box("q")).alias("u"), G.iou(G.box("q"), G.box("p")).alias("v")).collect()
    assert all(abs(r.u - r.v) < 1e-12 and 0 <= r.u <= 1 + 1e-12 for r in rows)


def test_suppression_is_idempotent(spark):
    d = boxes(spark, [(1, i, 0, 0.2 + 0.03 * i, 0.5, 0.2, 0.2) for i in range(12)]).withColumnRenamed("line_no", "det_id").withColumn("conf", 0.9 - F.col("det_id") * 0.05)
    once = detection.nms(d, 0.5)
    assert {r.det_id for r in detection.nms(once, 0.5).collect()} == {r.det_id for r in once.collect()}


def test_perfect_predictions_score_one(spark):
    t = boxes(spark, [(i, j, j % 3, 0.1 * j + 0.05, 0.5, 0.08, 0.1) for i in range(3) for j in range(9)])
    d = t.withColumnRenamed("line_no", "det_id").withColumn("conf", F.lit(0.9))
    m = detection.mean_average_precision(detection.average_precision(detection.assign(t, d), t))
    assert m.first().map == pytest.approx(1.0)


def test_a_class_without_detections_scores_zero(spark):
    t = boxes(spark, [(1, 0, 0, 0.5, 0.5, 0.1, 0.1), (1, 1, 1, 0.2, 0.2, 0.1, 0.1)])
    d = t.where("class_id = 0").withColumnRenamed("line_no", "det_id").withColumn("conf", F.lit(0.9))
    ap = {r.class_id: r.ap for r in detection.average_precision(detection.assign(t, d), t).collect()}
    assert ap == {0: 1.0, 1: 0.0}


def test_fusion_of_equal_models_keeps_boxes(spark):
    d = boxes(spark, [(1, 0, 0, 0.3, 0.5, 0.1, 0.1), (1, 1, 0, 0.7, 0.5, 0.1, 0.1)]).withColumnRenamed("line_no", "det_id").withColumn("conf", F.lit(0.8))
    rows = detection.fuse([(d, 1.0), (d, 1.0)]).collect()
    assert len(rows) == 2 and all(r.members == 2 and r.conf == pytest.approx(0.8) for r in rows)


def test_cell_join_finds_each_pair_once(spark):
    t = boxes(spark, [(1, i, 0, 0.5, 0.5, 0.05 * (i + 1), 0.9) for i in range(5)])
    d = t.withColumnRenamed("line_no", "det_id").withColumn("conf", F.lit(0.5))
    assert detection.box_pairs(t, d, cell=0.1).count() == 25


def test_geometry_edges(spark):
    row = spark.range(1).select(
        G.aspect(F.lit(1.0), F.lit(0.0)).alias("inf"), *G.oriented_to_corners(F.array(*[F.lit(float(v)) for v in (3, 1, 9, 2, 8, 7, 2, 6)])).named("a", "b", "c", "d"),
        G.oriented_to_corners(F.array(F.lit(1.0))).a.alias("bad"), *G.whole_image(0.1).named("e", "f", "g", "h"),
        G.relative_to_crop(G.Box(*[F.lit(0.0)] * 4), G.Box(*[F.lit(v) for v in (0.0, 0.0, 9.0, 9.0)])).a.alias("empty"),
        *G.pixels_to_centre(*[F.lit(float(v)) for v in (-5, 0, 20, 10, 100, 50)]).named("i", "j", "k", "l"),
    ).first()
    assert row.inf == float("inf") and (row.a, row.b, row.c, row.d) == (2, 1, 9, 7) and row.bad is None and row.empty is None
    assert (row.e, row.g) == (0.5, 0.8) and (row.i, row.k) == (pytest.approx(0.1), pytest.approx(0.2))


def test_pitch_names(spark):
    rows = spark.createDataFrame([("C4",), ("F#3",), ("bb2",), ("H1",), ("C",), ("A-1",)], "n string").select(pitch.midi_of_name(F.col("n")).alias("m")).collect()
    assert [r.m for r in rows] == [60, 54, 46, None, None, 9]


def test_staff_pitch(spark):
    row = spark.range(1).select(*[pitch.staff_pitch(F.lit(s), F.lit(c), F.lit(a)).alias(n) for n, s, c, a in (("f5", 0, "treble", "natural"), ("e4", 8, "treble", "natural"), ("a3", 0, "bass", "sharp"), ("x", 0, "none", "flat"))]).first()
    assert (row.f5, row.e4, row.a3, row.x) == (77, 64, 58, 76)


def test_label_text_round_trip(spark):
    b = boxes(spark, [(1, 1, 3, 0.5, 0.25, 0.1, 0.2), (1, 2, 4, 0.125, 0.5, 0.25, 0.5)])
    texts = writers.label_texts(b, spark.createDataFrame([(1,), (2,)], "image_id long"))
    assert {r.image_id: r.text for r in texts.collect()}[2] == ""
    got = readers.label_rows(texts, "image_id", "text").orderBy("line_no").collect()
    assert [(r.line_no, r.class_id, r.cx) for r in got] == [(1, 3, 0.5), (2, 4, 0.125)]


def test_label_reader_skips_bad_lines(spark):
    t = spark.createDataFrame([("f", "1 .5 .5 .1 .1\n\nx 1 2 3 4\n2 .1 .2 .3\n3  .1 .2 .3 .4 9")], "file string, value string")
    assert [r.line_no for r in readers.label_rows(t).collect()] == [1, 5]
    assert [r.line_no for r in readers.label_rows(t, strict=True).collect()] == [1]


def test_chord_case_json(spark, tmp_path):
    note = lambda v, m: f'"{v}": {{"voice": "{v}", "midi": {m}, "measure": 1, "beat": 1.0}}'
    chord = lambda i, *m: '{"index": %d, "measure": 1, "beat": 1.0, "notes": {%s}}' % (i, ", ".join(note(v, x) for v, x in zip("SATB", m)))
    (tmp_path / "a.json").write_text('{"test_id": "t", "input": {"key_signature": {"tonic_midi": 60, "mode": "major"}, "chords": [%s, %s]}}' % (chord(0, 72, 67, 60, 48), chord(1, 74, 67, 60, 50)))
    rows = harmony.violations(readers.read_chord_cases(spark, str(tmp_path)), ("P1",)).collect()
    assert [r.voices for r in rows] == ["S-B"]


def test_broken_corpus_file_is_a_row(spark):
    files = spark.createDataFrame([("a", bytearray(b"<score><part-list><score-part/></part-list><measure/><measure><fermata/></measure></score>")), ("b", bytearray(b"nope"))], "path string, content binary")
    rows = {r.path: r for r in readers.corpus_statistics(files).collect()}
    assert (rows["a"].parts, rows["a"].measures, rows["a"].fermatas) == (1, 2, 1) and rows["b"].parts is None


def test_measures_number_from_one(spark):
    n = spark.createDataFrame([(1, 1, 50.0), (1, 2, 150.0), (1, 3, 400.0)], "image_id long, sym_id int, x double")
    b = spark.createDataFrame([(1, 100.0), (1, 200.0), (1, 300.0)], "image_id long, x double")
    assert [r.measure for r in assembly.measures(n, b).orderBy("sym_id").collect()] == [1, 2, 3]
    assert {r.measure for r in assembly.measures(n, b.limit(0)).collect()} == {1}


def test_clusters_follow_the_running_mean(spark):
    n = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([0, 15, 26, 60])], "image_id long, sym_id int, x double")
    assert [r.cluster for r in assembly.clusters(n, 20).orderBy("sym_id").collect()] == [0, 0, 0, 1]


def test_clefs_go_one_to_one(spark):
    s = spark.createDataFrame([(1, 0, 100.0, 10.0, 0.0, 500.0), (1, 1, 300.0, 10.0, 0.0, 500.0)], "image_id long, staff_idx int, top double, spacing double, x_min double, x_max double")
    c = spark.createDataFrame([(1, 1, "bass", 10.0, 121.0), (1, 2, "alto", 10.0, 125.0)], "image_id long, clef_id int, kind string, x double, y double")
    assert {r.staff_idx: r.clef for r in assembly.assign_clefs(c, s).collect()} == {0: "bass", 1: "treble"}


def test_splits_keep_keys_together_and_repeat(spark):
    i = spark.range(1000).withColumnRenamed("id", "k")
    a, b = ({r.k: r.split for r in dataset.hash_split(x, "k", 0.2).collect()} for x in (i, i.repartition(7)))
    assert a == b and 120 < sum(v == "val" for v in a.values()) < 280
    assert dataset.every_nth(i, "k").where("split = 'val'").count() == 100


def test_rare_classes_reach_validation(spark):
    b = spark.createDataFrame([(i, 0, 0 if i else 1, 0.5, 0.5, 0.1, 0.1) for i in range(200)], BOXES)
    s = {r.image_id: r.split for r in dataset.stratified_split(b, 0.2).collect()}
    assert s[0] == "val" and sum(v == "val" for v in s.values()) == 40


def test_d6_splits_every_image(spark, tmp_path):
    from partita.plans.dataset import d6_stratified_split

    # suppliers 9 and 10 give classes 27 and 30: images 1 to 40 hold only the first (rare), every image over 40 class 0, some also class 30 (rare)
    own = {i: {27} if i <= 40 else {0, 30} if i % 7 == 0 else {0} for i in range(1, 401)}
    rows = [(i * 100 + c, i, {0: 11, 27: 9, 30: 10}[c], 1, 1.0, 1.0, "1995-01-01") for i, cs in own.items() for c in cs]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    u = {r.i: r.u for r in spark.range(1, 401).select(F.col("id").alias("i"), dataset.draw(F.col("id")).alias("u")).collect()}
    val = set()
    for c in (0, 27, 30):
        has = sorted((i for i in own if c in own[i]), key=lambda i: (u[i], i))
        val |= set(has[: max(1, len(has) // 10)]) if len(has) < 100 else set()
    val |= set(sorted(own.keys() - val, key=lambda i: (u[i], i))[: 80 - len(val)])
    got = {r.image_id: r.split for r in d6_stratified_split(spark, str(tmp_path)).collect()}
    assert got == {i: "val" if i in val else "train" for i in own}


def test_weighted_sample_with_replacement(spark):
    w = spark.createDataFrame([(1, 1.0), (2, 0.0001), (3, 3.0)], "k long, weight double")
    n = {r.k: r["count"] for r in dataset.weighted_sample(w, "k", 400, replacement=True).groupBy("k").count().collect()}
    assert sum(n.values()) == 400 and n[3] > 2 * n[1] and n.get(2, 0) < 5


def test_fallback_when_no_row_meets_the_limit(spark):
    m = spark.createDataFrame([("a", 0.2, 0.5), ("b", 0.1, 0.9)], "name string, precision double, map50 double")
    assert reports.constrained_best(m, "precision", 0.5, "map50").where("place = 1").first().name == "b"


def test_live_rules_match_batch(spark, tmp_path):
    from partita.streaming.live import live_violations

    rows = [(60 + (i * 7) % 20, 55 + (i * 5) % 13, 50 + (i * 3) % 11, 40 + (i * 11) % 17) for i in range(12)]
    c = chords(spark, rows).select("score_id", "chord_index", "measure", "beat", "s", "a", "t", "b")
    c.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(c.schema).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = live_violations(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = harmony.violations(chords(spark, rows), ("M1", "V1", "P1", "P2"))
    assert kinds(spark.table("live")) == kinds(batch)


def test_suppression_by_rounds_equals_the_fold(spark):
    rows = [(k % 3, k, k % 2, (k * 37 % 100) / 100, (k * 7 % 40) / 50, (k * 11 % 40) / 50) for k in range(240)]
    d = spark.createDataFrame(rows, "image_id int, det_id int, class_id int, conf double, x1 double, y1 double").withColumns({"x2": F.col("x1") + 0.2, "y2": F.col("y1") + 0.2})
    fold, rounds = ({(r.image_id, r.det_id) for r in detection.nms(d, 0.3, most=most).collect()} for most in (4096, 50))
    assert fold == rounds and 0 < len(fold) < 240
    t = d.withColumnRenamed("det_id", "line_no").withColumns({"w": F.lit(0.2), "h": F.col("conf")})
    fold, rounds = ({(r.image_id, r.line_no) for r in detection.nms_truth(t, 0.3, most=most).collect()} for most in (4096, 30))
    assert fold == rounds and 0 < len(fold) < 240
