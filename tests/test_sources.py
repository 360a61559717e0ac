"""Readers and writers on files, and the streaming forms as streams."""

from __future__ import annotations

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from partita.operators import harmony
from partita.sources import readers, writers
from partita.streaming import live

SYMBOLS = """<Page><Node><ClassName>notehead</ClassName><Top>10</Top><Left>20</Left><Width>4</Width><Height>6</Height></Node>
<Node><ClassName>slur</ClassName><Top>1</Top><Left>2</Left><Width>3</Width><Height>4</Height></Node>
<Node><ClassName>notehead</ClassName><Top>1</Top><Left>2</Left><Width>0</Width><Height>4</Height></Node>
<Node><ClassName>notehead</ClassName><Top>1</Top><Left>2</Left></Node></Page>"""


def test_annotations_as_lists_and_as_maps(spark, tmp_path):
    lists = {"images": [{"id": 1, "file_name": "a.png", "width": 100, "height": 50}], "annotations": [{"id": 7, "img_id": "1", "cat_id": ["3", "4"], "a_bbox": [1, 2, 3, 4]}, {"id": 8, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}, {"id": 9, "img_id": "5", "cat_id": ["3"], "a_bbox": [0, 0, 1, 1]}], "categories": [{"id": 3, "name": "barline"}]}
    maps = {"images": {"2": {"filename": "b.png", "width": 10, "height": 5}}, "annotations": {"11": {"img_id": "2", "cat_id": ["3"], "a_bbox": [5, 6, 7, 8]}}, "categories": {"3": {"name": "bar"}, "4": "other"}}
    for name, doc in (("one", lists), ("two", maps)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    rows = readers.read_annotations(spark, str(tmp_path)).collect()
    got = sorted((r.file_name, r.ann_id, r.cat_id, r.category, r.x1, r.y1, r.x2, r.y2) for r in rows if r.category)
    assert got == [("a.png", "7", "3", "barline", 1, 2, 3, 4), ("a.png", "8", "3", "barline", 1, 2, 4, 6), ("b.png", "11", "3", "bar", 5, 6, 7, 8)]
    assert [(r.ann_id, r.cat_id) for r in rows if not r.category] == [("7", "4")] and all(r.width and r.height for r in rows)


def test_symbol_xml_whole_and_not(spark, tmp_path):
    (tmp_path / "a.xml").write_text(SYMBOLS)
    rows = readers.read_symbol_xml(spark, str(tmp_path))
    assert sorted((r.name, r.x, r.y, r.w, r.h) for r in rows.collect()) == [("notehead", 20, 10, 4, 6), ("slur", 2, 1, 3, 4)]
    assert readers.read_symbol_xml(spark, str(tmp_path), whole=False).count() == 4
    classes, seen = spark.createDataFrame([("notehead", 0)], "name string, class_id int"), Observation()
    assert [(r.class_id, r.w) for r in readers.map_symbols(rows, classes, seen).collect()] == [(0, 4)]
    assert seen.get == {"mapped": 1, "unmapped": 1}
    assert [(r.name, r.n) for r in readers.unmapped_names(rows, classes).collect()] == [("slur", 1)]
    box = readers.normalised_boxes(rows.where("name = 'notehead'"), 40.0, 20.0).first()
    assert (box.cx, box.cy, box.w, box.h) == (22 / 40, 13 / 20, 4 / 40, 6 / 20)


def test_barline_symbols_from_attributes(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<Page><Node class="Bar_line" left="1" top="2" width="3" height="4"></Node><Node class="bar_final" left="1" top="2" width="3" height="4"></Node><Node class="note" left="1" top="2" width="3" height="4"></Node></Page>')
    rows = readers.barline_symbols(readers.read_symbol_xml(spark, str(tmp_path)), [("final", "final"), *readers.BARLINE_NAMES]).collect()
    assert sorted((r.name, r.kind) for r in rows) == [("Bar_line", "plain"), ("bar_final", "final")]
    assert {r.kind for r in readers.barline_symbols(spark.createDataFrame([("double_barline",), ("bar",)], "name string")).collect()} == {"plain"}


def test_score_marks(spark):
    xml = b"<museScore><Score><Staff><Measure><voice><Fermata><subtype>fermataBelow</subtype><timeStretch>1.5</timeStretch><offset x=\"1\" y=\"-5\"/><visible>0</visible></Fermata></voice></Measure><Measure><startRepeat/></Measure><Measure/></Staff></Score></museScore>"
    rows = readers.score_marks(spark.createDataFrame([("a", xml), ("b", b"<broken")], "path string, content binary")).collect()
    fermata = [tuple(r)[1:] for r in rows if r.mark == "fermata"]
    assert fermata == [(1, 1, "fermata", "fermataBelow", 1.5, 1.0, -5.0, False)]
    assert sorted((r.measure, r.subtype) for r in rows if r.mark == "barline") == [(1, "normal"), (2, "repeat_start"), (3, "final")]
    assert [r.path for r in rows if r.mark == "error"] == ["b"]


def test_measure_boxes_of_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"measures": [{"measure_id": 1, "bbox": [1, 2, 3, 4]}, {"measure_id": 2, "bbox": [1]}, {"measure_id": 3}]}))
    assert [(r.measure_id, r.x, r.y, r.w, r.h) for r in readers.read_measure_boxes(spark, str(tmp_path)).collect()] == [(1, 1, 2, 3, 4)]


def test_epochs_and_expected_rows(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "results.csv").write_text("epoch, metrics/mAP50(B)\n 1, 0.5\n 2, x\n")
    rows = readers.read_epochs(spark, f"{tmp_path}/run1/results.csv", {"epoch": "epoch", "metrics/mAP50(B)": "map50"}).collect()
    assert [(r.run_id, r.epoch, r.map50) for r in rows] == [("run1", 1, 0.5), ("run1", 2, None)]


def test_label_files_one_an_image(spark, tmp_path):
    texts = spark.createDataFrame([(1, "0 0.1 0.2 0.3 0.4\n1 0.5 0.5 0.1 0.1"), (2, "")], "image_id long, text string")
    path = f"{tmp_path}/labels"
    assert sorted(tuple(r) for r in writers.write_labels(texts, path).collect()) == [("1.txt", 36), ("2.txt", 0)]
    assert (tmp_path / "labels" / "1.txt").read_text() == "0 0.1 0.2 0.3 0.4\n1 0.5 0.5 0.1 0.1\n" and (tmp_path / "labels" / "2.txt").read_text() == ""
    assert sorted((r.line_no, r.class_id) for r in readers.read_labels(spark, f"{path}/*.txt").collect()) == [(1, 0), (2, 1)]


def test_findings_summaries_and_lists(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.2), ("b", 0.9), ("c", 0.5)], "name string, severity double")
    writers.write_findings(rows, f"{tmp_path}/findings")
    back = spark.read.csv(f"{tmp_path}/findings", header=True).collect()
    assert sorted(r.name for r in back) == ["a", "b", "c"]
    assert json.loads(writers.summary_json(rows.where("name = 'b'")).first().value) == {"name": "b", "severity": 0.9}
    writers.write_training_list(spark.createDataFrame([("x.png", 2), ("y.png", 1)], "path string, repeat int"), f"{tmp_path}/list")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/list").collect()) == ["x.png", "x.png", "y.png"]


def test_cases_match_takes_each_expected_once(spark):
    actual = spark.createDataFrame([(1, 0, "P1", "error", "parallel fifths"), (1, 1, "P1", "error", "parallel octaves"), (2, 0, "M1", "error", "leap")], "score_id long, chord_index int, rule_id string, severity string, message string")
    expected = [(1, 0, "P1", "error", "octaves"), (1, 1, "P1", "error", "fifths"), (2, 0, "M1", "warning", "leap"), (3, 0, "M1", "error", "leap")]
    got = harmony.cases_match(actual, spark.createDataFrame(expected, "score_id long, pos int, rule_id string, severity string, contains string")).collect()
    assert {(r.score_id, r.actual, r.expected, r.matches) for r in got} == {(1, 2, 2, True), (2, 1, 1, False), (3, 0, 1, False)}


def test_metrics_as_a_stream(spark, tmp_path):
    schema = "run_id string, epoch int, metric double"
    for k, rows in enumerate(([("a", 1, 0.5), ("b", 1, 0.1)], [("a", 2, 0.4)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
    stream = live.follow_metrics(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("followed").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("followed").collect()) == [("a", 2, 0.4, 0.5), ("b", 1, 0.1, 0.1)]


def test_audit_of_a_detection_stream(spark, tmp_path):
    truth = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 1.0, 1.0)], "image_id long, line_no int, class_id int, x1 double, y1 double, x2 double, y2 double")
    schema = "image_id long, det_id int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
    spark.createDataFrame([(1, 1, 0, 0.9, 5.0, 5.0, 6.0, 6.0)], schema).write.parquet(f"{tmp_path}/in")
    q = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(live.audit_batches(truth, f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.kind for r in spark.read.parquet(f"{tmp_path}/out").select(F.col("kind")).collect()) == ["missing", "phantom"]
