"""Names, taxonomies, extended rules and small reports on fixtures with every odd case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from partita.operators import assembly, audit, dataset, harmony, reports
from partita.sources import readers, taxonomy

DIMENSION = "taxonomy string, version int, class_id int, name string"


@pytest.fixture(scope="module")
def dimension(spark):
    """Two scripts of one taxonomy disagree on three ids; an id of a third has two names."""
    rows = [("t32", 1, 28, "loud"), ("t32", 1, 29, "soft"), ("t32", 1, 30, "fermata"), ("t32", 2, 28, "fermata"), ("t32", 2, 29, "soft"), ("t32", 2, 30, "loud"), ("t33", 1, 23, "barline"), ("t33", 1, 5, "rest"), ("t33", 1, 5, "pause")]
    return spark.createDataFrame(rows, DIMENSION)


def test_conflicts_of_taxonomies(dimension):
    got = {(r.kind, r.taxonomy, r.version, r.class_id, tuple(r.names)) for r in taxonomy.conflicts(dimension).collect()}
    both = ("fermata", "loud")
    assert got == {("ambiguous", "t33", 1, 5, ("pause", "rest")), ("moved", "t33", 1, 5, ("pause", "rest")), *(("moved", "t32", v, k, both) for v in (1, 2) for k in (28, 30))}
    assert {(r.taxonomy, r.version) for r in taxonomy.newest(dimension).collect()} == {("t32", 2), ("t33", 1)}


def test_ids_are_looked_up_in_their_own_taxonomy(spark, dimension):
    rows = spark.createDataFrame([("t32", 1, 28), ("t32", 2, 28), ("t32", 3, 28), ("t33", 1, 28), ("t33", 1, 5), ("bar4", 1, 23), (None, None, None)], "taxonomy string, version int, class_id int")
    good, bad = taxonomy.named(rows, dimension)
    assert {tuple(r) for r in good.collect()} == {("t32", 1, 28, "loud"), ("t32", 2, 28, "fermata")}
    assert {tuple(r) for r in bad.collect()} == {("t32", 3, 28, "other_version"), ("t33", 1, 28, "unknown_class"), ("t33", 1, 5, "ambiguous"), ("bar4", 1, 23, "other_taxonomy"), (None, None, None, "other_taxonomy")}
    mapping = spark.createDataFrame([("t32", 1, 28, 3), ("t32", 2, 28, 3)], "taxonomy string, version int, class_id int, new_id int")
    done, left = taxonomy.translated(rows, mapping, ("bar4", 1))
    assert [tuple(r) for r in done.collect()] == [("bar4", 1, 3)] * 2 and left.count() == 5


def test_taxonomies_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("taxonomy,version,class_id,name\nt20, 1,0 ,notehead\nt20,1,x,bad\nt20,1,1,\nt20,1,0,notehead\n")
    assert [tuple(r) for r in taxonomy.read_taxonomies(spark, str(tmp_path)).collect()] == [("t20", 1, 0, "notehead")]


def test_names(spark):
    names = ["wagner-27_flat_1196x4183x1308x4295_1252x4183x1285x4261_1288x4222x1329.jpg", "a_b.png", None, "Parsed_Bach-x-layout-0-muscima_Page_12.xml", "dir/Bach-x-012.png", "Bach.png"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", readers.symbol_name(F.col("n")).alias("s"), readers.page_name(F.col("n")).alias("p")).orderBy("k").collect()
    first = rows[0].s
    assert (first.source, first.label, first.crop, first.left, first.right) == ("wagner-27", "flat", [1196, 4183, 1308, 4295], [1252, 4183, 1285, 4261], None)
    assert rows[1].s is None and rows[2].s is None and rows[2].p is None
    assert tuple(rows[3].p) == tuple(rows[4].p) == ("Bach-x", 12) and rows[5].p is None


def test_chords_without_a_root_or_fifth(spark):
    """The extended rule reads chords that are no full triad on their bass."""
    rows = [(1, 0, 1, 1.0, 72, 64, 60, 48), (1, 1, 1, 2.0, 67, 67, 60, 48), (1, 2, 1, 3.0, 72, 67, 64, 48), (1, 3, 1, 4.0, 72, 72, 64, 48)]
    df = spark.createDataFrame([(*r, 60, "major") for r in rows], "score_id long, chord_index int, measure int, beat double, s int, a int, t int, b int, tonic_midi int, mode string")
    got = {(r.chord_index, r.kind, r.severity) for r in harmony.violations(df, ("D1",), extended=True).collect()}
    assert got == {(1, "root_or_third_missing", "error")} and harmony.violations(df, ("D1",)).count() == 0
    thin = spark.createDataFrame([(1, 0, 1, 1.0, 64, 64, 60, 48, 60, "major")], df.schema)
    assert [r.kind for r in harmony.violations(thin, ("D1",), extended=True).collect()] == ["fifth_missing"]


def test_beats(spark):
    notes = spark.createDataFrame([(1, 1, 0.0), (1, 2, 99.0), (1, 3, 100.0), (1, 4, 199.0), (1, 5, 999.0), (1, 6, 5000.0), (2, 1, -5.0), (2, 2, 450.0), (2, 3, 9000.0)], "image_id int, sym_id int, x double")
    bars = spark.createDataFrame([(1, 100.0), (1, 200.0), (1, 200.5), (3, 7.0)], "image_id int, x double")
    got = {(r.image_id, r.sym_id): (r.measure, r.beat) for r in assembly.beats_by_barlines(notes, bars).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (1, 4.0), (1, 3): (1, 4.0), (1, 4): (2, 4.0), (1, 5): (4, 4.0), (1, 6): (4, 4.0), (2, 1): (1, 1.0), (2, 2): (1, 3.0), (2, 3): (1, 4.0)}


def test_staff_regions_and_bounds(spark):
    lines = spark.createDataFrame([(1, float(10 * k)) for k in range(7)] + [(1, 300.0 + k) for k in range(5)] + [(2, 5.0)], "image_id int, y double")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    got = sorted(tuple(r) for r in assembly.staff_regions(lines, images).collect())
    assert got == [(1, 0, 0.0, 60.0, 7), (1, 1, 300.0, 304.0, 5), (3, 0, 0.0, 1000.0, 0)]


def test_pitch_errors(spark):
    m = spark.createDataFrame([(1, 0, 60, 60), (1, 1, 60, 61), (1, 2, 60, 72), (1, 3, 60, None)], "image_id int, idx int, midi int, pred_midi int")
    assert sorted((r.idx, r.delta) for r in assembly.pitch_errors(m).collect() if r.delta) == [(1, 1), (2, 12)] and assembly.pitch_errors(m).count() == 3
    lenient = [assembly.pitch_accuracy(m, t).first().lenient for t in (None, 0, 1, 12)]
    assert lenient == [0.5, 0.25, 0.5, 0.75]


def test_no_class_to_place(spark):
    b = spark.createDataFrame([(1, 1, 5, 0.5, 0.5, 0.1, 0.1, 0.45, 0.45, 0.55, 0.55)], "image_id int, line_no int, class_id int, cx double, cy double, w double, h double, x1 double, y1 double, x2 double, y2 double")
    ratios = spark.createDataFrame([(5, 2.0, 1.0), (6, None, 1.0)], "class_id int, w_ratio double, h_ratio double")
    r = audit.top_relative_positions(b, ratios, (0,)).collect()
    assert [(x.class_id, x.ratio, x.n, x.rel_x_p50) for x in r] == [(5, 2.0, 0, None)]


def test_run_comparisons(spark):
    one = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 0.4)], "run_id string, last double")
    two = spark.createDataFrame([("a", 0.4), ("b", 0.0), ("c", 0.39)], "run_id string, last double")
    got = {r.run_id: (None if r.loss is None else round(r.loss, 6), r.negative) for r in reports.transfer(one, two).collect()}
    assert got == {"a": (20.0, True), "b": (None, False), "c": (None, False)}
    cv = lambda v: spark.createDataFrame([(v,)], "cv double")
    assert [reports.spread_ratio(cv(a), cv(b)).first().severity for a, b in ((1.0, 3.5), (1.0, 2.5), (1.0, 1.0), (0.0, 1.0))] == ["severe", "moderate", "mild", "unknown"]


def test_weights_by_one_side(spark):
    counts = spark.createDataFrame([(1, 1000), (2, 4000), (3, 0)], "class_id int, n long")
    ap = spark.createDataFrame([(1, 0.9)], "class_id int, ap double")
    by = {how: {r.class_id: r.weight for r in dataset.quality_weights(counts, ap, how).collect()} for how in ("count", "quality", "both")}
    assert by["count"] == {1: 10.0, 2: 1.0} and by["quality"] == {1: 10.0, 2: 1.0} and set(by["both"]) == {1, 2}


def test_renumbering_keeps_pairs_together(spark):
    got = [tuple(r) for r in dataset.renumbered(spark.createDataFrame([("b", ".jpg"), ("a", ".png")], "stem string, suffix string"), "ds", 2).orderBy("stem").collect()]
    assert got == [("a", "ds_00.png", "ds_00.txt"), ("b", "ds_01.jpg", "ds_01.txt")]
