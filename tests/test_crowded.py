"""Crowded groups: grid pairs, rounds and knots give what joins and folds in one place give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from partita.functions.geometry import box, to_centre
from partita.operators import audit, dataset, detection, pairs, rounds

BOX = "image_id int, line_no int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def boxes(spark):
    """Two images, one of them with most of the boxes; sides from a thousandth to the whole image, many on top of each other."""
    rng, rows = random.Random(3), []
    for k in range(420):
        w, h = (10 ** rng.uniform(-3, -0.3) for _ in range(2)) if k % 40 else (1.0, 1.0)
        x, y = rng.uniform(-0.1, 1 - w / 2), rng.uniform(-0.1, 1 - h / 2)
        for copy in range(rng.choice([1, 1, 2, 4])):
            d = 0.05 * copy
            rows.append((1 if k % 6 else 2, len(rows), k % 3, rng.choice([0.2, 0.5, 0.9, rng.random()]), x + d * w, y + d * h, x + w, y + h + d * h))
    df = spark.createDataFrame(rows, BOX).withColumn("det_id", F.col("line_no"))
    return df.select("*", *to_centre(box()).named("cx", "cy", "w", "h"))


def test_grid_pairs_equal_all_pairs(boxes):
    t, d = boxes.select("image_id", "line_no", *pairs.CORNERS), boxes.select("image_id", "det_id", *pairs.CORNERS)
    want = rows_of(pairs.box_pairs(t, d).select("image_id", "t_line_no", "d_det_id", "iou"))
    assert want == rows_of(pairs.box_pairs(t, d, most=100).select("image_id", "t_line_no", "d_det_id", "iou")) == rows_of(pairs.box_pairs(t, d, most=0).select("image_id", "t_line_no", "d_det_id", "iou"))
    assert len(want) > 5000


def test_a_box_costs_a_few_rows_a_level(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0), (1, 3.9, 3.9, 4.1, 4.1), (1, 5.0, 5.0, 5.0, 5.0)], "image_id int, x1 double, y1 double, x2 double, y2 double").withColumn("top", F.lit(10))
    n = {r.x1: r.n for r in pairs._placed(one, (1,), (2,)).groupBy("x1", "lv").count().groupBy("x1").agg(F.max("count").alias("n")).collect()}
    assert max(n.values()) <= 4


def test_suppression_by_rounds(boxes):
    for small, large in (
        (detection.nms(boxes, 0.5), detection.nms(boxes, 0.5, most=0)),
        (detection.nms_truth(boxes, 0.3), detection.nms_truth(boxes, 0.3, most=50)),
        (dataset.near_duplicate_boxes(boxes, 0.4), dataset.near_duplicate_boxes(boxes, 0.4, most=0)),
        (dataset.keep_largest(boxes, 0.07), dataset.keep_largest(boxes, 0.07, most=0)),
    ):
        assert rows_of(small) == rows_of(large) and 0 < small.count() < boxes.count()


def test_protocols_by_rounds(spark, boxes):
    protocols = spark.createDataFrame([("strict", 0.001, 0.7), ("deploy", 0.25, 0.3)], "name string, min_conf double, nms_iou double")
    assert rows_of(detection.with_protocol(boxes, protocols)) == rows_of(detection.with_protocol(boxes, protocols, most=0))


@pytest.mark.parametrize("by_conf, keys", [(True, ("image_id", "class_id")), (False, ("image_id",)), (True, ("image_id",))])
def test_matching_by_rounds(boxes, by_conf, keys):
    d = boxes.withColumns({c: F.col(c) + F.col("w") * 0.1 for c in ("x1", "x2")})
    fold, by = (detection.greedy_match(boxes, d, 0.4, by_conf, keys, most=m) for m in (4096, 0))
    assert rows_of(fold) == rows_of(by) and fold.count() > 300


def test_a_chain_takes_as_many_rounds_as_it_has_links(spark):
    chain = spark.createDataFrame([(1, k // 2, (k + 1) // 2, -k) for k in range(12)], "g int, d int, l int, o int")
    got = rounds.matched_by_rounds(chain, ("g",), "d", "l", [F.col("o")])
    taken, want = set(), []
    for g, d, line, o in sorted(map(tuple, chain.collect()), key=lambda r: r[3]):
        if not {("d", d), ("l", line)} & taken:
            taken |= {("d", d), ("l", line)}
            want.append((g, d, line, o))
    assert rows_of(got) == sorted(want)
    assert rounds.matched_by_rounds(chain.limit(0), ("g",), "d", "l", [F.col("o")]).count() == 0


def test_fusion_by_knots(boxes):
    small = boxes.where("w < 0.05 AND h < 0.05")
    other = small.withColumns({c: F.col(c) + 0.004 for c in pairs.CORNERS}).withColumn("conf", 1.2 - F.col("conf"))
    one, two = (detection.fuse([(small, 1.0), (other, 2.0)], 0.3, most=m) for m in (4096, 0))
    assert rows_of(one) == rows_of(two) and one.count() > 50


def test_hulls_join_boxes_that_meet_only_the_average(spark):
    corners = [(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0), (11.0, 2.6, 12.4, 4.0), (40.0, 40.0, 41.0, 41.0)]
    df = spark.createDataFrame([(1, k, *c) for k, c in enumerate(corners)], "image_id int, id long, x1 double, y1 double, x2 double, y2 double")
    assert [r.knot for r in rounds.hull_knots(df, ("image_id",)).orderBy("id").collect()] == [0, 0, 0, 3]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 200)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.knot for r in rounds.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: k for n, k in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_nearest_by_growing_rings(spark):
    rng = random.Random(8)
    data = [(1, k, 0, rng.uniform(0, 0.05), rng.uniform(0, 0.05)) for k in range(60)] + [(1, 100, 0, 0.97, 0.9), (1, 101, 0, 0.4, 0.02)] + [(2, 1, 0, 0.1, 0.1), (2, 2, 0, 30.0, 40.1)] + [(3, 1, 0, 0.5, 0.5), (4, 1, 0, None, 0.5), (4, 2, 0, 0.1, 0.1), (4, 3, 0, 0.1, 0.1)]
    df = spark.createDataFrame(data, "image_id int, line_no int, class_id int, cx double, cy double").withColumns({"x1": F.col("cx") - 0.01, "y1": F.col("cy") - 0.01, "x2": F.col("cx") + 0.01, "y2": F.col("cy") + 0.01})
    want = {}
    for i, k, _, x, y in data:
        others = [((x - u) ** 2 + (y - v) ** 2) ** 0.5 for j, m, _, u, v in data if (j, m) != (i, k) and j == i and None not in (u, x)]
        if others:
            want[i, k] = round(min(others), 9)
    for most in (4096, 0, 10):
        assert {(r.image_id, r.line_no): round(r.distance, 9) for r in audit.nearest(df, (0,), most=most).collect()} == want
