"""Scoring of many settings in one pass: the rows of the step-by-step operators, and no more shuffle for more settings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from partita.operators import detection as D
from partita.operators import sweeps
from partita.plans.catalog import QUERIES

GRID = [("a", 0.0, 0.7), ("b", 0.3, 0.5), ("c", 0.3, 0.3), ("d", 0.9, 0.1), ("none", 2.0, 0.5)]


@pytest.fixture(scope="module")
def scene(spark):
    rng, truth, found = random.Random(5), [], []
    for image in range(6):
        for k in range(40 if image else 90):
            x, y, w, h = rng.random(), rng.random(), 0.1 + rng.random() / 3, 0.1 + rng.random() / 3
            truth.append((image, k, k % 3, x, y, x + w, y + h))
            for m in range(rng.choice((0, 1, 1, 3))):
                dx, dy = rng.gauss(0, 0.03), rng.gauss(0, 0.03)
                found.append((image, 4 * k + m, (k + (rng.random() < 0.1)) % 4, rng.choice((0.2, 0.5, rng.random(), None if rng.random() < 0.1 else 1.0)), x + dx, y + dy, x + w + dx, y + h + dy))
    box = "x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame(truth, f"image_id long, line_no int, class_id int, {box}").cache(), spark.createDataFrame(found, f"image_id long, det_id int, class_id int, conf double, {box}").cache()


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [4096, 60])
def test_protocols_bit_by_bit(spark, scene, most):
    truth, found = scene
    flags = sweeps.by_protocols(truth, found, [(c, i) for _, c, i in GRID], 0.5, most)
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(1 << p).alias("bit")) for p, (n, _, _) in enumerate(GRID)])).alias("x")
    ours = flags.select("*", names).where(F.col("kept").bitwiseAND(F.col("x.bit").cast("long")) != 0).select("x.name", "image_id", "det_id", F.col("tp").bitwiseAND(F.col("x.bit").cast("long")) != 0)
    named = D.with_protocol(found, spark.createDataFrame(GRID, "name string, min_conf double, nms_iou double"))
    assert rows(ours) == rows(D.assigned(truth, named).select("name", "image_id", "det_id", F.col("tp") == 1))
    assert rows(sweeps.evaluate(truth, found, GRID, most=most)) == rows(D.evaluate(truth, named))


@pytest.mark.parametrize("most", [4096, 60])
def test_thresholds_bit_by_bit(scene, most):
    truth, found = scene
    levels = (0.3, 0.5, 0.75)
    long = D.assign(truth, found, levels)
    flags = sweeps.by_thresholds(truth, found, levels, most)
    for slices in (1, 7):
        ours = sweeps.report(flags, truth, 3, slices).select(F.element_at(F.array(*map(F.lit, levels)), F.col("setting") + 1), "class_id", "n_truth", "n", "tp", "ap")
        assert rows(ours) == rows(D.class_report(long, truth).select("threshold", "class_id", "n_truth", "n", "tp", "ap"))


def shuffled(spark) -> int:
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages, total = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None).iterator(), 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


@pytest.mark.parametrize("name", ["e4b_map_coco", "e5_protocols", "e6_sweep", "e6b_staged_sweep", "a13_assembly_four", "a14_counters"])
def test_items_are_shuffled_twice_at_most(spark, data, name):
    """Once by image and once by class (or by measure), however many settings there are, beside counts of images and of slices of classes."""
    items = spark.read.parquet(f"{data}/lineitem.parquet").count()
    before = shuffled(spark)
    QUERIES[name](spark, data).collect()
    assert shuffled(spark) - before < 8 * items
