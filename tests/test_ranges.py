"""Ordered work over ranges equals one window a group, whatever the groups and ranges are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from partita.operators import assembly, dataset, harmony, ranges


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    groups = [1] * 300 + [2] * 2 + [None] * 5 + [rng.randint(3, 40) for _ in range(120)]
    data = [(g, k, rng.choice([0, 0, 1, 3, None]), rng.choice([0.5, 1.0, round(rng.random(), 2)])) for k, g in enumerate(groups)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g int, o int, v int, x double")


@pytest.fixture(autouse=True)
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def lines(df):
    return sorted(map(str, df.collect()))


def test_lagged(rows):
    w = Window.partitionBy("g").orderBy("o")
    want = rows.select("*", F.lag("v").over(w).alias("pv"), F.lag("o").over(w).alias("po"))
    assert lines(ranges.lagged(rows, ("g",), ["o"], {"pv": "v", "po": "o"})) == lines(want)
    assert lines(ranges.previous(rows, ("g",), ["o"], {"pv": "v", "po": "o"}, most=50)) == lines(want)


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running(rows, how):
    filled = rows.fillna(0, ["v"])
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = filled.withColumn("r", (F.sum if how == "sum" else F.max)("v").over(w))
    assert lines(ranges.running(filled, ("g",), ["o"], "r", "v", how)) == lines(want)


@pytest.mark.parametrize("most", [10**6, 0, 30])
def test_quantiles(rows, most):
    shares = {"low": 0.0, "q": 0.37, "mid": 0.5, "high": 1.0}
    some = rows.where("g IS NOT NULL")
    want = {r.g: [round(r[n], 9) for n in shares] for r in some.groupBy("g").agg(*[F.percentile("x", F.lit(s)).alias(n) for n, s in shares.items()]).collect()}
    assert {r.g: [round(r[n], 9) for n in shares] for r in ranges.quantiles(some, ("g",), F.col("x"), shares, most).collect()} == want
    whole = rows.agg(F.percentile("x", F.lit(0.37))).first()[0]
    assert round(ranges.quantiles(rows, (), F.col("x"), {"q": 0.37}, most).first().q, 9) == round(whole, 9)
    assert ranges.quantiles(rows.limit(0), ("g",), F.col("x"), {"q": 0.5}, most).count() == 0


def test_clusters_in_stretches(spark):
    rng = random.Random(2)
    data = [(1 if k % 5 else 2, k, round(rng.uniform(0, 900), 1)) for k in range(220)] + [(1, 900 + k, 1000.0 + 7 * k) for k in range(30)] + [(3, 1, 5.0), (3, 2, 5.0)]
    want = []
    for image in (1, 2, 3):
        total, n, c = 0.0, 0, -1
        for x, sym in sorted((x, sym) for i, sym, x in data if i == image):
            near = n and abs(x - total / n) <= 20
            total, n, c = (total + x, n + 1, c) if near else (x, 1, c + 1)
            want.append((image, sym, c))
    df = spark.createDataFrame(data, "image_id int, sym_id int, x double")
    for most in (10**6, 0, 50):
        assert sorted(map(tuple, assembly.clusters(df, most=most).collect())) == sorted(want)


def test_merging_in_stretches(spark):
    rng, data = random.Random(3), []
    for k in range(260):
        data.append((1 if k % 4 else 2, k, k % 2, round(rng.uniform(0, 3), 3), 0.5, rng.choice([0.01, 0.02, 0.3 if k > 200 else 0.02]), 0.1))
    df = spark.createDataFrame(data, "image_id int, line_no int, class_id int, cx double, cy double, w double, h double")
    want = []
    for key in {(r[0], r[2]) for r in data}:
        open_, n = None, 0
        for _, line, _, cx, cy, w, h in sorted((r for r in data if (r[0], r[2]) == key), key=lambda r: (r[3], r[1])):
            if open_:
                common = max(0.0, min(open_[0] + open_[2] / 2, cx + w / 2) - max(open_[0] - open_[2] / 2, cx - w / 2))
                if common / (open_[2] + w - common) > 0.5:
                    open_, n = ((open_[0] * n + cx) / (n + 1), (open_[1] * n + cy) / (n + 1), max(open_[2], w), max(open_[3], h)), n + 1
                    continue
                want.append((*key, *open_, n))
            open_, n = (cx, cy, w, h), 1
        want.append((*key, *open_, n))
    for most in (10**6, 0, 60):
        got = [(r.image_id, r.class_id, r.cx, r.cy, r.w, r.h, r.n) for r in dataset.merge_overlapping(df, most=most).collect()]
        assert sorted(got) == sorted(want)


def test_a_long_score_spreads(spark):
    rng = random.Random(4)
    data = [(1 if k % 4 else 2, k, 1 + k // 8, float(k % 4), *(rng.randint(b, b + 14) if k % 13 else None for b in (60, 55, 50, 40)), 60, "major") for k in range(240)]
    df = spark.createDataFrame(data, "score_id long, chord_index int, measure int, beat double, s int, a int, t int, b int, tonic_midi int, mode string")
    one, many = (lines(harmony.violations(df, most=most)) for most in (10**6, 0))
    assert one == many and len(one) > 200


def test_repeated_lines_over_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(k % 2, k, f"x{k // 6 % 3}", "p") for k in range(90)], "file_id int, line_no int, line string, prefix string")
    want = lines(dataset.repeated_report(df))
    own = ranges.previous
    monkeypatch.setattr(dataset, "previous", lambda *a: own(*a, most=0))
    assert lines(dataset.repeated_report(df)) == want


def test_measures_over_ranges(spark):
    rng = random.Random(9)
    notes = [(1 if k % 3 else 2, k, float(rng.randint(0, 60))) for k in range(150)]
    bars = [(1, float(rng.randint(0, 60))) for _ in range(25)] + [(3, 1.0)]
    want = sorted((i, k, 1 + sum(j == i and y < x for j, y in bars)) for i, k, x in notes)
    n, b = spark.createDataFrame(notes, "image_id int, sym_id int, x double"), spark.createDataFrame(bars, "image_id int, x double")
    for most in (10**6, 0):
        assert sorted(map(tuple, assembly.measures_by_count(n, b, most).collect())) == want
