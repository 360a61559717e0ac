"""Scoring of detections against truth boxes, one row per box, images as groups.

Truth: image_id, line_no, class_id, x1, y1, x2, y2. Detections: image_id, det_id, class_id, conf, x1, y1, x2, y2. Ties are settled by
line_no and det_id everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.geometry import iou
from partita.operators.pairs import CORNERS, MOST, box_pairs, by_size, self_pairs, with_cells  # noqa: F401 - pairs of boxes are part of this module's face
from partita.operators.rounds import apart_by_rounds, hull_knots, matched_by_rounds
from partita.sources.storage import written

def assign(truth: DataFrame, detections: DataFrame, thresholds: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Every detection at every threshold as a true (tp = 1) or false positive: threshold, image_id, det_id, class_id, conf, tp.

    A detection goes to its truth box of the same image and class with the largest IoU (ties to the smaller line_no), taken or not. Of the
    detections that go to a box with at least the threshold, the first by confidence is true.
    """
    pairs = box_pairs(truth.select("image_id", "class_id", "line_no", *CORNERS), detections.select("image_id", "class_id", "det_id", "conf", *CORNERS), ("image_id", "class_id"))
    best = pairs.groupBy("image_id", "class_id", "d_det_id").agg(F.max_by(F.struct("iou", "t_line_no"), F.struct("iou", -F.col("t_line_no"))).alias("b"))
    best = best.select("image_id", "class_id", F.col("d_det_id").alias("det_id"), F.col("b.iou").alias("iou"), F.col("b.t_line_no").alias("line_no"))
    all_ = detections.select("image_id", "class_id", "det_id", "conf").join(best, ["image_id", "class_id", "det_id"], "left")
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    all_ = all_.select("*", levels).withColumn("hit", F.coalesce(F.col("iou") >= F.col("threshold"), F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("threshold", "image_id", "class_id", "line_no", "hit").orderBy(F.desc("conf"), "det_id"))
    return all_.withColumn("tp", F.when(F.col("hit") & (turn == 1), 1).otherwise(0)).select("threshold", "image_id", "det_id", "class_id", "conf", "tp")


def _points(assigned: DataFrame, by: tuple[str, ...], slices: int) -> DataFrame:
    """`assigned` with slice, tp_sum and k: the place of each detection in its class by (conf desc, image_id, det_id), and the true ones up to it.

    Counted in two passes, inside slices of confidence and over the slices before, so that a class spreads over as many tasks as it has slices.
    """
    keys = [*by, "class_id", "slice"]
    cut = F.floor((1 - F.least(F.greatest("conf", F.lit(0.0)), F.lit(1.0))) * slices)
    w = Window.partitionBy(*keys).orderBy(F.desc("conf"), "image_id", "det_id")
    here = assigned.withColumn("slice", F.coalesce(cut, F.lit(slices))).withColumns({"tp_sum": F.sum("tp").over(w), "k": F.row_number().over(w).cast("long")})
    sums = here.groupBy(*keys).agg(F.max("tp_sum").alias("tp_here"), F.max("k").alias("k_here"))  # at most a row a slice and class
    upto = Window.partitionBy(*by, "class_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, *[F.coalesce(F.sum(f"{c}_here").over(upto), F.lit(0)).alias(f"{c}_before") for c in ("tp", "k")])
    out = here.join(before, keys)
    return out.withColumns({"tp_sum": F.col("tp_sum") + F.col("tp_before"), "k": F.col("k") + F.col("k_before")}).drop("tp_before", "k_before")


def curve(assigned: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("threshold",), slices: int = 1024) -> DataFrame:
    """Precision and recall after each detection of a class, by confidence: cumulative counts over (conf desc, image_id, det_id)."""
    n = truth.groupBy("class_id").agg(F.count("*").alias("n_truth"))
    out = _points(assigned, by, slices).join(F.broadcast(n), "class_id")
    return out.withColumn("recall", F.col("tp_sum") / F.col("n_truth")).withColumn("precision", F.col("tp_sum") / F.col("k"))


def class_report(assigned: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("threshold",), groups: DataFrame | None = None, slices: int = 1024) -> DataFrame:
    """n_truth, n, tp and ap of every class of truth boxes or detections, by `by`. groups: the values of `by`, if some have no detections.

    ap is the area under the monotone envelope of precision: 0 without detections, NULL without truth boxes. Recall grows at true
    detections only, and precision has its maxima there, so the envelope is taken over those, in two passes as the counts are.
    """
    keys = [*by, "class_id"]
    points = _points(assigned, by, slices).withColumn("precision", F.col("tp_sum") / F.col("k"))
    down = Window.partitionBy(*keys, "slice").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("envelope", F.max("precision").over(down))
    best = points.groupBy(*keys, "slice").agg(F.max("envelope").alias("best"), F.count("*").alias("n_here"), F.sum("tp").alias("tp_here"))
    after = best.select(*keys, "slice", F.max("best").over(Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"))
    area = points.where("tp = 1").join(after, [*keys, "slice"]).groupBy(*keys).agg(F.sum(F.greatest("envelope", "after")).alias("area"))
    seen = best.groupBy(*keys).agg(F.sum("n_here").alias("n"), F.sum("tp_here").alias("tp")).join(area, keys, "left")
    levels = groups if groups is not None else seen.select(*by).distinct()
    n = truth.groupBy("class_id").agg(F.count("*").alias("n_truth")).crossJoin(F.broadcast(levels))
    out = n.join(seen, keys, "full").fillna(0, ["n_truth", "n", "tp"])
    return out.select(*keys, "n_truth", "n", "tp", F.when(F.col("n_truth") > 0, F.coalesce(F.col("area") / F.col("n_truth"), F.lit(0.0))).alias("ap"))


def average_precision(assigned: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("threshold",), groups: DataFrame | None = None) -> DataFrame:
    """ap of every class that has truth boxes, by `by`; see class_report."""
    return class_report(assigned, truth, by, groups).where("ap IS NOT NULL").select(*by, "class_id", "ap")


def summarised(report: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """map (the mean ap of classes with truth boxes), detections, true_positives, precision and recall of a class_report, by `by`."""
    out = report.groupBy(*by).agg(F.avg("ap").alias("map"), F.sum("n").alias("detections"), F.sum("tp").alias("true_positives"), F.sum("n_truth").alias("n_truth"))
    share = lambda n: F.col("true_positives") / F.when(F.col(n) > 0, F.col(n))
    return out.select(*by, "map", "detections", "true_positives", share("detections").alias("precision"), share("n_truth").alias("recall"))


def mean_average_precision(ap: DataFrame, by: tuple[str, ...] = ("threshold",)) -> DataFrame:
    return ap.groupBy(*by).agg(F.avg("ap").alias("map"))


# Ordered folds: boxes of a group in a given order, state in one JVM aggregate. The cost is boxes times kept boxes of a group.


def ordered(df: DataFrame, keys: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """One row per group with its rows as an array `xs`, in order (a rank column leads the sort)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", rank).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", *fields))).alias("xs"))


def _overlap(a: Column, b: Column) -> Column:
    from partita.functions.geometry import Box

    return iou(Box(*(a[c] for c in CORNERS)), Box(*(b[c] for c in CORNERS)))


def keep_apart(xs: Column, clash) -> Column:
    """The elements that clash with no element kept before: a fold whose state is the array of kept ones."""
    return F.aggregate(xs, F.slice(xs, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def nms(detections: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",), most: int = MOST) -> DataFrame:
    """Non-maximum suppression by confidence, across the classes of an image: a box goes if its IoU with a kept one is over the threshold.

    Groups of up to `most` boxes are folded in one place; larger ones go by rounds over the pairs of a grid.
    """
    fields = [c for c in detections.columns if c not in keys]

    def folded(rows: DataFrame) -> DataFrame:
        kept = keep_apart(F.col("xs"), lambda k, x: _overlap(k, x) > threshold)
        groups = ordered(rows, list(keys), [F.desc("conf"), F.col("det_id")], fields)
        return groups.select(*keys, F.explode(kept).alias("x")).select(*keys, *[f"x.{c}" for c in fields])

    return by_size(detections, keys, folded, lambda rows: apart_by_rounds(rows.select(*keys, *fields), keys, "det_id", F.struct(-F.col("conf"), "det_id"), lambda v: v > threshold), most)


def nms_truth(truth: DataFrame, threshold: float = 0.7, most: int = MOST) -> DataFrame:
    """Suppression of truth boxes by area, within image and class, at IoU >= threshold: what a detector behind such a filter can find at most. Large groups go as in nms."""
    keys, fields = ("image_id", "class_id"), ["line_no", "w", "h", *CORNERS]

    def folded(rows: DataFrame) -> DataFrame:
        kept = keep_apart(F.col("xs"), lambda k, x: _overlap(k, x) >= threshold)
        groups = ordered(rows, list(keys), [F.desc(F.col("w") * F.col("h")), F.col("line_no")], fields)
        return groups.select(*keys, F.explode(kept).alias("x")).select(*keys, *[f"x.{c}" for c in fields])

    return by_size(truth.select(*keys, *fields), keys, folded, lambda rows: apart_by_rounds(rows, keys, "line_no", F.struct(-(F.col("w") * F.col("h")), "line_no"), lambda v: v >= threshold), most)


def recall_ceiling(truth: DataFrame, threshold: float = 0.7, small: float = 0.05) -> DataFrame:
    """Per class: boxes, boxes kept by nms_truth, and their ratio, for all boxes and for small and large ones (width under `small`)."""
    size = F.when(F.col("w") < small, "small").otherwise("large")
    n = truth.groupBy("class_id", size.alias("size")).agg(F.count("*").alias("n"))
    k = nms_truth(truth, threshold).groupBy("class_id", size.alias("size")).agg(F.count("*").alias("kept"))
    both = n.join(k, ["class_id", "size"], "left").fillna(0, ["kept"])
    every = both.groupBy("class_id").agg(F.lit("all").alias("size"), F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    return both.unionByName(every).withColumn("ceiling", F.col("kept") / F.col("n"))


def greedy_match(truth: DataFrame, detections: DataFrame, threshold: float = 0.5, by_conf: bool = True, keys: tuple[str, ...] = ("image_id", "class_id"), most: int = MOST) -> DataFrame:
    """Sequential matching: detections in order (confidence, or det_id) each take the free truth box of the largest IoU >= threshold.

    Gives keys, det_id, line_no and iou of the matches. A taken box no longer competes. The pairs are written once; groups of up to `most`
    pairs are folded, larger ones go by rounds of locally dominant pairs, which take the same.
    """
    t_cols, d_cols = ["image_id", "line_no", *CORNERS], ["image_id", "det_id", "conf", *CORNERS]
    if "class_id" in keys:
        t_cols, d_cols = [*t_cols, "class_id"], [*d_cols, "class_id"]
    pairs = box_pairs(truth.select(*t_cols), detections.select(*d_cols), keys).where(F.col("iou") >= threshold)
    pairs = written(pairs.select(*keys, F.col("d_det_id").alias("det_id"), F.col("t_line_no").alias("line_no"), "iou", F.col("d_conf").alias("conf")), "pairs")
    order = [*([F.coalesce(-F.col("conf"), F.lit(float("inf")))] if by_conf else []), F.col("det_id"), -F.col("iou"), F.col("line_no")]

    def folded(rows: DataFrame) -> DataFrame:
        groups = ordered(rows, list(keys), order, ["det_id", "line_no", "iou"])
        free = keep_apart(F.col("xs"), lambda k, x: (k["det_id"] == x["det_id"]) | (k["line_no"] == x["line_no"]))
        return groups.select(*keys, F.explode(free).alias("x")).select(*keys, "x.det_id", "x.line_no", "x.iou")

    turn = [v.alias(f"o{k}") for k, v in enumerate(order)]
    return by_size(pairs, keys, folded, lambda rows: matched_by_rounds(rows, keys, "det_id", "line_no", turn).select(*keys, "det_id", "line_no", "iou"), most)


def fuse(models: list[tuple[DataFrame, float]], threshold: float = 0.55, skip: float = 0.01, most: int = MOST) -> DataFrame:
    """Weighted box fusion of several models (detections, weight): image_id, class_id, fused box, conf and members.

    Boxes of all models go through by weighted confidence; each joins the cluster (of its image and class) whose fused box overlaps
    it most, over the threshold, or opens one. A fused box is the average by confidence; its confidence is the mean, scaled by the
    number of members over the sum of weights where fewer models than weights agree.

    An image and class of more than `most` boxes is cut into knots whose hulls don't overlap; each knot is folded for itself.
    """
    total = sum(w for _, w in models)
    every = None
    for k, (df, weight) in enumerate(models):
        part = df.where(F.col("conf") >= skip).select("image_id", "class_id", F.lit(k).alias("model"), "det_id", (F.col("conf") * weight).alias("conf"), *CORNERS)
        every = part if every is None else every.unionByName(part)
    keys = ("image_id", "class_id")
    cluster = "array<struct<x1:double,y1:double,x2:double,y2:double,conf:double,n:int>>"

    def add(found: Column, x: Column) -> Column:
        scores = F.transform(found, lambda c: _overlap(c, x))
        best = F.array_max(scores)
        at = F.array_position(scores, best)
        new = F.struct(*[x[c].alias(c) for c in CORNERS], x["conf"].alias("conf"), F.lit(1).alias("n"))

        def merged(c: Column) -> Column:
            w = c["conf"] + x["conf"]
            return F.struct(*[((c[p] * c["conf"] + x[p] * x["conf"]) / w).alias(p) for p in CORNERS], w.alias("conf"), (c["n"] + 1).alias("n"))

        joined = F.transform(found, lambda c, i: F.when(i + 1 == at, merged(c)).otherwise(c))
        return F.when(best > threshold, joined).otherwise(F.concat(found, F.array(new)))

    def folded(rows: DataFrame, by: tuple[str, ...] = keys) -> DataFrame:
        groups = ordered(rows, list(by), [F.desc("conf"), F.col("model"), F.col("det_id")], ["conf", *CORNERS])
        return groups.select(*keys, F.explode(F.aggregate("xs", F.array().cast(cluster), add)).alias("c"))

    def by_knots(rows: DataFrame) -> DataFrame:
        numbered = written(rows.withColumn("id", F.monotonically_increasing_id()), "boxes")
        return folded(hull_knots(numbered, keys), (*keys, "knot"))

    out = by_size(every, keys, folded, by_knots, most)
    conf = F.col("c.conf") / F.col("c.n") * F.least(F.lit(float(total)), F.col("c.n")) / total
    return out.select("image_id", "class_id", *[F.col(f"c.{p}").alias(p) for p in CORNERS], conf.alias("conf"), F.col("c.n").alias("members"))


def agreement(fused: DataFrame, models: list[DataFrame]) -> DataFrame:
    """Per image: fused boxes over the largest number of boxes of a single model."""
    counts = None
    for k, df in enumerate(models):
        part = df.groupBy("image_id").agg(F.count("*").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    most = counts.groupBy("image_id").agg(F.max("n").alias("most"))
    return most.join(fused.groupBy("image_id").agg(F.count("*").alias("fused")), "image_id", "left").fillna(0, ["fused"]).withColumn("ratio", F.col("fused") / F.col("most"))


def with_protocol(detections: DataFrame, protocols: DataFrame, most: int = MOST) -> DataFrame:
    """Detections under every protocol (name, min_conf, nms_iou): filtered by confidence, then suppressed within (protocol, image).

    The result is written, for evaluations read it several times. Images of more than `most` boxes under a protocol go by rounds.
    """
    keys, fields = ("name", "image_id"), ["det_id", "class_id", "conf", *CORNERS]
    both = detections.select("image_id", *fields).crossJoin(F.broadcast(protocols)).where("conf >= min_conf").select(*keys, *fields, "nms_iou")

    def folded(rows: DataFrame) -> DataFrame:
        groups = ordered(rows, list(keys), [F.desc("conf"), F.col("det_id")], [*fields, "nms_iou"])
        kept = keep_apart(F.col("xs"), lambda k, x: _overlap(k, x) > x["nms_iou"])
        return groups.select(*keys, F.explode(kept).alias("x")).select(*keys, *[f"x.{c}" for c in fields])

    def rounds(rows: DataFrame) -> DataFrame:
        return apart_by_rounds(rows, keys, "det_id", F.struct(-F.col("conf"), "det_id"), lambda v: v > F.col("t_nms_iou")).select(*keys, *fields)

    return written(by_size(both, keys, folded, rounds, most), "suppressed")


def assigned(truth: DataFrame, named: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`assign` at one threshold for detections that carry a protocol's name, each protocol for itself."""
    pairs = named.select("image_id", "class_id", "name", "det_id", "conf", *CORNERS)
    t = truth.select("image_id", "class_id", "line_no", *CORNERS)
    found = box_pairs(t, pairs, ("image_id", "class_id"))
    best = found.groupBy("d_name", "image_id", "class_id", "d_det_id").agg(F.max_by(F.struct("iou", "t_line_no"), F.struct("iou", -F.col("t_line_no"))).alias("b"))
    best = best.select(F.col("d_name").alias("name"), "image_id", "class_id", F.col("d_det_id").alias("det_id"), F.col("b.iou").alias("iou"), F.col("b.t_line_no").alias("line_no"))
    all_ = pairs.select("name", "image_id", "class_id", "det_id", "conf").join(best, ["name", "image_id", "class_id", "det_id"], "left")
    all_ = all_.withColumn("hit", F.coalesce(F.col("iou") >= threshold, F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("name", "image_id", "class_id", "line_no", "hit").orderBy(F.desc("conf"), "det_id"))
    return all_.withColumn("tp", F.when(F.col("hit") & (turn == 1), 1).otherwise(0))


def evaluate(truth: DataFrame, named: DataFrame, threshold: float = 0.5) -> DataFrame:
    """name, map50, precision and recall of detections that carry a protocol's name."""
    report = class_report(assigned(truth, named, threshold), truth, ("name",), named.select("name").distinct())
    return summarised(report, ("name",)).select("name", F.col("map").alias("map50"), "precision", "recall")


def staged_sweep(truth: DataFrame, detections: DataFrame, confidences: tuple[float, ...], first: float, ious: tuple[float, ...], least: float = 0.5, keep: int = 3) -> DataFrame:
    """name, map50, precision, recall and place of the second stage of a sweep.

    Stage 1 ranks the confidences at the suppression IoU `first`, those of a precision of `least` or more before others; stage 2 crosses
    the best `keep` with `ious`. All crossings are scored in the one pass over the boxes that stage 1 needs, and written: a row each.
    """
    from partita.operators.reports import constrained_best
    from partita.operators.sweeps import evaluate as scored

    spark, schema = truth.sparkSession, "name string, min_conf double, nms_iou double"
    grid = [(str(k), float(c), float(i)) for k, (c, i) in enumerate((c, i) for c in dict.fromkeys(confidences) for i in dict.fromkeys((first, *ious)))]
    found = written(scored(truth, detections, grid).join(F.broadcast(spark.createDataFrame(grid, schema)), "name"), "scored")
    values = ["min_conf", "nms_iou", "map50", "precision", "recall"]
    one = found.where(F.col("nms_iou") == float(first)).select(F.col("min_conf").cast("string").alias("name"), *values)
    best = constrained_best(one, "precision", least, "map50").where(F.col("place") <= keep).select("min_conf")
    two = found.where(F.col("nms_iou").isin(*map(float, ious))).join(F.broadcast(best), "min_conf").select(F.concat_ws("/", "min_conf", "nms_iou").alias("name"), "map50", "precision", "recall")
    return constrained_best(two, "precision", least, "map50")


def error_classes(truth: DataFrame, detections: DataFrame, foreground: float = 0.5, background: float = 0.1) -> DataFrame:
    """Every detection's error class (Match, Dupe, Loc, Cls, Both, Bkg) and every missed truth box (Miss): image_id, kind, id, error.

    By the largest IoU with boxes of its own class and of other classes; a truth box is missed if no detection of its class matches it and
    none of a Loc or Cls error points at it.
    """
    pairs = box_pairs(truth.select("image_id", "class_id", "line_no", *CORNERS), detections.select("image_id", "class_id", "det_id", "conf", *CORNERS))
    same = F.col("t_class_id") == F.col("d_class_id")
    top = lambda cond: F.max(F.when(cond, F.struct("iou", (-F.col("t_line_no")).alias("t"))))
    best = pairs.groupBy("image_id", "d_det_id").agg(top(same).alias("s"), top(~same).alias("o"))
    best = best.select("image_id", F.col("d_det_id").alias("det_id"), F.col("s.iou").alias("si"), (-F.col("s.t")).alias("st"), F.col("o.iou").alias("oi"), (-F.col("o.t")).alias("ot"))
    det = detections.select("image_id", "det_id", "conf").join(best, ["image_id", "det_id"], "left").fillna(0.0, ["si", "oi"])
    hit = F.col("si") >= foreground
    turn = F.row_number().over(Window.partitionBy("image_id", "st", hit).orderBy(F.desc("conf"), "det_id"))
    error = F.when(hit & (turn == 1), "Match").when(hit, "Dupe").when((F.col("si") >= background) & (F.col("si") < foreground), "Loc").when(F.col("oi") >= foreground, "Cls").when(F.col("oi") >= background, "Both").otherwise("Bkg")
    det = det.withColumn("error", error)
    pointed = det.select("image_id", F.when(F.col("error").isin("Match", "Loc"), F.col("st")).when(F.col("error") == "Cls", F.col("ot")).alias("line_no")).where("line_no IS NOT NULL").distinct()
    missed = truth.select("image_id", "line_no").join(pointed, ["image_id", "line_no"], "left_anti")
    rows = det.select("image_id", F.lit("detection").alias("kind"), F.col("det_id").alias("id"), "error")
    return rows.union(missed.select("image_id", F.lit("truth"), "line_no", F.lit("Miss")))
