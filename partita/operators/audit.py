"""Label audits: geometry, confidence, confusion, hard examples, co-location, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.geometry import aspect
from partita.operators.detection import box_pairs, greedy_match, nms_truth, self_pairs
from partita.operators.pairs import MOST, by_size
from partita.operators.ranges import quantiles
from partita.sources.storage import written

METRICS = ("w", "h", "area", "aspect")


def _measured(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("area", F.col("w") * F.col("h")).withColumn("aspect", aspect(F.col("w"), F.col("h")))


def class_statistics(boxes: DataFrame) -> DataFrame:
    """class_id, metric (w, h, area, aspect), n, mean, sd (population), least, most; infinite aspects are left out."""
    long = _measured(boxes).select("class_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")).select("class_id", "m.*")
    return long.where(F.col("value") < float("inf")).groupBy("class_id", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))


def geometry_anomalies(boxes: DataFrame, sigma: float = 3.0) -> DataFrame:
    """One row per anomaly of a box: image_id, line_no, class_id, anomaly, severity.

    Hard limits: a side of 0, centre outside, edges outside, area under 0.0001 or over 0.5, aspect over 20 or under 1/20, infinite aspect.
    Statistics: a metric further than `sigma` deviations from its class mean; the deviation, to one decimal, is part of the type.
    The class statistics are broadcast (four rows a class, and classes are a fixed taxonomy).
    """
    b = _measured(boxes)
    x1, y1, x2, y2 = F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2, F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2
    row = lambda when, kind, severity: F.when(when, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("anomaly"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity")))
    inf = F.lit(float("inf"))
    hard = [
        row((F.col("w") <= 0) | (F.col("h") <= 0), "zero_side", "critical"),
        row((F.col("cx") < 0) | (F.col("cx") > 1) | (F.col("cy") < 0) | (F.col("cy") > 1), "centre_outside", "critical"),
        row((x1 < 0) | (y1 < 0) | (x2 > 1) | (y2 > 1), "exceeds_image", "high"),
        row((F.col("area") > 0) & (F.col("area") < 1e-4), "too_small", "medium"),
        row(F.col("area") > 0.5, "too_large", "high"),
        row((F.col("aspect") > 20) & (F.col("aspect") < inf), "aspect_wide", "medium"),
        row((F.col("aspect") > 0) & (F.col("aspect") < 1 / 20), "aspect_tall", "medium"),
        row((F.col("aspect") == inf) & (F.col("w") > 0), "aspect_infinite", "critical"),
    ]
    stats = class_statistics(boxes).groupBy("class_id").pivot("metric", list(METRICS)).agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    soft = []
    for m in METRICS:
        sd = F.when(F.col(f"{m}_sd") > 0, F.col(f"{m}_sd"))
        away = F.abs(F.col(m) - F.col(f"{m}_mean")) / sd
        severity = F.when(away >= 6, "critical").when(away >= 4.5, "high").otherwise("medium")
        soft.append(row((F.col(m) < inf) & (away > sigma), F.concat(F.lit(f"{m}_sigma_"), F.format_string("%.1f", away)), severity))
    found = F.explode(F.array_compact(F.array(*hard, *soft)))
    return b.join(F.broadcast(stats), "class_id", "left").select("image_id", "line_no", "class_id", found.alias("a")).select("image_id", "line_no", "class_id", "a.*")


def anomaly_summary(anomalies: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per base type and severity: rows and images, with the share of images in the whole."""
    n = boxes.agg(F.count_distinct("image_id").alias("all_images"))
    base = anomalies.withColumn("base", F.substring_index("anomaly", "_sigma_", 1))
    out = base.groupBy("base", "severity").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))
    return out.crossJoin(F.broadcast(n)).select("base", "severity", "n", "images", (F.col("images") / F.col("all_images")).alias("rate"))


def _pairs(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """The overlapping pairs without their corners, joined once and written, for several aggregates read them."""
    pairs = box_pairs(truth.select("image_id", "line_no", "class_id", "x1", "y1", "x2", "y2"), detections.select("image_id", "det_id", "class_id", "conf", "x1", "y1", "x2", "y2"))
    return written(pairs.select("image_id", "t_line_no", "t_class_id", "d_det_id", "d_class_id", "d_conf", "iou"), "pairs")


def confidence_findings(truth: DataFrame, detections: DataFrame, digits: int | None = 4) -> DataFrame:
    """Findings of four kinds: image_id, kind, gt_class, pred_class, line_no, det_id, conf, iou, severity.

    missing: confidence over 0.5 and no truth box at IoU 0.3; phantom: a truth box no detection reaches at 0.3; misaligned: same class,
    0.3 <= IoU < 0.5; mismatch: other class, IoU >= 0.5. Absent fields are NULL. Severities: 0.9 conf, 0.8, 0.4 (1 - IoU), 0.7 IoU,
    rounded to `digits`, halves to even. The pairs feed all four kinds, so they are joined once and written.
    """
    pairs = _pairs(truth, detections)
    null = lambda t: F.lit(None).cast(t)
    by_det = pairs.groupBy("image_id", F.col("d_det_id").alias("det_id")).agg(F.max("iou").alias("best"))
    by_gt = pairs.groupBy("image_id", F.col("t_line_no").alias("line_no")).agg(F.max("iou").alias("best"))
    missing = detections.where("conf > 0.5").join(by_det, ["image_id", "det_id"], "left").fillna(0.0, ["best"]).where("best < 0.3")
    phantom = truth.join(by_gt, ["image_id", "line_no"], "left").fillna(0.0, ["best"]).where("best < 0.3")
    same = F.col("t_class_id") == F.col("d_class_id")
    kind = F.when(same & (F.col("iou") >= 0.3) & (F.col("iou") < 0.5), "misaligned").when(~same & (F.col("iou") >= 0.5), "mismatch")
    weight = F.when(F.col("kind") == "misaligned", 0.4 * (1 - F.col("iou"))).otherwise(0.7 * F.col("iou"))
    met = pairs.withColumn("kind", kind).where("kind IS NOT NULL").select("image_id", "kind", F.col("t_class_id").alias("gt_class"), F.col("d_class_id").alias("pred_class"), F.col("t_line_no").alias("line_no"), F.col("d_det_id").alias("det_id"), F.col("d_conf").alias("conf"), "iou", weight.alias("severity"))
    one = missing.select("image_id", F.lit("missing").alias("kind"), null("int").alias("gt_class"), F.col("class_id").alias("pred_class"), null("int").alias("line_no"), "det_id", "conf", F.col("best").alias("iou"), (0.9 * F.col("conf")).alias("severity"))
    two = phantom.select("image_id", F.lit("phantom").alias("kind"), F.col("class_id").alias("gt_class"), null("int").alias("pred_class"), "line_no", null("int").alias("det_id"), null("double").alias("conf"), F.col("best").alias("iou"), F.lit(0.8).alias("severity"))
    rows = met.unionByName(one).unionByName(two)
    return rows if digits is None else rows.withColumn("iou", F.bround("iou", digits)).withColumn("severity", F.bround("severity", digits))


FINDINGS = ("missing", "phantom", "misaligned", "mismatch")


def finding_summary(findings: DataFrame) -> DataFrame:
    """Counts per kind, for each class (the truth's, else the detection's) and in all (class_id NULL)."""
    named = findings.select(F.coalesce("gt_class", "pred_class").alias("class_id"), "kind")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in FINDINGS]
    return named.rollup("class_id").agg(*counts)


def confusion(truth: DataFrame, detections: DataFrame, threshold: float = 0.5) -> DataFrame:
    """gt_class, pred_class, n with background as NULL: matching goes by confidence, without regard to class."""
    found = greedy_match(truth, detections, threshold, keys=("image_id",))
    both = truth.select("image_id", "line_no", F.col("class_id").alias("gt_class")).join(found.select("image_id", "line_no", "det_id"), ["image_id", "line_no"], "left")
    d = detections.select(F.col("image_id").alias("di"), F.col("det_id").alias("dd"), F.col("class_id").alias("pred_class"))
    every = both.join(d, (F.col("image_id") == F.col("di")) & (F.col("det_id") == F.col("dd")), "full")
    return every.groupBy("gt_class", "pred_class").agg(F.count("*").alias("n"))


def top_confusions(matrix: DataFrame, n: int, priority: tuple[int, ...] = ()) -> DataFrame:
    off = matrix.where("gt_class IS NOT NULL AND pred_class IS NOT NULL AND gt_class <> pred_class")
    return off.withColumn("priority", F.col("gt_class").isin(*priority) if priority else F.lit(False)).orderBy(F.desc("n"), "gt_class", "pred_class").limit(n)


def confusion_examples(truth: DataFrame, detections: DataFrame, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """Up to k examples of each (gt_class, pred_class): a detection whose best truth box, IoU >= threshold, is of another class; in image order."""
    pairs = box_pairs(truth.select("image_id", "line_no", "class_id", "x1", "y1", "x2", "y2"), detections.select("image_id", "det_id", "class_id", "x1", "y1", "x2", "y2"))
    best = F.row_number().over(Window.partitionBy("image_id", "d_det_id").orderBy(F.desc("iou"), "t_line_no"))
    wrong = pairs.withColumn("k", best).where("k = 1").where((F.col("iou") >= threshold) & (F.col("t_class_id") != F.col("d_class_id")))
    turn = F.row_number().over(Window.partitionBy("t_class_id", "d_class_id").orderBy("image_id", "d_det_id"))
    return wrong.withColumn("example", turn).where(F.col("example") <= k).select(F.col("t_class_id").alias("gt_class"), F.col("d_class_id").alias("pred_class"), "example", "image_id", F.col("t_line_no").alias("line_no"), F.col("d_det_id").alias("det_id"), "iou")


def hard_examples(truth: DataFrame, detections: DataFrame, classes: tuple[int, ...], threshold: float = 0.5, low: float = 0.3) -> DataFrame:
    """image_id, kind (FN, low_conf, misclass), class_id, line_no, difficulty, for truth boxes of `classes`.

    Detections of `classes`, in their own order, take free truth boxes of any of these classes; a wrong class counts 1.5, a right one
    under `low` confidence 1 + (low - confidence), a truth box that nothing takes 2. Detections of other classes take no part.
    """
    target = truth.where(F.col("class_id").isin(*classes))
    some = detections.where(F.col("class_id").isin(*classes)).join(target.select("image_id").distinct(), "image_id", "left_semi")
    found = greedy_match(target, some, threshold, by_conf=False, keys=("image_id",))
    rows = found.join(target.select("image_id", "line_no", "class_id"), ["image_id", "line_no"]).join(some.select("image_id", "det_id", F.col("class_id").alias("pred"), "conf"), ["image_id", "det_id"])
    kind = F.when(F.col("pred") != F.col("class_id"), "misclass").when(F.col("conf") < low, "low_conf")
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL").select("image_id", "kind", "class_id", "line_no", F.when(F.col("kind") == "misclass", 1.5).otherwise(1 + (low - F.col("conf"))).alias("difficulty"))
    missed = target.join(found, ["image_id", "line_no"], "left_anti").select("image_id", F.lit("FN").alias("kind"), "class_id", "line_no", F.lit(2.0).alias("difficulty"))
    return rows.union(missed)


def hard_summary(examples: DataFrame, least: float = 1.5) -> DataFrame:
    """Per class: counts by kind, images, images with difficulty >= least, mean and largest difficulty."""
    kinds = [F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("FN", "low_conf", "misclass")]
    hard = F.count_distinct(F.when(F.col("difficulty") >= least, F.col("image_id"))).alias("hard_images")
    return examples.groupBy("class_id").agg(*kinds, F.count_distinct("image_id").alias("images"), hard, F.avg("difficulty").alias("mean_difficulty"), F.max("difficulty").alias("most"))


def label_quality(truth: DataFrame, detections: DataFrame, issue: float = 0.5) -> DataFrame:
    """Per image a score from 0 to 1, after the ObjectLab idea: the geometric mean of the scores of its three kinds of error.

    Overlooked: 1 - confidence of each confident detection without a truth box near; badly located: best IoU of a truth box with its own class; swapped: 1 - confidence
    of the best overlap of another class. Images without boxes score 1.
    """
    pairs = _pairs(truth, detections)
    same = F.col("t_class_id") == F.col("d_class_id")
    by_gt = pairs.groupBy("image_id", F.col("t_line_no").alias("line_no")).agg(F.coalesce(F.max(F.when(same, F.col("iou"))), F.lit(0.0)).alias("own"), F.coalesce(F.max(F.when(~same, F.col("iou") * F.col("d_conf"))), F.lit(0.0)).alias("other"))
    boxes = truth.select("image_id", "line_no").join(by_gt, ["image_id", "line_no"], "left").fillna(0.0, ["own", "other"])
    g = boxes.groupBy("image_id").agg(F.avg("own").alias("located"), F.avg(1 - F.col("other")).alias("swapped"))
    by_det = pairs.groupBy("image_id", F.col("d_det_id").alias("det_id")).agg(F.max("iou").alias("best"))
    seen = detections.join(by_det, ["image_id", "det_id"], "left").fillna(0.0, ["best"])
    o = seen.groupBy("image_id").agg(F.avg(1 - F.when(F.col("best") < 0.1, F.col("conf")).otherwise(0.0)).alias("overlooked"))
    out = g.join(o, "image_id", "full").fillna(1.0, ["located", "swapped", "overlooked"])
    score = F.pow(F.col("located") * F.col("swapped") * F.col("overlooked"), 1 / 3)
    return out.select("image_id", score.alias("score"), (score < issue).alias("issue"))


def co_location(boxes: DataFrame, anchors: tuple[int, ...], oversized: tuple[int, ...], threshold: float = 0.85) -> DataFrame:
    """Per oversized class: n, with_anchor, with_oversized, larger, share and strategy.

    with_anchor counts boxes that coincide (IoU >= threshold) with an anchor box of their image (a class that is an anchor itself meets
    itself), with_oversized those that coincide with a box of another oversized class, larger those not smaller than the first anchor
    they meet. From a share of 70 % on the strategy is top_edge (if over half of them are larger) or centre, from 30 % per_image, else manual.
    """
    area = lambda side: F.col(f"{side}w") * F.col(f"{side}h")
    own = boxes.where(F.col("class_id").isin(*oversized)).select("image_id", "line_no", "class_id", "w", "h", "x1", "y1", "x2", "y2")
    met = boxes.where(F.col("class_id").isin(*anchors, *oversized)).select("image_id", F.col("line_no").alias("det_id"), "class_id", "w", "h", "x1", "y1", "x2", "y2")
    p = box_pairs(own, met).where(F.col("iou") >= threshold)
    anchor, other = F.col("d_class_id").isin(*anchors), F.col("d_class_id").isin(*oversized) & (F.col("d_class_id") != F.col("t_class_id"))
    first = F.min(F.when(anchor, F.struct("d_det_id", (area("t_") >= area("d_")).alias("larger"))))
    near = p.groupBy("image_id", F.col("t_line_no").alias("line_no")).agg(first.alias("a"), F.max(other.cast("int")).alias("o"))
    near = near.select("image_id", "line_no", F.col("a").isNotNull().alias("a"), F.coalesce("a.larger", F.lit(False)).alias("l"), (F.col("o") == 1).alias("o"))
    out = own.join(near, ["image_id", "line_no"], "left").groupBy("class_id").agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for c, name in (("a", "with_anchor"), ("o", "with_oversized"), ("l", "larger"))])
    share = F.col("with_anchor") / F.col("n")
    strategy = F.when((share >= 0.7) & (F.col("larger") > F.col("with_anchor") * 0.5), "top_edge").when(share >= 0.7, "centre").when(share >= 0.3, "per_image").otherwise("manual")
    return out.select("class_id", "n", "with_anchor", "with_oversized", "larger", share.alias("share"), strategy.alias("strategy"))


def relative_position(boxes: DataFrame, anchors: tuple[int, ...], threshold: float = 0.3) -> DataFrame:
    """Boxes of other classes with their place beside the first anchor box (IoU >= threshold): image_id, line_no, class_id, dx, dy in sides of the anchor."""
    a, b = boxes.where(F.col("class_id").isin(*anchors)), boxes.where(~F.col("class_id").isin(*anchors))
    p = box_pairs(a, b).where(F.col("iou") >= threshold)
    away = F.struct(((F.col("d_cx") - F.col("t_cx")) / F.col("t_w")).alias("dx"), ((F.col("d_cy") - F.col("t_cy")) / F.col("t_h")).alias("dy"))
    first = p.groupBy("image_id", F.col("d_line_no").alias("line_no"), F.col("d_class_id").alias("class_id")).agg(F.min_by(away, "t_line_no").alias("v"))
    return first.select("image_id", "line_no", "class_id", "v.dx", "v.dy")


def nearest_shares(near: DataFrame, coincide: float = 0.9, close: float = 0.05) -> DataFrame:
    """Of the rows of `nearest`: n, the share with an overlap over `coincide`, and the share nearer than `close`."""
    share = lambda c: F.avg(c.cast("int"))
    return near.agg(F.count("*").alias("n"), share(F.col("overlap") > coincide).alias("coincide"), share(F.col("distance") < close).alias("close"))


def sizes_by_source(boxes: DataFrame, small: float = 0.05) -> DataFrame:
    """Per source and class: n, boxes narrower than `small`, and the median area."""
    counts = boxes.groupBy("source", "class_id").agg(F.count("*").alias("n"), F.count_if(F.col("w") < small).alias("small"))
    return counts.join(quantiles(boxes, ("source", "class_id"), F.col("w") * F.col("h"), {"median_area": 0.5}), ["source", "class_id"], "left")


def oversampling(boxes: DataFrame, copied: Column) -> DataFrame:
    """Per class: boxes of originals and of copies (`copied`), the images of each, and how many boxes stand for one original."""
    on = lambda c, x: F.when(c, x)
    out = boxes.groupBy("class_id").agg(F.count_if(~copied).alias("originals"), F.count_if(copied).alias("copies"), F.count_distinct(on(~copied, F.col("image_id"))).alias("original_images"), F.count_distinct(on(copied, F.col("image_id"))).alias("copied_images"))
    return out.withColumn("factor", (F.col("originals") + F.col("copies")) / F.when(F.col("originals") > 0, F.col("originals")))


def suppressed_images(boxes: DataFrame, threshold: float = 0.7, levels: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """at_least, images: in how many images suppression of truth boxes costs at least so many."""
    n, k = (df.groupBy("image_id").agg(F.count("*").alias(c)) for df, c in ((boxes, "n"), (nms_truth(boxes, threshold), "k")))
    lost = n.join(k, "image_id").select((F.col("n") - F.col("k")).alias("lost"))
    counts = lost.agg(*[F.count_if(F.col("lost") >= level).alias(str(level)) for level in levels])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(level).alias("at_least"), F.col(str(level)).alias("images")) for level in levels])).alias("x")).select("x.*")


def quality_summary(scores: DataFrame) -> DataFrame:
    """Of the rows of label_quality: images, issues, and the mean, median and least score."""
    out = scores.agg(F.count("*").alias("images"), F.count_if("issue").alias("issues"), F.avg("score").alias("mean"), F.min("score").alias("least"))
    return out.join(quantiles(scores, (), F.col("score"), {"median": 0.5}), how="left")  # a row each


def worst_images(scores: DataFrame, n: int = 100) -> DataFrame:
    """The n images of the lowest score: image_id, score, place."""
    low = scores.orderBy("score", "image_id").limit(n)
    return low.select("image_id", "score", F.row_number().over(Window.orderBy("score", "image_id")).alias("place"))


def worst_classes(scores: DataFrame, boxes: DataFrame, n: int = 100) -> DataFrame:
    """Boxes of each class in the n worst images."""
    return boxes.join(worst_images(scores, n).select("image_id"), "image_id", "left_semi").groupBy("class_id").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


def class_matrix(boxes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """class_a, class_b, images: in how many images two classes have a coinciding pair (one hit an image and pair)."""
    p = self_pairs(boxes).where((F.col("iou") >= threshold) & (F.col("t_class_id") != F.col("d_class_id")))
    return p.select("image_id", F.least("t_class_id", "d_class_id").alias("class_a"), F.greatest("t_class_id", "d_class_id").alias("class_b")).distinct().groupBy("class_a", "class_b").agg(F.count("*").alias("images"))


def rounded_duplicates(boxes: DataFrame, grid: float = 0.005) -> DataFrame:
    """Boxes of one image that are equal after rounding to `grid` (halves to even): image_id, the box's key, n, classes."""
    key = [F.bround(F.col(c) / grid).cast("long").alias(f"k_{c}") for c in ("cx", "cy", "w", "h")]
    return boxes.select("image_id", "class_id", *key).groupBy("image_id", "k_cx", "k_cy", "k_w", "k_h").agg(F.count("*").alias("n"), F.count_distinct("class_id").alias("classes")).where("n > 1")


def nearest(boxes: DataFrame, classes: tuple[int, ...], cell: float = 0.125, most: int = MOST) -> DataFrame:
    """For each box of `classes`: distance to the nearest other centre of them in its image, and the largest IoU with one.

    Centres are sought in the grid cells around a box's own, in images of more than `most` boxes in cells an eighth as wide; a box that finds none within a
    cell's width goes on with cells four times as wide, and so on. Boxes that are alone in their image, or have no centre, give no row.
    """
    b = boxes.where(F.col("class_id").isin(*classes)).select("image_id", "line_no", "cx", "cy", "x1", "y1", "x2", "y2").dropna(subset=["cx", "cy"])
    d2 = F.min((F.col("cx") - F.col("ox")) * (F.col("cx") - F.col("ox")) + (F.col("cy") - F.col("oy")) * (F.col("cy") - F.col("oy"))).alias("d2")

    def rings(rows: DataFrame, reach: float) -> DataFrame:
        o = rows.select("image_id", F.col("line_no").alias("o_line"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
        some = rows.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select("image_id")
        left, found = rows.join(some, "image_id", "left_semi").select("image_id", "line_no", "cx", "cy"), None
        while True:
            at = lambda c: F.floor(F.col(c) / reach)
            around = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))
            here = left.withColumn("gx", around("cx")).withColumn("gy", around("cy"))
            there = o.withColumn("gx", at("ox")).withColumn("gy", at("oy"))
            near = here.join(there, ["image_id", "gx", "gy"]).where("line_no <> o_line").groupBy("image_id", "line_no").agg(d2)
            near = written(near.where(F.col("d2") <= reach * reach), "near")
            found = near if found is None else found.union(near)
            left = written(left.join(near, ["image_id", "line_no"], "left_anti"), "far")
            if left.isEmpty():
                return found
            reach *= 4

    near = by_size(b, ("image_id",), lambda rows: rings(rows, cell), lambda rows: rings(rows, cell / 8), most)
    p = self_pairs(b, most=most)
    ends = p.select("image_id", F.col("t_line_no").alias("line_no"), "iou").union(p.select("image_id", "d_line_no", "iou")).groupBy("image_id", "line_no").agg(F.max("iou").alias("overlap"))
    return near.join(ends, ["image_id", "line_no"], "left").select("image_id", "line_no", F.sqrt("d2").alias("distance"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def distribution(df: DataFrame, column: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), by: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """Percentiles (linear between neighbours) of a column, one row a share; exact=False takes Spark's sketch."""
    if exact:
        found = quantiles(df, by, F.col(column), {f"q{k}": s for k, s in enumerate(shares)})
        return found.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"q{k}").alias("value")) for k, s in enumerate(shares)])).alias("q")).select(*by, "q.share", "q.value")
    at = F.array(*[F.lit(s) for s in shares])
    value = F.percentile_approx(column, at)
    return df.groupBy(*by).agg(value.alias("v")).select(*by, F.posexplode(F.arrays_zip(at.alias("share"), F.col("v").alias("value")))).select(*by, "col.share", "col.value")


def oversize(boxes: DataFrame, source: Column) -> DataFrame:
    """Median sizes of source 'a' over those of 'b' per class, with a verdict."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("size")) for c in "wh"])).alias("v")
    rows = boxes.withColumn("src", source).where(F.col("src").isin("a", "b")).select("class_id", "src", sides).select("class_id", "src", "v.*")
    medians = quantiles(rows, ("class_id", "src", "side"), F.col("size"), {"median": 0.5})
    m = medians.groupBy("class_id").agg(*[F.max(F.when((F.col("src") == s) & (F.col("side") == c), F.col("median"))).alias(f"{c}_{s}") for s in "ab" for c in "wh"])
    m = boxes.select("class_id").distinct().join(m, "class_id", "left")
    ratio = F.greatest(F.col("w_a") / F.col("w_b"), F.col("h_a") / F.col("h_b"))
    return m.select("class_id", (F.col("w_a") / F.col("w_b")).alias("w_ratio"), (F.col("h_a") / F.col("h_b")).alias("h_ratio"), F.when(ratio.isNull(), "no_reference").when(ratio > 2, "oversized").when(ratio > 1.5, "slightly_oversized").otherwise("ok").alias("verdict"))


def densest(boxes: DataFrame, n: int, threshold: float = 0.01) -> DataFrame:
    """The n images with most boxes, with the number of their overlapping pairs."""
    top = boxes.groupBy("image_id").agg(F.count("*").alias("boxes")).orderBy(F.desc("boxes"), "image_id").limit(n)
    pairs = self_pairs(boxes.join(top.select("image_id"), "image_id", "left_semi")).where(F.col("iou") > threshold).groupBy("image_id").agg(F.count("*").alias("pairs"))
    return top.join(pairs, "image_id", "left").fillna(0, ["pairs"])


def sample_sizes(boxes: DataFrame, image_id: int, k: int = 3) -> DataFrame:
    """Of one image: boxes of each class and the sizes of its first k."""
    w = Window.partitionBy("class_id").orderBy("line_no")
    rows = boxes.where(F.col("image_id") == image_id).withColumn("k", F.row_number().over(w))
    return rows.groupBy("class_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= k, F.struct("k", "w", "h")))), lambda x: F.struct(x["w"].alias("w"), x["h"].alias("h"))).alias("sizes"))


def size_kinds(boxes: DataFrame, tiny: float = 0.03, large: float = 0.15) -> DataFrame:
    """Per class: degenerate (a side not over 0), tiny (a side under `tiny`), large and ordinary boxes."""
    low, high = F.least("w", "h"), F.greatest("w", "h")
    kind = F.when(low <= 0, "degenerate").when(low < tiny, "tiny").when(high > large, "large").otherwise("ordinary")
    return boxes.groupBy("class_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def top_relative_positions(boxes: DataFrame, ratios: DataFrame, anchors: tuple[int, ...], n: int = 10, threshold: float = 0.85) -> DataFrame:
    """Of the n classes with the largest size ratio (ratios of `oversize`, those without a reference left out): where their boxes stand on the first anchor box that they share.

    class_id, ratio, n, and quantiles p5, p25, p50, p75, p95 of rel_x and rel_y (0: the anchor's left or top edge, 1: the other) and of size_w and size_h (in sides of the
    anchor). Classes that share no box have n = 0 and NULLs.
    """
    top = ratios.where("w_ratio IS NOT NULL").withColumn("ratio", F.greatest(F.coalesce("w_ratio", F.lit(0.0)), F.coalesce("h_ratio", F.lit(0.0)))).orderBy(F.desc("ratio"), "class_id").limit(n).select("class_id", "ratio")
    some = boxes.where(~F.col("class_id").isin(*anchors)).join(F.broadcast(top.select("class_id")), "class_id", "left_semi")
    pairs = box_pairs(boxes.where(F.col("class_id").isin(*anchors)), some).where(F.col("iou") >= threshold)
    per = lambda v, side: v / F.when(F.col(side) > 0, F.col(side))
    place = F.struct(per(F.col("d_cx") - F.col("t_cx") + F.col("t_w") / 2, "t_w").alias("rel_x"), per(F.col("d_cy") - F.col("t_cy") + F.col("t_h") / 2, "t_h").alias("rel_y"), per(F.col("d_w"), "t_w").alias("size_w"), per(F.col("d_h"), "t_h").alias("size_h"))
    rows = pairs.groupBy("image_id", F.col("d_line_no").alias("line_no"), F.col("d_class_id").alias("class_id")).agg(F.min_by(place, "t_line_no").alias("v"))
    rows = written(rows.select("class_id", "v.*"), "places")
    out = top.join(rows.groupBy("class_id").agg(F.count("*").alias("n")), "class_id", "left").fillna(0, ["n"])
    for c in ("rel_x", "rel_y", "size_w", "size_h"):
        out = out.join(quantiles(rows, ("class_id",), F.col(c), {f"{c}_p{int(100 * s)}": s for s in (0.05, 0.25, 0.5, 0.75, 0.95)}), "class_id", "left")
    return out
