"""Scoring at many settings at once: an image's boxes are dealt out once, and a detection stays one row with a bit for each setting.

Truth and detections as in partita.operators.detection. What is done in an image needs no shuffle where both sides are already dealt by image_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.geometry import box, iou
from partita.operators import detection as D
from partita.operators.pairs import CORNERS, MOST, crowded

#: Settings of one pass, at most: as many bits as a long holds, less the sign.
WIDE = 62


def _meets(t: str, d: str) -> Column:
    return (F.col(f"{t}x1") < F.col(f"{d}x2")) & (F.col(f"{d}x1") < F.col(f"{t}x2")) & (F.col(f"{t}y1") < F.col(f"{d}y2")) & (F.col(f"{d}y1") < F.col(f"{t}y2"))


def _named(rows: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return rows.select("image_id", *[F.col(c).alias(f"{prefix}{c}") for c in (*columns, *CORNERS)])


def _bits(flags: list[Column]) -> Column:
    mask = F.lit(0).cast("long")
    for p, flag in enumerate(flags):
        mask = mask.bitwiseOR(F.when(flag, F.lit(1 << p)).otherwise(0).cast("long"))
    return mask


def _set(mask: str, p: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << p).cast("long")) != 0


def _best(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """image_id, det_id, class_id, conf, and iou and line_no of the truth box of its class that a detection goes to; by image alone, for partitions by image serve the join."""
    same = F.col("t_class_id") - F.col("d_class_id") == 0  # no key of the join, which would deal both sides out anew
    both = _named(detections, "d_", "det_id", "class_id", "conf").join(_named(truth, "t_", "line_no", "class_id").withColumnRenamed("image_id", "t_image_id"), (F.col("image_id") == F.col("t_image_id")) & same & _meets("t_", "d_"), "left")
    found = F.max(F.when(F.col("t_line_no").isNotNull(), F.struct(iou(box("t_"), box("d_")).alias("iou"), (-F.col("t_line_no")).alias("t"))))
    best = both.groupBy("image_id", F.col("d_det_id").alias("det_id"), F.col("d_class_id").alias("class_id"), F.col("d_conf").alias("conf")).agg(found.alias("b"))
    return best.select("image_id", "det_id", "class_id", "conf", F.col("b.iou").alias("iou"), (-F.col("b.t")).alias("line_no"))


def _first(hit: Column) -> Column:
    """Whether a detection is the first by confidence of those that hit its truth box."""
    upto = Window.partitionBy("image_id", "line_no").orderBy(F.desc("conf"), "det_id").rowsBetween(Window.unboundedPreceding, 0)
    return hit & (F.count_if(hit).over(upto) == 1)


def _split(truth: DataFrame, detections: DataFrame, most: int, small, large) -> DataFrame:
    """small() of images with up to `most` boxes of either kind, large() of the others."""
    parts, kept = [], (truth, detections)
    for side in (0, 1):
        if (many := crowded(kept[side], ("image_id",), most)) is not None:
            parts.append(large(*[rows.join(many, "image_id", "left_semi") for rows in kept]))
            kept = tuple(rows.join(many, "image_id", "left_anti") for rows in kept)
    out = small(*kept)
    for part in parts:
        out = out.unionByName(part)
    return out


def by_thresholds(truth: DataFrame, detections: DataFrame, thresholds: tuple[float, ...], most: int = MOST) -> DataFrame:
    """detection.assign at all thresholds, one row a detection: image_id, det_id, class_id, conf, kept and tp (a bit for each threshold)."""
    every = F.lit((1 << len(thresholds)) - 1).cast("long")

    def small(t: DataFrame, d: DataFrame) -> DataFrame:
        hits = [F.coalesce(F.col("iou") >= v, F.lit(False)) for v in thresholds]
        return _best(t, d).withColumn("tp", _bits([_first(h) for h in hits])).select("image_id", "det_id", "class_id", "conf", every.alias("kept"), "tp")

    def large(t: DataFrame, d: DataFrame) -> DataFrame:
        mask = F.lit(0).cast("long")
        for p, v in enumerate(thresholds):
            mask = F.when((F.col("threshold") == v) & (F.col("tp") == 1), F.lit(1 << p).cast("long")).otherwise(mask)
        return D.assign(t, d, thresholds).groupBy("image_id", "det_id", "class_id", "conf").agg(F.bit_or(mask).alias("tp")).select("image_id", "det_id", "class_id", "conf", every.alias("kept"), "tp")

    return _split(truth, detections, most, small, large)


def by_protocols(truth: DataFrame, detections: DataFrame, protocols: list[tuple[float, float]], threshold: float = 0.5, most: int = MOST) -> DataFrame:
    """Detections under all protocols (min_conf, nms_iou), one row a detection: image_id, det_id, class_id, conf, kept and tp (a bit for each protocol).

    Pairs that any protocol may suppress are sought once; each protocol folds the pairs of an image, of which there are few. The truth box that a detection
    goes to is the same under all of them.
    """
    low, loose = min(c for c, _ in protocols), min(i for _, i in protocols)
    overlap = iou(box("t_"), box("d_"))

    def small(t: DataFrame, d: DataFrame) -> DataFrame:
        d = d.where(F.col("conf") >= low)
        one, two = _named(d, "t_", "det_id", "conf").withColumnRenamed("image_id", "t_image_id"), _named(d, "d_", "det_id", "conf")
        earlier = (F.col("t_conf") > F.col("d_conf")) | ((F.col("t_conf") == F.col("d_conf")) & (F.col("t_det_id") < F.col("d_det_id")))
        pairs = two.join(one, (F.col("image_id") == F.col("t_image_id")) & earlier & (overlap > loose if loose < 0 else _meets("t_", "d_") & (overlap > loose)))
        turn = F.when(F.isnan("d_conf"), float("-inf")).otherwise(-F.col("d_conf"))
        edge = F.struct(turn.alias("turn"), F.col("d_det_id").alias("b"), F.col("t_det_id").alias("a"), F.col("d_conf").alias("conf"), overlap.alias("iou"))
        edges = pairs.groupBy(F.col("image_id").alias("e_image_id")).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        number = f"array<{detections.schema['det_id'].dataType.simpleString()}>"

        def gone(c: float, i: float) -> Column:
            # edges come by their later box, so what becomes of the earlier one is settled
            goes = lambda out, e: (e["conf"] >= c) & (e["iou"] > i) & ~F.array_contains(out, e["a"]) & ~F.array_contains(out, e["b"])
            return F.aggregate("edges", F.array().cast(number), lambda out, e: F.when(goes(out, e), F.concat(out, F.array(e["b"]))).otherwise(out))

        edges = edges.select("e_image_id", *[gone(c, i).alias(f"gone{p}") for p, (c, i) in enumerate(protocols)])
        rows = _best(t, d).join(edges, F.col("image_id") == F.col("e_image_id"), "left")
        stays = [(F.col("conf") >= c) & ~F.coalesce(F.array_contains(f"gone{p}", F.col("det_id")), F.lit(False)) for p, (c, _) in enumerate(protocols)]
        rows = rows.select("image_id", "det_id", "class_id", "conf", "line_no", F.coalesce(F.col("iou") >= threshold, F.lit(False)).alias("hit"), _bits(stays).alias("kept"))
        return rows.withColumn("tp", _bits([_first(F.col("hit") & _set("kept", p)) for p in range(len(protocols))])).select("image_id", "det_id", "class_id", "conf", "kept", "tp")

    def large(t: DataFrame, d: DataFrame) -> DataFrame:
        table = t.sparkSession.createDataFrame([(str(p), float(c), float(i)) for p, (c, i) in enumerate(protocols)], "name string, min_conf double, nms_iou double")
        named = D.assigned(t, D.with_protocol(d, table, most), threshold)
        bit = F.expr("shiftleft(1L, CAST(name AS INT))")
        return named.groupBy("image_id", "det_id", "class_id", "conf").agg(F.bit_or(bit).alias("kept"), F.bit_or(F.when(F.col("tp") == 1, bit).otherwise(F.lit(0).cast("long"))).alias("tp"))

    return _split(truth, detections, most, small, large)


def report(flags: DataFrame, truth: DataFrame, settings: int, slices: int = 1024) -> DataFrame:
    """detection.class_report of all settings from one shuffle of the detections: setting, class_id, n_truth, n, tp, ap. A setting that keeps no detection has no rows."""
    keys, every = ["class_id", "slice"], range(settings)
    cut = F.floor((1 - F.least(F.greatest("conf", F.lit(0.0)), F.lit(1.0))) * slices)
    rows = flags.where("kept <> 0").select("class_id", F.coalesce(cut, F.lit(slices)).cast("int").alias("slice"), "conf", "image_id", "det_id", "kept", "tp").repartition(*keys)
    upto = Window.partitionBy(*keys).orderBy(F.desc("conf"), "image_id", "det_id").rowsBetween(Window.unboundedPreceding, 0)
    count = {f"{c}{p}": F.count_if(_set(m, p)) for p in every for c, m in (("k", "kept"), ("s", "tp"))}
    here = rows.withColumns({n: c.over(upto) for n, c in count.items()})
    sums = here.groupBy(*keys).agg(*[F.max(n).alias(n) for n in count])  # a row a slice and class
    earlier = Window.partitionBy("class_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in count])

    points = here.where("tp <> 0").join(before, keys).select(*keys, "k0", "tp", "conf", "image_id", "det_id", *[F.when(_set("tp", p), (F.col(f"s{p}") + F.col(f"s{p}_before")) / (F.col(f"k{p}") + F.col(f"k{p}_before"))).alias(f"v{p}") for p in every])
    down = Window.partitionBy(*keys).orderBy("conf", F.desc("image_id"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
    points = points.select(*keys, "tp", *[F.max(f"v{p}").over(down).alias(f"v{p}") for p in every])
    best = points.groupBy(*keys).agg(*[F.max(f"v{p}").alias(f"b{p}") for p in every])
    later = Window.partitionBy("class_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    after = best.select(*keys, *[F.max(f"b{p}").over(later).alias(f"a{p}") for p in every])
    area = points.join(after, keys).groupBy("class_id").agg(*[F.sum(F.when(_set("tp", p), F.greatest(f"v{p}", f"a{p}"))).alias(f"area{p}") for p in every])
    seen = sums.groupBy("class_id").agg(*[F.sum(n).alias(n) for n in count]).join(area, "class_id", "left")

    one = F.explode(F.array(*[F.struct(F.lit(p).alias("setting"), F.col(f"k{p}").alias("n"), F.col(f"s{p}").alias("tp"), F.col(f"area{p}").alias("area")) for p in every])).alias("x")
    classes = seen.join(truth.groupBy("class_id").agg(F.count("*").alias("n_truth")), "class_id", "full").select("class_id", F.coalesce("n_truth", F.lit(0)).alias("n_truth"), one)
    out = classes.select("x.setting", "class_id", "n_truth", F.coalesce("x.n", F.lit(0)).alias("n"), F.coalesce("x.tp", F.lit(0)).alias("tp"), F.when(F.col("n_truth") > 0, F.coalesce(F.col("x.area") / F.col("n_truth"), F.lit(0.0))).alias("ap"))
    return out.withColumn("__n", F.sum("n").over(Window.partitionBy("setting"))).where("__n > 0").drop("__n")


def evaluate(truth: DataFrame, detections: DataFrame, protocols: list[tuple[str, float, float]], threshold: float = 0.5, most: int = MOST) -> DataFrame:
    """name, map50, precision and recall of detections under protocols (name, min_conf, nms_iou), as detection.with_protocol and detection.evaluate give them."""
    out = None
    for at in range(0, len(protocols), WIDE):
        some = protocols[at : at + WIDE]
        names = F.element_at(F.array(*[F.lit(n) for n, _, _ in some]), F.col("setting") + 1).alias("name")
        found = D.summarised(report(by_protocols(truth, detections, [(c, i) for _, c, i in some], threshold, most), truth, len(some)), ("setting",)).select(names, F.col("map").alias("map50"), "precision", "recall")
        out = found if out is None else out.union(found)
    return out
