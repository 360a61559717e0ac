"""Label sets put together from several origins, and rule-based repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.functions.geometry import box, reference_size, shrunk_to_size
from partita.operators.dataset import near_duplicate_boxes

CENTRE = ("cx", "cy", "w", "h")


def pseudo_labels(boxes: DataFrame, detections: DataFrame, noteheads: DataFrame, trusted: Column, heads: tuple[int, ...], sizes: DataFrame) -> DataFrame:
    """Labels put together: image_id, class_id, cx, cy, w, h and origin.

    Trusted images keep their boxes. Others get the boxes of the notehead detector (noteheads: image_id, class_id, cx, cy, w, h) and the
    detections of all classes but `heads`, brought to the target sizes of `sizes` (class_id, width, height, bias; a small table); classes
    that it lacks keep their size. trusted is a predicate on image_id.
    """
    fields = ["image_id", "class_id", *CENTRE]
    kept = boxes.where(trusted).select(*fields, F.lit("trusted").alias("origin"))
    found = noteheads.where(~trusted).select(*fields, F.lit("notehead").alias("origin"))
    others = detections.where(~trusted & ~F.col("class_id").isin(*heads)).join(F.broadcast(sizes), "class_id", "left")
    key = F.concat_ws("/", "image_id", "det_id")
    small = shrunk_to_size(box("", CENTRE), F.col("width"), F.col("height"), F.col("bias"), key)
    sized = others.select("image_id", "class_id", *[F.when(F.col("width").isNotNull(), n).otherwise(F.col(c)).alias(c) for c, n in zip(CENTRE, small)], F.lit("predicted").alias("origin"))
    return kept.union(found).union(sized)


def repaired(boxes: DataFrame, affected: Column, rules: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Boxes of affected images brought to reference sizes by `rules` (class_id, rule, width, height; a small table), then near duplicates dropped."""
    r = boxes.join(F.broadcast(rules), "class_id", "left")
    new = reference_size(box("", CENTRE), F.when(affected, F.col("rule")), F.col("width"), F.col("height"))
    fixed = r.select("image_id", "line_no", "class_id", *new.named(*CENTRE))
    return near_duplicate_boxes(fixed, threshold)
