"""Overlapping pairs of boxes: by image where images are small, by a hierarchical grid where they are crowded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.functions.geometry import box, iou
from partita.sources.storage import written

CORNERS = ("x1", "y1", "x2", "y2")
#: Boxes of a group that are compared all with all, or folded in one place, at most.
MOST = 4096


def crowded(rows: DataFrame, keys: tuple[str, ...], most: int = MOST) -> DataFrame | None:
    """The groups of more than `most` rows, or None. The counts are summed before the shuffle; nothing is written if there are none."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys)
    if large.isEmpty():
        return None
    large = written(large, "crowded")
    return F.broadcast(large) if large.count() <= 10_000 else large


def by_size(rows: DataFrame, keys: tuple[str, ...], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], most: int = MOST) -> DataFrame:
    """small() of the groups of up to `most` rows, and large() of those of more."""
    many = crowded(rows, keys, most)
    if many is None:
        return small(rows)
    return small(rows.join(many, list(keys), "left_anti")).unionByName(large(rows.join(many, list(keys), "left_semi")))


def with_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a box touches: columns gx, gy."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    return boxes.withColumn("gx", span("x1", "x2")).withColumn("gy", span("y1", "y2"))


def _meet() -> Column:
    return (F.col("t_x1") < F.col("d_x2")) & (F.col("d_x1") < F.col("t_x2")) & (F.col("t_y1") < F.col("d_y2")) & (F.col("d_y1") < F.col("t_y2"))


def _prefixed(rows: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.select(*[F.col(c).alias(c if c in keys else f"{prefix}{c}") for c in rows.columns])


def _first_cell(width: Column | float) -> Column:
    """Whether the pair stands in the cell of its intersection's upper left corner, the one that counts."""
    return (F.floor(F.greatest("t_x1", "d_x1") / width) == F.col("gx")) & (F.floor(F.greatest("t_y1", "d_y1") / width) == F.col("gy"))


def level() -> Column:
    """The level of a box in the hierarchical grid: the cells of level k are 2^k wide, the least power of two that is no shorter than the longer side."""
    return F.ceil(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(2.0**-40)))).cast("int")


def _placed(boxes: DataFrame, own: tuple[int, ...], above: tuple[int, ...]) -> DataFrame:
    """A row for each cell that a box touches in its own level and in those above up to `top`, and for each role it has there.

    A box touches four cells of a level at most. Roles see to it that two boxes meet only in the level of the larger one: own
    boxes of one side meet the own and the smaller ones of the other in role 1, smaller ones of this side meet own ones of the other in role 2.
    """
    at = boxes.withColumn("own", level()).withColumn("lv", F.explode(F.sequence(F.col("own"), F.greatest("own", "top"))))
    at = at.withColumn("wide", F.pow(F.lit(2.0), F.col("lv")))
    roles = F.when(F.col("lv") == F.col("own"), F.array(*map(F.lit, own))).otherwise(F.array(*map(F.lit, above)))
    for name, lo, hi in (("gx", "x1", "x2"), ("gy", "y1", "y2")):
        at = at.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / F.col("wide")), F.floor(F.col(hi) / F.col("wide")))))
    return at.withColumn("role", F.explode(roles)).drop("own", "top", "wide")


def grid_pairs(truth: DataFrame, detections: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Overlapping pairs by hierarchical grid: columns of both, prefixed t_ and d_. Boxes of all sizes cost a few rows each."""
    sizes = truth.select(*keys, level().alias("lv")).union(detections.select(*keys, level().alias("lv")))
    top = sizes.groupBy(*keys).agg(F.max("lv").alias("top"))
    here = [*keys, "lv", "gx", "gy", "role"]
    side = lambda rows, prefix, own, above: _prefixed(_placed(rows.join(top, list(keys)), own, above), prefix, tuple(here))
    both = side(truth, "t_", (1,), (2,)).join(side(detections, "d_", (1, 2), (1,)), here).where(_meet())
    return both.where(_first_cell(F.pow(F.lit(2.0), F.col("lv")))).drop("lv", "gx", "gy", "role")


def box_pairs(truth: DataFrame, detections: DataFrame, keys: tuple[str, ...] = ("image_id",), cell: float | None = None, most: int = MOST) -> DataFrame:
    """Overlapping (truth, detection) pairs of a group with their IoU: columns of both, prefixed t_ and d_, and iou.

    Groups of up to `most` truth boxes join on their keys alone; in larger ones boxes meet in the cells of a grid whose levels
    follow their sizes, so that dense groups don't pair all with all and mixed sizes don't multiply rows. cell: a grid of that width for all.
    Boxes with a missing coordinate meet nothing.
    """

    def plain(t: DataFrame, d: DataFrame) -> DataFrame:
        return _prefixed(t, "t_", keys).join(_prefixed(d, "d_", keys), list(keys)).where(_meet())

    if cell is not None:
        here = (*keys, "gx", "gy")
        both = plain_cells = _prefixed(with_cells(truth, cell), "t_", here).join(_prefixed(with_cells(detections, cell), "d_", here), list(here)).where(_meet())
        both = plain_cells.where(_first_cell(cell)).drop("gx", "gy")
    elif (many := crowded(truth, keys, most)) is None:
        both = plain(truth, detections)
    else:
        split = lambda how: [side.join(many, list(keys), how) for side in (truth, detections)]
        both = plain(*split("left_anti")).unionByName(grid_pairs(*split("left_semi"), keys))
    return both.withColumn("iou", iou(box("t_"), box("d_")))


def self_pairs(boxes: DataFrame, cell: float | None = None, most: int = MOST) -> DataFrame:
    """Overlapping pairs of boxes of one image, the one of the smaller line_no first: prefixes t_ and d_."""
    return box_pairs(boxes, boxes, cell=cell, most=most).where("t_line_no < d_line_no")
