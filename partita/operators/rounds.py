"""Order-dependent choices without a group in one place: rounds of joins, each written, for groups too large to fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.functions.geometry import box, iou
from partita.operators.pairs import CORNERS, grid_pairs
from partita.sources.storage import written


def gone_by_rounds(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame | None:
    """(keys, b): what goes if in each edge (keys, a, b) a comes first and, if it stays, b goes.

    A node that no undecided edge points to stays, those it points to go; every round decides at least the first node of each knot.
    None if there are no edges.
    """
    edges, gone = written(edges.select(*keys, "a", "b").distinct(), "edges"), None
    while not edges.isEmpty():
        stays = edges.select(*keys, "a").distinct().join(edges.select(*keys, F.col("b").alias("a")).distinct(), [*keys, "a"], "left_anti")
        out = written(edges.join(stays, [*keys, "a"]).select(*keys, "b").distinct(), "gone")
        gone = out if gone is None else gone.union(out)
        edges = written(edges.join(out, [*keys, "b"], "left_anti").join(out.withColumnRenamed("b", "a"), [*keys, "a"], "left_anti"), "edges")
    return gone


def without(boxes: DataFrame, gone: DataFrame | None, keys: tuple[str, ...], number: str) -> DataFrame:
    return boxes if gone is None else boxes.join(gone.withColumnRenamed("b", number), [*keys, number], "left_anti").select(*boxes.columns)


def apart_by_rounds(boxes: DataFrame, keys: tuple[str, ...], number: str, turn, clash) -> DataFrame:
    """What a fold keeps that takes boxes by `turn` (smallest first) and drops those that clash with a kept one.

    boxes: keys, `number` (their own in a group), corners. clash: a predicate on the IoU of a pair (grid_pairs gives t_ and d_ columns too).
    """
    b = boxes.select(*keys, F.col(number).alias("n"), turn.alias("turn"), *[c for c in boxes.columns if c not in (*keys, number, "n", "turn")])
    pairs = grid_pairs(b, b, keys).where(F.col("t_turn") < F.col("d_turn")).withColumn("iou", iou(box("t_"), box("d_"))).where(clash(F.col("iou")))
    return without(boxes, gone_by_rounds(pairs.select(*keys, F.col("t_n").alias("a"), F.col("d_n").alias("b")), keys), keys, number)


def centres_apart_by_rounds(boxes: DataFrame, keys: tuple[str, ...], number: str, turn, near: float) -> DataFrame:
    """As apart_by_rounds, for boxes that clash where their centres (cx, cy) are less than `near` apart in x and in y."""
    cell = lambda c: F.floor(F.col(c) / near)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    b = boxes.select(*keys, F.col(number).alias("n"), turn.alias("turn"), "cx", "cy")
    one = b.withColumns({"gx": cell("cx"), "gy": cell("cy")}).select(*keys, "gx", "gy", *[F.col(c).alias(f"t_{c}") for c in ("n", "turn", "cx", "cy")])
    two = b.withColumn("gx", around("cx")).withColumn("gy", around("cy")).select(*keys, "gx", "gy", *[F.col(c).alias(f"d_{c}") for c in ("n", "turn", "cx", "cy")])
    close = (F.abs(F.col("t_cx") - F.col("d_cx")) < near) & (F.abs(F.col("t_cy") - F.col("d_cy")) < near)
    pairs = one.join(two, [*keys, "gx", "gy"]).where((F.col("t_turn") < F.col("d_turn")) & close)
    return without(boxes, gone_by_rounds(pairs.select(*keys, F.col("t_n").alias("a"), F.col("d_n").alias("b")), keys), keys, number)


def matched_by_rounds(pairs: DataFrame, keys: tuple[str, ...], one: str, two: str, order: list) -> DataFrame:
    """The pairs that a fold by `order` (smallest first, no ties) takes if every pair whose two ends are free is taken.

    Locally dominant pairs: one that is the first both of its `one` and of its `two` would be taken by the fold as well, whatever lies elsewhere;
    it is taken, all pairs that share an end with it go, and so on. Every round is written.
    """
    left, taken = written(pairs.withColumn("__turn", F.struct(*order)), "pairs"), None
    while not left.isEmpty():
        first = lambda end: left.groupBy(*keys, end).agg(F.min("__turn").alias("__turn"))
        now = written(left.join(first(one), [*keys, one, "__turn"], "left_semi").join(first(two), [*keys, two, "__turn"], "left_semi"), "taken")
        taken = now if taken is None else taken.union(now)
        rest = left.join(now.select(*keys, one), [*keys, one], "left_anti").join(now.select(*keys, two), [*keys, two], "left_anti")
        left = written(rest, "pairs")
    return pairs.limit(0) if taken is None else taken.select(*pairs.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, knot) of the nodes of edges (a long, b long): the least node that they reach.

    Every node takes the least label around it, then its label's label (so that labels run along a chain in few rounds), until nothing changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("knot")), "knots")
    while True:
        around = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("knot").alias("least"))
        near = label.join(around, "node").select("node", F.least("knot", "least").alias("knot"))
        far = label.select(F.col("node").alias("knot"), F.col("knot").alias("next"))
        new = written(near.join(far, "knot", "left").select("node", F.least("knot", F.coalesce("next", "knot")).alias("knot")), "knots")
        if new.join(label, ["node", "knot"], "left_anti").isEmpty():
            return new
        label = new


def hull_knots(boxes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """boxes (keys, id long, corners) with their knot: groups of boxes whose hulls don't overlap, so that averages of one meet nothing of another.

    Overlapping boxes are one knot; a knot's hull may reach over other boxes that none of its own does, so knots with overlapping hulls are joined until
    there are none. A fused box is an average of members, so it stays inside the hull.
    """
    now = boxes.withColumn("knot", F.col("id"))
    while True:
        hull = now.groupBy(*keys, F.col("knot").alias("id")).agg(*[(F.min if c in ("x1", "y1") else F.max)(c).alias(c) for c in CORNERS])
        hull = written(hull, "hulls")
        pairs = grid_pairs(hull, hull, keys).where("t_id < d_id")
        edges = written(pairs.select(F.col("t_id").alias("a"), F.col("d_id").alias("b")), "edges")
        if edges.isEmpty():
            return now
        found = components(edges).select(F.col("node").alias("knot"), F.col("knot").alias("to"))
        now = written(now.join(found, "knot", "left").withColumn("knot", F.coalesce("to", "knot")).drop("to").select(*now.columns), "knots")
