"""Dataset engineering: merging, remapping, deduplication, splits, weights and resampling of annotation tables.

boxes: image_id, line_no, class_id, cx, cy, w, h; images: dataset, split, stem. Whatever is drawn is drawn by a seeded hash of a key, so
results repeat on any partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.draws import draw, hashed
from partita.functions.geometry import Box, box, iou, to_corners
from partita.operators.detection import keep_apart, ordered
from partita.operators.pairs import MOST, box_pairs, by_size
from partita.operators.ranges import LONG, in_ranges, lagged, previous, quantiles, running
from partita.operators.rounds import apart_by_rounds, centres_apart_by_rounds
from partita.sources.storage import written

CENTRE = ("cx", "cy", "w", "h")


def merge_images(sources: dict[str, tuple[DataFrame, DataFrame]], prefix: bool = True) -> DataFrame:
    """Images (stem) that have labels, of several sources by name: source, stem, name.

    sources: name to (images, labels), labels having a stem too. Names are prefix_stem; a name taken before gets _1, _2, ... in order of source
    and stem. Images without labels are skipped.
    """
    parts = [i.select("stem").distinct().join(l.select("stem").distinct(), "stem").select(F.lit(k).alias("rank"), F.lit(n).alias("source"), "stem", (F.concat_ws("_", F.lit(n), "stem") if prefix else F.col("stem")).alias("base")) for k, (n, (i, l)) in enumerate(sources.items())]
    every = reduce(DataFrame.unionByName, parts)
    turn = F.row_number().over(Window.partitionBy("base").orderBy("rank", "stem")) - 1
    return every.withColumn("turn", turn).select("source", "stem", F.when(F.col("turn") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("turn").cast("string"))).alias("name"))


def remap(boxes: DataFrame, table: DataFrame, keep_others: bool = False) -> DataFrame:
    """Class ids by a table (old_id, new_id): -1 and, unless keep_others, ids that it lacks are dropped. The table is a taxonomy, so it is broadcast."""
    both = boxes.join(F.broadcast(table), F.col("class_id") == F.col("old_id"), "left")
    new = F.coalesce("new_id", "class_id") if keep_others else F.col("new_id")
    return both.withColumn("class_id", new.cast("int")).where("class_id IS NOT NULL AND class_id <> -1").drop("old_id", "new_id")


def remap_rejects(boxes: DataFrame, table: DataFrame) -> DataFrame:
    """The boxes whose class a table lacks: for a quarantine, instead of a guess."""
    return boxes.join(F.broadcast(table), F.col("class_id") == F.col("old_id"), "left_anti")


def remap_coverage(boxes: DataFrame, table: DataFrame) -> DataFrame:
    """Boxes by what a table does with them: mapped, dropped (-1) or unknown; and per new class."""
    both = boxes.join(F.broadcast(table), F.col("class_id") == F.col("old_id"), "left")
    fate = F.when(F.col("new_id").isNull(), "unknown").when(F.col("new_id") == -1, "dropped").otherwise("mapped")
    return both.groupBy(fate.alias("fate"), F.when(F.col("new_id") >= 0, F.col("new_id")).alias("new_id")).agg(F.count("*").alias("n"), F.count_distinct("class_id").alias("old_classes"))


def single_class(boxes: DataFrame, images: DataFrame, class_id: int, prefix: str, start: int = 0) -> DataFrame:
    """All boxes under one class, and their images (image_id, stem) numbered anew in order of stem: image_id, name, line_no, class_id, cx, cy, w, h.

    Images without boxes are skipped and take no number; names are the prefix and six digits from `start` on.
    """
    named = global_rank(images.join(boxes.select("image_id").distinct(), "image_id", "left_semi"), [F.col("stem"), F.col("image_id")])
    named = named.select("image_id", F.concat(F.lit(prefix), F.lpad((F.col("rank") - 1 + start).cast("string"), 6, "0")).alias("name"))
    return boxes.join(named, "image_id").select("image_id", "name", "line_no", F.lit(class_id).alias("class_id"), *CENTRE)


def change_counts(before: DataFrame, after: DataFrame, by: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """What a step took out or changed, by `by`: boxes before, after, removed, and changed (same image_id and line_no, another place or size)."""
    cols = ["image_id", "line_no", *CENTRE]
    old = before.select(*cols, *by)
    new = after.select(*[F.col(c).alias(c if c in ("image_id", "line_no") else f"n_{c}") for c in cols], F.lit(True).alias("there"))
    both = old.join(new, ["image_id", "line_no"], "left")
    moved = F.coalesce(F.col("there"), F.lit(False)) & ~(F.col("cx").eqNullSafe(F.col("n_cx")) & F.col("cy").eqNullSafe(F.col("n_cy")) & F.col("w").eqNullSafe(F.col("n_w")) & F.col("h").eqNullSafe(F.col("n_h")))
    return both.groupBy(*by).agg(F.count("*").alias("before"), F.count("there").alias("after"), F.count_if(F.col("there").isNull()).alias("removed"), F.count_if(moved).alias("changed"))


def merge_totals(boxes: DataFrame) -> DataFrame:
    """Boxes and images of merged sources, by source and class, by source, and in all (NULL for what is summed over)."""
    return boxes.groupingSets([["source", "class_id"], ["source"], []], "source", "class_id").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


def drop_repeated_lines(lines: DataFrame) -> DataFrame:
    """Lines (file_id, line_no, line) less those equal to the line before them; later repeats stay."""
    before = F.lag("line").over(Window.partitionBy("file_id").orderBy("line_no"))
    first = F.row_number().over(Window.partitionBy("file_id").orderBy("line_no")) == 1
    return lines.withColumn("__same", ~first & F.col("line").eqNullSafe(before)).where("NOT __same").drop("__same")


def _marked(lines: DataFrame) -> DataFrame:
    """Whether a line repeats the one before in its file; files of very many lines spread over ranges of lines."""
    rows = previous(lines, ("file_id",), ["line_no"], {"__before": "line"})
    return rows.withColumn("same", F.coalesce(F.col("line") == F.col("__before"), F.lit(False))).drop("__before")


def repeated_report(lines: DataFrame, by: tuple[str, ...] = ("prefix",)) -> DataFrame:
    """Lines, repeated lines and files by each of `by` (a prefix, a split), by their combinations and in all (NULL for what is summed over)."""
    return _marked(lines).cube(*by).agg(F.count("*").alias("n"), F.count_if("same").alias("repeated"), F.count_distinct("file_id").alias("files"))


def most_repeated(lines: DataFrame, n: int = 10) -> DataFrame:
    """The n files with most repeated lines: file_id, repeated, lines."""
    return _marked(lines).groupBy("file_id").agg(F.count_if("same").alias("repeated"), F.count("*").alias("lines")).where("repeated > 0").orderBy(F.desc("repeated"), "file_id").limit(n)


def near_duplicate_boxes(boxes: DataFrame, threshold: float = 0.7, most: int = MOST) -> DataFrame:
    """Boxes that no kept earlier box of their image and class overlaps by the threshold; dropped boxes suppress nothing.

    An image and class of up to `most` boxes is folded in one place, larger ones go by rounds over the pairs of a grid.
    """
    keys, fields = ("image_id", "class_id"), ("line_no", *CENTRE)

    def clash(k: Column, x: Column) -> Column:
        return iou(to_corners(Box(*(k[c] for c in CENTRE))), to_corners(Box(*(x[c] for c in CENTRE)))) >= threshold

    def folded(rows: DataFrame) -> DataFrame:
        groups = ordered(rows, list(keys), [F.col("line_no")], list(fields))
        return groups.select(*keys, F.explode(keep_apart(F.col("xs"), clash)).alias("x")).select(*keys, *[f"x.{c}" for c in fields])

    def rounds(rows: DataFrame) -> DataFrame:
        cornered = rows.select("*", *to_corners(box(names=CENTRE)).named("x1", "y1", "x2", "y2"))
        return apart_by_rounds(cornered, keys, "line_no", F.col("line_no"), lambda v: v >= threshold).select(*keys, *fields)

    return by_size(boxes.select(*keys, *fields), keys, folded, rounds, most)


def merge_overlapping(boxes: DataFrame, threshold: float = 0.5, most: int = LONG) -> DataFrame:
    """Boxes of an image and class merged from left to right while their spans in x overlap by the threshold (1-D IoU): average centre, largest size, members.

    Where the distance to the centre before is more than half of the largest width so far and half of its own, a box can't overlap what lies left
    of it: there the order is cut, and each stretch is folded for itself. The cuts of groups of more than `most` boxes are found over ranges.
    """
    keys, order = ("image_id", "class_id"), ["cx", "line_no"]
    rows = boxes.select(*keys, "line_no", *CENTRE)
    state = "struct<done:array<struct<cx:double,cy:double,w:double,h:double,n:int>>,open:struct<cx:double,cy:double,w:double,h:double,n:int>>"

    def add(s: Column, x: Column) -> Column:
        c = s["open"]
        common = F.greatest(F.lit(0.0), F.least(c["cx"] + c["w"] / 2, x["cx"] + x["w"] / 2) - F.greatest(c["cx"] - c["w"] / 2, x["cx"] - x["w"] / 2))
        union = c["w"] + x["w"] - common
        joins = F.coalesce(F.when(union > 0, common / F.when(union > 0, union)).otherwise(0.0) > threshold, F.lit(False))
        n = c["n"]
        merged = F.struct(((c["cx"] * n + x["cx"]) / (n + 1)).alias("cx"), ((c["cy"] * n + x["cy"]) / (n + 1)).alias("cy"), F.greatest(c["w"], x["w"]).alias("w"), F.greatest(c["h"], x["h"]).alias("h"), (n + 1).alias("n"))
        new = F.struct(*[x[f].alias(f) for f in CENTRE], F.lit(1).alias("n"))
        closed = F.when(c.isNull() | joins, s["done"]).otherwise(F.concat(s["done"], F.array(c)))
        return F.struct(closed.alias("done"), F.when(joins, merged).otherwise(new).alias("open")).cast(state)

    def cut(rows: DataFrame, widest: Column, before: Column) -> Column:
        return F.coalesce(F.col("cx") - before > (widest + F.col("w")) / 2, F.lit(False)).cast("int")

    def windows(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        marked = rows.withColumn("__cut", cut(rows, F.max("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lag("cx").over(w)))
        return marked.withColumn("__stretch", F.sum("__cut").over(w))

    def ranges(rows: DataFrame) -> DataFrame:
        wide = running(rows, keys, order, "__wide", "w", "max")
        marked = lagged(wide, keys, order, {"__before": "cx", "__widest": "__wide"}).withColumn("__cut", cut(rows, F.col("__widest"), F.col("__before")))
        return running(marked, keys, order, "__stretch", "__cut").select(*rows.columns, "__cut", "__stretch")

    placed = by_size(rows, keys, windows, ranges, most)
    groups = ordered(placed, [*keys, "__stretch"], [F.col(c) for c in order], list(CENTRE))
    start = F.struct(F.array().alias("done"), F.lit(None).alias("open")).cast(state)
    merged = F.aggregate("xs", start, add, lambda s: F.concat(s["done"], F.array(s["open"])))
    return groups.select(*keys, F.explode(merged).alias("m")).select(*keys, "m.*")


def keep_largest(boxes: DataFrame, near: float = 0.05, most: int = MOST) -> DataFrame:
    """Boxes by area, largest first; one goes if its centre is within `near` in x and y of a kept one of its image and class. Large groups go by rounds."""
    keys, fields, area = ("image_id", "class_id"), ("line_no", *CENTRE), F.col("w") * F.col("h")
    clash = lambda k, x: (F.abs(k["cx"] - x["cx"]) < near) & (F.abs(k["cy"] - x["cy"]) < near)

    def folded(rows: DataFrame) -> DataFrame:
        groups = ordered(rows, list(keys), [F.desc(area), F.col("line_no")], list(fields))
        return groups.select(*keys, F.explode(keep_apart(F.col("xs"), clash)).alias("x")).select(*keys, *[f"x.{c}" for c in fields])

    return by_size(boxes.select(*keys, *fields), keys, folded, lambda rows: centres_apart_by_rounds(rows, keys, "line_no", F.struct(-area, "line_no"), near), most)


def size_split(images: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """split: exactly n keys (all, if fewer) go to val, those of the least draws; ranks come from two passes over ranges."""
    ranked = global_rank(images.withColumn("__u", draw(F.col(key), seed)), [F.col("__u"), F.col(key)])
    return ranked.withColumn("split", F.when(F.col("rank") <= n, "val").otherwise("train")).drop("rank", "__u")


def hash_split(images: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """split: val for about `share` of the keys, train for the others; rows of one key stay together."""
    return images.withColumn("split", F.when(draw(F.col(key), seed) < share, "val").otherwise("train"))


def every_nth(images: DataFrame, key: str, n: int = 10) -> DataFrame:
    """split: every n-th image in key order goes to val. Ranks are counted per range of keys first, so no task sees all images."""
    ranked = global_rank(images, [F.col(key)])
    return ranked.withColumn("split", F.when(F.col("rank") % n == 0, "val").otherwise("train")).drop("rank")


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """rank from 1 over a total order, in two passes: ranks inside range partitions, and the counts of the partitions before.

    The ranges come from a sample, so the ranked rows are written: counting them again would draw other ranges. There are as many as the data need.
    """
    placed = in_ranges(df, order)
    placed = placed.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn("rank", (F.col("__local") + F.col("__before")).cast("long")).drop("__part", "__local", "__before")


def stratified_split(boxes: DataFrame, share: float = 0.2, few: int = 100, seed: int = 42) -> DataFrame:
    """image_id, split. Classes of under `few` images put max(1, a tenth) of theirs into val; then val is filled by hash to its share of all images.

    The places of the others in the order of the draw come from two passes over ranges, so no task holds the part to be filled.
    """
    pairs = boxes.select("image_id", "class_id").distinct().withColumn("u", draw(F.col("image_id"), seed))
    n = pairs.groupBy("class_id").agg(F.count("*").alias("n"))
    rare = pairs.join(F.broadcast(n), "class_id").where(F.col("n") < few)
    quota = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    turn = F.row_number().over(Window.partitionBy("class_id").orderBy("u", "image_id"))
    first = rare.withColumn("k", turn).where(F.col("k") <= quota).select("image_id").distinct()
    images = pairs.select("image_id", "u").distinct()
    marked = images.join(first.withColumn("first", F.lit(True)), "image_id", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    ranked = global_rank(marked, [F.desc("first"), F.col("u"), F.col("image_id")])
    sums = marked.agg(F.floor(F.count("*") * share).alias("fill"), F.count_if("first").alias("taken"))
    return ranked.crossJoin(F.broadcast(sums)).select("image_id", F.when(F.col("rank") <= F.greatest("fill", "taken"), "val").otherwise("train").alias("split"))


def class_counts(boxes: DataFrame) -> DataFrame:
    """class_id, n, images, and the average per image that has the class."""
    return boxes.groupBy("class_id").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images")).withColumn("per_image", F.col("n") / F.col("images"))


def repeat_counts(boxes: DataFrame, images: DataFrame, cap: int = 10) -> DataFrame:
    """image_id, weight, repeat: the weight of an image is the largest 1 / sqrt(boxes of class) over its classes, repeats are weight over the least weight, rounded half to even, 1 to cap.

    Images without boxes weigh the least weight.
    """
    w = boxes.groupBy("class_id").agg((1 / F.sqrt(F.count("*"))).alias("w"))
    own = boxes.select("image_id", "class_id").distinct().join(F.broadcast(w), "class_id").groupBy("image_id").agg(F.max("w").alias("weight"))
    least = own.agg(F.min("weight").alias("least"))
    both = images.select("image_id").distinct().join(own, "image_id", "left").crossJoin(F.broadcast(least)).withColumn("weight", F.coalesce("weight", "least"))
    times = F.greatest(F.lit(1), F.least(F.lit(cap), F.bround(F.col("weight") / F.col("least"), 0).cast("int")))
    return both.select("image_id", "weight", F.coalesce(times, F.lit(1)).alias("repeat"))


def effective_counts(boxes: DataFrame, repeats: DataFrame) -> DataFrame:
    """Boxes of each class before and after repetition, and the boost."""
    return boxes.join(repeats, "image_id").groupBy("class_id").agg(F.count("*").alias("n"), F.sum("repeat").alias("effective")).withColumn("boost", F.col("effective") / F.col("n"))


def imbalance(counts: DataFrame, column: str = "n") -> DataFrame:
    """The largest over the smallest positive count."""
    return counts.where(F.col(column) > 0).agg((F.max(column) / F.min(column)).alias("imbalance"))


def class_weights(counts: DataFrame, how: str = "inverse", beta: float = 0.9999) -> DataFrame:
    """class_id, weight over the least weight (1 at least): inverse, inverse_sqrt or effective (number of samples). Classes without boxes get NULL."""
    n = F.when(F.col("n") > 0, F.col("n"))
    raw = {"inverse": 1 / n, "inverse_sqrt": 1 / F.sqrt(n), "effective": (1 - beta) / (1 - F.pow(F.lit(beta), n))}[how]
    out = counts.select("class_id", raw.alias("raw"))
    return out.crossJoin(F.broadcast(out.agg(F.min("raw").alias("least")))).select("class_id", (F.col("raw") / F.col("least")).alias("weight"))


def quality_weights(counts: DataFrame, ap: DataFrame, how: str = "both") -> DataFrame:
    """1 / sqrt(n / 1000) (how: count), 1 / (ap + 0.1) (quality) or their mean (both), brought to 1..10 over the classes; all 1 if they are equal. A class without an ap counts as 1.0."""
    by_count, by_quality = 1 / F.sqrt(F.col("n") / 1000), 1 / (F.coalesce("ap", F.lit(1.0)) + 0.1)
    value = {"count": by_count, "quality": by_quality, "both": (by_count + by_quality) / 2}[how]
    raw = counts.join(ap, "class_id", "left").where("n > 0").select("class_id", value.alias("raw"))
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    return raw.crossJoin(F.broadcast(ends)).select("class_id", F.coalesce(1 + 9 * (F.col("raw") - F.col("lo")) / span, F.lit(1.0)).alias("weight"))


def image_weights(boxes: DataFrame, images: DataFrame, weights: DataFrame) -> DataFrame:
    """image_id, weight: the largest class weight of its boxes, 1 at least."""
    top = boxes.join(F.broadcast(weights), "class_id").groupBy("image_id").agg(F.max("weight").alias("top"))
    return images.select("image_id").distinct().join(top, "image_id", "left").select("image_id", F.greatest(F.lit(1.0), F.coalesce("top", F.lit(1.0))).alias("weight"))


def ramped(weights: DataFrame, epoch: int, warmup: int) -> DataFrame:
    """Weights of an epoch: 1 + (w - 1) scaled by epoch / warmup up to 1, always from the base weights."""
    scale = min(1.0, epoch / warmup) if warmup > 0 else 1.0
    return weights.withColumn("weight", 1 + (F.col("weight") - 1) * scale)


def weighted_sample(weights: DataFrame, key: str, n: int, replacement: bool = False, seed: int = 42) -> DataFrame:
    """n keys by weight. Without replacement the n largest ln(u) / w; with it, n draws meet the running sum of weights in a range join."""
    u = draw(F.col(key), seed)
    if not replacement:
        scored = weights.withColumn("__s", F.log(F.greatest(u, F.lit(1e-12))) / F.col("weight"))
        return global_rank(scored, [F.desc("__s"), F.col(key)]).where(F.col("rank") <= n).drop("__s", "rank")
    spark = weights.sparkSession
    ranked = global_rank(weights, [F.col(key)])
    parts = ranked.withColumn("part", F.floor(F.col("rank") / 4096))
    sums = parts.groupBy("part").agg(F.sum("weight").alias("s"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for 4096 keys
    sums = sums.select("part", F.coalesce(F.sum("s").over(upto), F.lit(0.0)).alias("base"))
    total = weights.agg(F.sum("weight")).first()[0] or 0.0
    running = F.sum("weight").over(Window.partitionBy("part").orderBy("rank"))
    spans = parts.withColumn("hi", running).join(sums, "part").select(key, "weight", (F.col("base") + F.col("hi") - F.col("weight")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))
    width = max(total / 1024, 1e-12)
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    draws = spark.range(n).select(F.col("id").alias("draw"), (draw(F.col("id"), seed) * total).alias("at")).withColumn("cell", F.floor(F.col("at") / width))
    return draws.join(cells, "cell").where("at >= lo AND at < hi").select("draw", key, "weight")


def tail_classes(counts: DataFrame, taxonomy: DataFrame, n: int) -> DataFrame:
    """The n classes of a taxonomy with fewest boxes, classes without any included."""
    return taxonomy.select("class_id").join(counts.select("class_id", "n"), "class_id", "left").fillna(0, ["n"]).orderBy("n", "class_id").limit(n)


def background_preference(boxes: DataFrame, heads: tuple[int, ...]) -> DataFrame:
    """Images by the share of boxes of the head classes, largest first: image_id, share, place."""
    share = boxes.groupBy("image_id").agg(F.avg(F.col("class_id").isin(*heads).cast("int")).alias("share"))
    return global_rank(share, [F.desc("share"), F.col("image_id")]).withColumnRenamed("rank", "place")


def paste_plan(boxes: DataFrame, tails: DataFrame, target: int, per_image: int = 5, tries: int = 8, least: float = 0.03, seed: int = 42) -> DataFrame:
    """Where crops of rare classes go: class_id, source_image, source_line, image_id, cx, cy, w, h.

    A class lacks target - n boxes. Its crops (both sides at least `least`) are offered to images by hash, `tries` places each, until the lack
    is filled, at most per_image an image; places that overlap a box there by more than IoU 0.1 are left out. Nothing is drawn in pixels.
    The first offers of a class are told by ranks in two passes over ranges, so a class may have any number of them.
    """
    lack = tails.select("class_id", F.greatest(F.lit(0), F.lit(target) - F.col("n")).alias("lack")).where("lack > 0")
    crops = boxes.where((F.col("w") >= least) & (F.col("h") >= least)).join(F.broadcast(lack), "class_id")
    images = global_rank(boxes.select("image_id").distinct(), [F.col("image_id")])
    n = images.count()
    offers = crops.select("class_id", "lack", F.col("image_id").alias("source_image"), F.col("line_no").alias("source_line"), "w", "h", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    key = F.concat_ws("/", "source_image", "source_line", "try")
    offers = offers.withColumn("rank", F.floor(draw(key, seed) * n) + 1).join(images, "rank")
    offers = offers.withColumn("cx", F.col("w") / 2 + draw(key, seed + 1) * (1 - F.col("w"))).withColumn("cy", F.col("h") / 2 + draw(key, seed + 2) * (1 - F.col("h")))
    cornered = lambda df: df.select("*", *to_corners(box("", CENTRE)).named("x1", "y1", "x2", "y2"))
    offer = ["image_id", "class_id", "source_image", "source_line", "try"]
    meets = box_pairs(cornered(boxes.select("image_id", *CENTRE)), cornered(offers.select(*offer, *CENTRE))).where(F.col("iou") > 0.1)
    free = offers.join(meets.select("image_id", *[F.col(f"d_{c}").alias(c) for c in offer[1:]]), offer, "left_anti")
    free = free.withColumn("turn", hashed(key))
    a = F.row_number().over(Window.partitionBy("image_id").orderBy("turn", "class_id", "source_image", "source_line"))
    ranked = global_rank(free.withColumn("a", a).where(F.col("a") <= per_image), [F.col("class_id"), F.col("turn"), F.col("source_image"), F.col("source_line")])
    before = ranked.groupBy("class_id").agg(F.min("rank").alias("before"))  # a row a class
    return ranked.join(F.broadcast(before), "class_id").where("rank - before < lack").select("class_id", "source_image", "source_line", "image_id", *CENTRE)


def quality_subset(boxes: DataFrame, priority: tuple[int, ...], n: int) -> DataFrame:
    """The n images of the highest score: ten for each box of the priority classes, one for each box."""
    score = F.sum(F.when(F.col("class_id").isin(*priority), 10).otherwise(0)) + F.count("*")
    scored = boxes.groupBy("image_id").agg(score.alias("score"))
    return global_rank(scored, [F.desc("score"), F.col("image_id")]).where(F.col("rank") <= n).drop("rank")


def clean(boxes: DataFrame, images: DataFrame, prefixes: tuple[str, ...], sparse_prefix: str, few: int = 2, tiny: float = 0.003) -> DataFrame:
    """Boxes of images (image_id, stem) that stay: no listed prefix, not sparse (sparse_prefix and at most `few` boxes), and not tiny on both sides."""
    n = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    bad = reduce(lambda a, b: a | b, [F.col("stem").startswith(p) for p in prefixes], F.lit(False))
    kept = images.join(n, "image_id", "left").fillna(0, ["n"]).where(~bad & ~(F.col("stem").startswith(sparse_prefix) & (F.col("n") <= few)))
    return boxes.join(kept.select("image_id"), "image_id", "left_semi").where(~F.coalesce((F.col("w") < tiny) & (F.col("h") < tiny), F.lit(False)))


def integrity(images: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """kind, n: images without labels, labels without images, boxes whose class is out of range, pairs."""
    orphan_i = images.join(labels, "stem", "left_anti").agg(F.count("*").alias("n")).select(F.lit("image_without_label").alias("kind"), "n")
    orphan_l = labels.select("stem").distinct().join(images, "stem", "left_anti").agg(F.count("*").alias("n")).select(F.lit("label_without_image").alias("kind"), "n")
    bad = labels.agg(F.count_if((F.col("class_id") < 0) | (F.col("class_id") >= classes)).alias("n")).select(F.lit("class_out_of_range").alias("kind"), "n")
    pairs = images.join(labels.select("stem").distinct(), "stem", "left_semi").agg(F.count("*").alias("n")).select(F.lit("pair").alias("kind"), "n")
    return orphan_i.union(orphan_l).union(bad).union(pairs)


def range_errors(boxes: DataFrame) -> DataFrame:
    """Boxes with errors (array): centre, size or edge out of [0, 1], NULLs and NaN included."""
    inside = lambda c, lo, hi: F.coalesce((c >= lo) & (c <= hi) & ~F.isnan(c), F.lit(False))
    cx, cy, w, h = (F.col(c) for c in CENTRE)
    size = lambda c: F.coalesce((c > 0) & (c <= 1) & ~F.isnan(c), F.lit(False))
    errors = F.array_compact(F.array(F.when(~(inside(cx, 0, 1) & inside(cy, 0, 1)), "centre"), F.when(~(size(w) & size(h)), "size"), F.when(~(inside(cx - w / 2, 0, 1) & inside(cx + w / 2, 0, 1) & inside(cy - h / 2, 0, 1) & inside(cy + h / 2, 0, 1)), "edge")))
    return boxes.withColumn("errors", errors).where(F.size("errors") > 0)


def image_statistics(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes per image (0 counts): images, mean, median, population deviation, coefficient of variation."""
    n = images.select("image_id").distinct().join(boxes.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left").fillna(0, ["n"])
    out = n.agg(F.count("*").alias("images"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    out = out.join(quantiles(n, (), F.col("n"), {"median": 0.5}), how="left")  # a row each
    return out.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.when(F.col("mean") > 0, F.col("mean"))))


def concentration(boxes: DataFrame, k: int = 4, small: float = 0.05) -> DataFrame:
    """Share of the k most frequent classes, a label for it, and the share of small boxes."""
    counts = boxes.groupBy("class_id").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "class_id").limit(k).agg(F.sum("n").alias("top"))
    share = F.col("top") / F.col("n")
    every = boxes.agg(F.count("*").alias("n"), F.avg(((F.col("w") < small) & (F.col("h") < small)).cast("int")).alias("small_share"))
    return top.crossJoin(every).select(share.alias("top_share"), F.when(share > 0.8, "high").when(share > 0.6, "medium").otherwise("low").alias("concentration"), "small_share")


def size_variety(boxes: DataFrame, digits: int = 3) -> DataFrame:
    """Per class: different sizes after rounding (halves to even), and the coefficients of variation of both sides."""
    return boxes.groupBy("class_id").agg(F.count_distinct(F.struct(F.bround("w", digits), F.bround("h", digits))).alias("sizes"), (F.stddev_pop("w") / F.avg("w")).alias("cv_w"), (F.stddev_pop("h") / F.avg("h")).alias("cv_h"))


def repair_statistics(stages: dict[str, DataFrame], thin: float = 0.04) -> DataFrame:
    """Before and after a repair, by stage and class: boxes, least, most, mean and median width, share of thin ones."""
    parts = [df.select(F.lit(n).alias("stage"), "class_id", "w") for n, df in stages.items()]
    rows, keys = reduce(DataFrame.unionByName, parts), ["stage", "class_id"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("most"), F.avg("w").alias("mean"), F.avg((F.col("w") < thin).cast("int")).alias("thin_share"))
    return out.join(quantiles(rows, ("stage", "class_id"), F.col("w"), {"median": 0.5}), keys, "left")


def prefix_counts(images: DataFrame, source: Column) -> DataFrame:
    """split, source, n: images of each split by the source that their name tells, and of each split in all (source NULL)."""
    return images.withColumn("source", source).groupingSets([("split", "source"), ("split",)], "split", "source").agg(F.count("*").alias("n"), F.grouping("source").alias("all")).select("split", F.when(F.col("all") == 0, F.col("source")).alias("source"), "n")


def renumbered(pairs: DataFrame, prefix: str, digits: int = 4) -> DataFrame:
    """Image and label of each pair (stem, suffix) under one new name: stem, image, label, numbered from 0 by stem, so that they can't come apart."""
    number = F.lpad((F.col("rank") - 1).cast("string"), digits, "0")
    name = F.concat(F.lit(f"{prefix}_"), F.when(F.length((F.col("rank") - 1).cast("string")) > digits, (F.col("rank") - 1).cast("string")).otherwise(number))
    return global_rank(pairs, [F.col("stem")]).select("stem", F.concat(name, "suffix").alias("image"), F.concat(name, F.lit(".txt")).alias("label"))


def repairs_by_kind(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, class_id, n, and the mean area before and after: boxes (image_id, line_no) that a repair widened, shrank, moved, dropped or left alone."""
    a, b = (df.select("image_id", "line_no", *[F.col(c).alias(f"{p}{c}") for c in ("class_id", *CENTRE)]) for df, p in ((before, "a_"), (after, "b_")))
    both = a.join(b, ["image_id", "line_no"], "left")
    one, two = F.col("a_w") * F.col("a_h"), F.col("b_w") * F.col("b_h")
    kind = F.when(F.col("b_class_id").isNull(), "dropped").when(two < one, "shrunk").when(two > one, "widened").when((F.col("a_cx") != F.col("b_cx")) | (F.col("a_cy") != F.col("b_cy")), "moved").otherwise("same")
    return both.select(kind.alias("kind"), F.col("a_class_id").alias("class_id"), one.alias("one"), two.alias("two")).groupBy("kind", "class_id").agg(F.count("*").alias("n"), F.avg("one").alias("area_before"), F.avg("two").alias("area_after"))
