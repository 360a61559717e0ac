"""Score assembly: from staff lines, symbols and noteheads to measures, voices and chords.

Symbols: image_id, sym_id, cx, cy (pixels) and what an operator names. Staves: image_id, staff_idx, line_ys, spacing, top, x_min, x_max.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.pitch import beat_in_measure, lookup, staff_pitch, staff_step
from partita.operators.detection import keep_apart, ordered
from partita.operators.pairs import by_size, crowded
from partita.operators.ranges import LONG, lagged, running


def sessions(df: DataFrame, keys: list[str], order: str, cut, name: str) -> DataFrame:
    """A running number of the groups into which `cut` (a predicate on the gap to the row before) divides the rows of a key."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.col(order) - F.lag(order).over(w)
    return df.withColumn(name, F.sum(F.when(F.coalesce(cut(gap), F.lit(False)), 1).otherwise(0)).over(w))


def merge_peaks(peaks: DataFrame, gap: float = 3) -> DataFrame:
    """Staff-line peaks (image_id, y): peaks within `gap` of the one before are one line, at the last of them."""
    return sessions(peaks, ["image_id"], "y", lambda d: d > gap, "line").groupBy("image_id", "line").agg(F.max("y").alias("y")).select("image_id", "y")


def group_staves(lines: DataFrame, factor: float = 2.5, whole: int = 5) -> DataFrame:
    """Lines (image_id, y) to staves: staff_idx, line_ys, spacing (mean gap), top, bottom.

    A run ends where the gap is over factor times the image's median gap. Runs are cut into fives; what is shorter is dropped.
    """
    w = Window.partitionBy("image_id").orderBy("y")
    gaps = lines.withColumn("gap", F.col("y") - F.lag("y").over(w))
    gaps = gaps.join(gaps.groupBy("image_id").agg((F.median("gap") * factor).alias("limit")), "image_id")
    runs = gaps.withColumn("run", F.sum(F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)).over(w))
    turn = F.row_number().over(Window.partitionBy("image_id", "run").orderBy("y")) - 1
    fives = runs.withColumn("five", F.floor(turn / whole)).groupBy("image_id", "run", "five").agg(F.array_sort(F.collect_list("y")).alias("line_ys")).where(F.size("line_ys") == whole)
    index = F.row_number().over(Window.partitionBy("image_id").orderBy("run", "five")) - 1
    first, last = F.element_at("line_ys", 1).cast("double"), F.element_at("line_ys", -1).cast("double")
    return fives.select("image_id", index.alias("staff_idx"), "line_ys", ((last - first) / (whole - 1)).alias("spacing"), first.alias("top"), last.alias("bottom"))


def staff_bounds(staves: DataFrame, lines: DataFrame) -> DataFrame:
    """Staves with x_min and x_max: how far their lines (image_id, y, x1, x2) reach; NULL where a line's reach isn't known."""
    reach = staves.select("image_id", "staff_idx", F.explode("line_ys").alias("y")).join(lines, ["image_id", "y"], "left")
    return staves.join(reach.groupBy("image_id", "staff_idx").agg(F.min("x1").alias("x_min"), F.max("x2").alias("x_max")), ["image_id", "staff_idx"], "left")


def staff_regions(lines: DataFrame, images: DataFrame, gap: float = 60, least: int = 5, default: tuple[float, float] = (0.0, 1000.0)) -> DataFrame:
    """Lines (image_id, y) to regions by a fixed gap: staff_idx, top, bottom, lines.

    A run of at least `least` lines is one region, however many they are; shorter runs are dropped. An image (of `images`) without a
    single line gets the default region; one whose runs are all too short gets none.
    """
    runs = sessions(lines, ["image_id"], "y", lambda d: d > gap, "run").groupBy("image_id", "run").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("lines")).where(F.col("lines") >= least)
    index = (F.row_number().over(Window.partitionBy("image_id").orderBy("run")) - 1).alias("staff_idx")
    found = runs.select("image_id", index, F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), "lines")
    bare = images.select("image_id").distinct().join(lines.select("image_id"), "image_id", "left_anti")
    return found.union(bare.select("image_id", F.lit(0), F.lit(default[0]), F.lit(default[1]), F.lit(0).cast("long")))


def measures(notes: DataFrame, barlines: DataFrame) -> DataFrame:
    """Notes (image_id, sym_id, x) with their measure.

    Boundaries are the least x - 10, the different barlines (image_id, x), and the largest x + 10; intervals are half open. An empty interval is
    dropped unless it is the first; measures count from 1.
    """
    return with_measure(notes.select("image_id", "sym_id", "x"), barlines).select("image_id", "sym_id", "measure")


def with_measure(notes: DataFrame, barlines: DataFrame) -> DataFrame:
    """`notes` (image_id, x and any others) with the measure that `measures` gives them: one shuffle, no join."""
    rest = [f for f in notes.schema if f.name not in ("image_id", "x")]
    both = notes.select("image_id", "x", *[f.name for f in rest], F.lit(False).alias("bar")).union(barlines.select("image_id", "x", *[F.lit(None).cast(f.dataType) for f in rest], F.lit(True)))
    # dealt out anew: Spark 4.1 takes a union of parts dealt by image as dealt by image, though adaptive execution may have joined the partitions of each in its own way
    both = both.repartition("image_id")
    image, order = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("x", ~F.col("bar"))  # at one x the barlines come first
    note = F.when(~F.col("bar"), F.col("x"))
    both = both.withColumns({"lo": F.min(note).over(image) - 10, "hi": F.max(note).over(image) + 10, "left": F.lag("x").over(order)})
    # a boundary opens an interval once, however many barlines stand there
    opens = F.col("bar") & (F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi")) & (F.col("left").isNull() | (F.col("left") < F.col("x")))
    placed = both.withColumn("k", F.count_if(opens).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("bar"))
    rank = F.dense_rank().over(image.orderBy("k"))
    return placed.select(*notes.columns, (rank + (F.min("k").over(image) > 0).cast("int")).alias("measure"))  # an empty first interval keeps its number


def clusters(notes: DataFrame, tolerance: float = 20, keys: tuple[str, ...] = ("image_id",), most: int | None = LONG, carry: tuple[str, ...] = ()) -> DataFrame:
    """Notes (keys, sym_id, x) with the cluster they join from left to right: the current one, if x is within `tolerance` of its running mean.

    The mean never lies right of the last note, so a gap of more than `tolerance` opens a cluster whatever it is: there the order is cut, and each
    stretch is folded for itself. The cuts of groups of more than `most` notes (None: there are none, which saves the count), and the numbers of their
    clusters, come from sums over ranges. carry: columns that go along.
    """
    order = ["x", "sym_id"]
    fields = ["sym_id", "x", *carry]
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("c"), F.array().cast("array<int>").alias("out"))

    def add(s, x):
        near = (s["n"] == 0) | (F.abs(x["x"] - s["sum"] / F.greatest(s["n"], F.lit(1))) <= tolerance)
        c = F.when(near, s["c"]).otherwise(s["c"] + 1)
        return F.struct(F.when(near, s["sum"] + x["x"]).otherwise(x["x"]).cast("double").alias("sum"), F.when(near, s["n"] + 1).otherwise(1).alias("n"), c.alias("c"), F.concat(s["out"], F.array(c)).alias("out"))

    def folded(placed: DataFrame) -> DataFrame:
        groups = ordered(placed, [*keys, "__stretch"], [F.col(c) for c in order], fields)
        return groups.select(*keys, "__stretch", "xs", F.aggregate("xs", start, add, lambda s: F.struct(s["out"].alias("out"), (s["c"] + 1).alias("n"))).alias("f")).select(*keys, "__stretch", "xs", "f.*")

    def numbered(stretches: DataFrame) -> DataFrame:
        rows = stretches.select(*keys, (F.col("upto") - F.col("n")).alias("first"), F.explode(F.arrays_zip("xs", "out")).alias("o"))
        return rows.select(*keys, "o.xs.sym_id", *[f"o.xs.{c}" for c in (("x", *carry) if carry else ())], (F.col("first") + F.col("o.out")).cast("int").alias("cluster"))

    def windows(rows: DataFrame) -> DataFrame:
        found = folded(sessions(rows, list(keys), "x", lambda gap: gap > tolerance, "__stretch"))
        return numbered(found.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("__stretch"))))

    def ranges(rows: DataFrame) -> DataFrame:
        marked = lagged(rows, keys, order, {"__before": "x"}).withColumn("__cut", F.coalesce(F.col("x") - F.col("__before") > tolerance, F.lit(False)).cast("int"))
        found = folded(running(marked, keys, order, "__stretch", "__cut"))
        return numbered(running(found, keys, ["__stretch"], "upto", "n"))

    rows = notes.select(*keys, *fields)
    return windows(rows) if most is None else by_size(rows, keys, windows, ranges, most)


def nearest_staff(notes: DataFrame, staves: DataFrame) -> DataFrame:
    """Notes (image_id, sym_id, y) with the staff whose middle is nearest (the first of equals), their step and distance."""
    return with_staff(notes.select("image_id", "sym_id", "y").distinct(), staves)


def with_staff(notes: DataFrame, staves: DataFrame) -> DataFrame:
    """`notes` (image_id, y and any others) with staff_idx and step of the nearest staff; the staves of an image, which are few, go to its notes as one array."""
    mid = F.col("top") + 2 * F.col("spacing")
    table = staves.groupBy("image_id").agg(F.collect_list(F.struct("staff_idx", "top", "spacing", mid.alias("mid"))).alias("__staves"))
    near = F.array_min(F.transform("__staves", lambda s: F.struct(F.abs(F.col("y") - s["mid"]).alias("d"), s["staff_idx"].alias("staff_idx"), s["top"].alias("top"), s["spacing"].alias("spacing"))))
    both = notes.join(table, "image_id").withColumn("b", near)
    return both.select(*notes.columns, F.col("b.staff_idx").alias("staff_idx"), staff_step(F.col("y"), F.col("b.top"), F.col("b.spacing")).alias("step"))


def bind_voices(notes: DataFrame, staves: DataFrame) -> DataFrame:
    """Chords from notes (image_id, cluster, sym_id, y, staff_idx, midi): image_id, cluster, s, a, t, b (midi), by the number of staves.

    Two staves: the two topmost notes above and below the line between them. Four staves: the topmost note of each. Other layouts, and clusters that
    lack a voice, give nothing.
    """
    mid = F.col("top") + 2 * F.col("spacing")
    layout = staves.groupBy("image_id").agg(F.count("*").alias("staves"), F.avg(mid).alias("border")).where("staves IN (2, 4)")
    n = notes.join(layout, "image_id")
    side = F.when(F.col("staves") == 2, F.when(F.col("y") < F.col("border"), 0).otherwise(1)).otherwise(F.col("staff_idx"))
    n = n.withColumn("side", side).withColumn("k", F.row_number().over(Window.partitionBy("image_id", "cluster", "side").orderBy("y", "sym_id")))
    voice = F.when(F.col("staves") == 2, F.when(F.col("k") <= 2, F.col("side") * 2 + F.col("k") - 1)).otherwise(F.when(F.col("k") == 1, F.col("side")))
    v = n.withColumn("voice", voice).where("voice IS NOT NULL")
    out = v.groupBy("image_id", "cluster").agg(*[F.max(F.when(F.col("voice") == k, F.col("midi"))).alias(c) for k, c in enumerate("satb")])
    return out.where("s IS NOT NULL AND a IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL")


def bind_topmost(notes: DataFrame) -> DataFrame:
    """The four topmost notes of each (image_id, measure, beat) as s, a, t, b."""
    k = F.row_number().over(Window.partitionBy("image_id", "measure", "beat").orderBy("y", "sym_id"))
    four = notes.withColumn("k", k).where("k <= 4").groupBy("image_id", "measure", "beat").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("k") == i + 1, F.col("midi"))).alias(c) for i, c in enumerate("satb")])
    return four.where("n = 4").drop("n")


#: Accidentals by class id.
ACCIDENTAL_CLASSES = {12: "sharp", 13: "flat", 14: "natural", 15: "double_sharp", 16: "double_flat"}


def accidentals_left(notes: DataFrame, symbols: DataFrame, dx: float = 40, dy: float = 15) -> DataFrame:
    """Notes (image_id, sym_id, x, y) with the nearest accidental (image_id, class_id, x, y) to the left: 0 < dx < 40, |dy| < 15; NULL without one."""
    a = symbols.withColumn("accidental", lookup(ACCIDENTAL_CLASSES, F.col("class_id"))).where("accidental IS NOT NULL").select("image_id", F.col("x").alias("ax"), F.col("y").alias("ay"), "accidental")
    near = (F.col("x") - F.col("ax") > 0) & (F.col("x") - F.col("ax") < dx) & (F.abs(F.col("y") - F.col("ay")) < dy)
    both = notes.join(a.withColumnRenamed("image_id", "a_image_id"), (F.col("image_id") == F.col("a_image_id")) & near, "left")
    found = F.min(F.when(F.col("accidental").isNotNull(), F.struct((F.col("x") - F.col("ax")).alias("d"), "ay", "accidental")))
    return both.groupBy(*notes.columns).agg(found.alias("b")).select(*notes.columns, F.col("b.accidental").alias("accidental"))


def resolve_accidentals(notes: DataFrame) -> DataFrame:
    """resolved: an explicit accidental holds for its (image, measure, staff, step) until the next; without these keys only for its own note."""
    w = Window.partitionBy("image_id", "measure", "staff_idx", "step").orderBy("x", "sym_id").rowsBetween(Window.unboundedPreceding, 0)
    keyed = F.col("measure").isNotNull() & F.col("staff_idx").isNotNull() & F.col("step").isNotNull()
    return notes.withColumn("resolved", F.when(keyed, F.last("accidental", ignorenulls=True).over(w)).otherwise(F.col("accidental")))


def assign_clefs(clefs: DataFrame, staves: DataFrame, zone: float = 0.15, reach: float = 5) -> DataFrame:
    """image_id, staff_idx, clef for every staff: clefs (image_id, clef_id, kind, x, y) of the left zone, nearest pairs first, each clef and staff once; treble without one.

    A clef may go to a staff within `reach` spacings of its lines.
    """
    both = staves.select("image_id", "staff_idx").join(_clefs_by_image(clefs, staves, zone, reach), "image_id", "left")
    return both.select("image_id", "staff_idx", F.coalesce(F.try_element_at("won", F.col("staff_idx")), F.lit("treble")).alias("clef"))


def _clefs_by_image(clefs: DataFrame, staves: DataFrame, zone: float = 0.15, reach: float = 5) -> DataFrame:
    """image_id, won (staff_idx to clef), for images in which a clef goes to a staff."""
    s = staves.select("image_id", "staff_idx", "top", "spacing", "x_min", "x_max")
    c = clefs.join(s, "image_id").where((F.col("x") <= F.col("x_min") + zone * (F.col("x_max") - F.col("x_min"))) & (F.col("y") >= F.col("top") - reach * F.col("spacing")) & (F.col("y") <= F.col("top") + (4 + reach) * F.col("spacing")))
    c = c.withColumn("d", F.abs(F.col("y") - F.col("top") - 2 * F.col("spacing")))
    groups = ordered(c, ["image_id"], [F.col("d"), F.col("clef_id"), F.col("staff_idx")], ["clef_id", "staff_idx", "kind"])
    free = keep_apart(F.col("xs"), lambda k, x: (k["clef_id"] == x["clef_id"]) | (k["staff_idx"] == x["staff_idx"]))
    return groups.select("image_id", F.map_from_entries(F.transform(free, lambda k: F.struct(k["staff_idx"], k["kind"]))).alias("won"))


def assemble(symbols: DataFrame, staves: DataFrame, heads: tuple[int, ...], bars: tuple[int, ...], clef_kinds: dict[int, str]) -> DataFrame:
    """Whole assembly: symbols (image_id, sym_id, class_id, x, y) and staves to chords (score_id, chord_index, measure, beat, s, a, t, b, tonic_midi, mode).

    Only complete chords stay; they are counted in order of measure and cluster. Everything is keyed by image.
    """
    notes = symbols.where(F.col("class_id").isin(*heads)).select("image_id", "sym_id", "x", "y")
    kinds = symbols.where(F.col("class_id").isin(*clef_kinds)).select("image_id", F.col("sym_id").alias("clef_id"), lookup(clef_kinds, F.col("class_id")).alias("kind"), "x", "y")
    # everything is keyed by image alone, so symbols dealt by image are not dealt out again but for their measures
    n = with_measure(with_staff(accidentals_left(notes, symbols), staves), symbols.where(F.col("class_id").isin(*bars)).select("image_id", "x"))
    n = resolve_accidentals(n).join(_clefs_by_image(kinds, staves), "image_id", "left").withColumn("clef", F.try_element_at("won", F.col("staff_idx")))
    n = n.withColumn("midi", staff_pitch(F.col("step"), F.coalesce("clef", F.lit("treble")), F.coalesce("resolved", F.lit("natural"))))
    most = None if crowded(notes.select("image_id"), ("image_id",), LONG) is None else LONG  # notes of an image are counted, which is cheap, not those of a measure
    n = clusters(n, keys=("image_id", "measure"), most=most, carry=("y", "staff_idx", "midi"))
    n = n.withColumn("beat", F.col("cluster")).withColumn("cluster", F.col("measure") * 100000 + F.col("cluster"))
    chords = bind_voices(n, staves)
    index = F.row_number().over(Window.partitionBy("image_id").orderBy("cluster")) - 1
    return chords.select(F.col("image_id").alias("score_id"), index.alias("chord_index"), F.floor(F.col("cluster") / 100000).cast("int").alias("measure"), (F.col("cluster") % 100000).cast("double").alias("beat"), "s", "a", "t", "b", F.lit(None).cast("int").alias("tonic_midi"), F.lit(None).cast("string").alias("mode"))


def counters(symbols: DataFrame, chords: DataFrame, violations: DataFrame, heads: tuple[int, ...]) -> DataFrame:
    """Per image: symbols, noteheads, chords and violations."""
    s = symbols.groupBy("image_id").agg(F.count("*").alias("symbols"), F.count_if(F.col("class_id").isin(*heads)).alias("noteheads"))
    c = chords.groupBy(F.col("score_id").alias("image_id")).agg(F.count("*").alias("chords"))
    v = violations.groupBy(F.col("score_id").alias("image_id")).agg(F.count("*").alias("violations"))
    return s.join(c, "image_id", "left").join(v, "image_id", "left").fillna(0, ["chords", "violations"])


#: Dynamics that letters may spell.
DYNAMICS = ("p", "pp", "ppp", "pppp", "mp", "f", "ff", "fff", "ffff", "mf", "sf", "sfz", "sfp", "fp", "fz", "rf", "rfz")


def dynamics(letters: DataFrame, dx: float = 50, dy: float = 20) -> DataFrame:
    """Letters (image_id, sym_id, letter, x1, y1, x2, y2) to words: image_id, dynamic, x1, y1, x2, y2.

    In order of their centres' y and x, a letter joins the one before if its centre lies within dx to the right of that one's and within dy.
    An unknown word that starts with sf is read as sfz, if it has a z, or as sfp, if it has a p; other unknown words are dropped.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    order = Window.partitionBy("image_id").orderBy(cy, cx, "sym_id")
    step = cx - F.lag(cx).over(order)
    joins = F.coalesce((F.abs(cy - F.lag(cy).over(order)) <= dy) & (step >= 0) & (step <= dx), F.lit(False))
    w = letters.withColumn("word", joins).withColumn("k", F.row_number().over(order))
    w = w.withColumn("word", F.sum(F.when(F.col("word"), 0).otherwise(1)).over(Window.partitionBy("image_id").orderBy("k")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "letter"))), lambda x: x["letter"]), "")
    out = w.groupBy("image_id", "word").agg(text.alias("dynamic"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    odd = F.col("dynamic").startswith("sf") & ~F.col("dynamic").isin(*DYNAMICS)
    read = F.when(odd & F.col("dynamic").contains("z"), "sfz").when(odd & F.col("dynamic").contains("p"), "sfp").otherwise(F.col("dynamic"))
    return out.withColumn("dynamic", read).where(F.col("dynamic").isin(*DYNAMICS)).drop("word")


def barlines_of_measures(measures_: DataFrame) -> DataFrame:
    """Measure boxes (image_id, x, y, w, h) to barlines: left edges, and right edges, which are final where a system ends.

    In order of x, as measures are read, a system ends where the next box lies lower or higher by over half its height, or where none is left.
    """
    w = Window.partitionBy("image_id").orderBy("x", "y")
    measures_ = measures_.withColumn("__next", F.lead("y").over(w))
    last = F.col("__next").isNull() | (F.abs(F.col("__next") - F.col("y")) > F.col("h") / 2)
    both = F.array(F.struct(F.col("x").alias("bx"), F.lit("plain").alias("kind")), F.struct((F.col("x") + F.col("w")).alias("bx"), F.when(last, "final").otherwise("plain").alias("kind")))
    return measures_.withColumn("b", F.explode(both)).select("image_id", F.col("b.bx").alias("x"), "y", "h", F.col("b.kind").alias("kind"))


def edge_barlines(boxes: DataFrame, classes: tuple[int, ...] = (3, 4), width: float = 0.005) -> DataFrame:
    """Boxes of measure classes (centre form) to plain barlines at both edges: image_id, line_no, side, cx, cy, w, h."""
    edges = F.array(F.struct(F.lit("left").alias("side"), (F.col("cx") - F.col("w") / 2).alias("x")), F.struct(F.lit("right").alias("side"), (F.col("cx") + F.col("w") / 2).alias("x")))
    both = boxes.where(F.col("class_id").isin(*classes)).withColumn("e", F.explode(edges))
    return both.select("image_id", "line_no", "e.side", F.col("e.x").alias("cx"), "cy", F.lit(width).alias("w"), "h")


def measures_by_count(notes: DataFrame, barlines: DataFrame, most: int = LONG) -> DataFrame:
    """Notes (image_id, sym_id, x) with measure: 1 and the barlines (image_id, x) left of them, from one running sum over both; images of more than `most` of them spread over ranges."""
    sym = notes.schema["sym_id"].dataType
    both = notes.select("image_id", "x", "sym_id", F.lit(0).alias("bar")).union(barlines.select("image_id", "x", F.lit(None).cast(sym), F.lit(1)))
    upto = Window.partitionBy("image_id").orderBy("x", "bar").rowsBetween(Window.unboundedPreceding, 0)  # at one x the notes come first
    rows = by_size(both, ("image_id",), lambda r: r.withColumn("n", F.sum("bar").over(upto)), lambda r: running(r, ("image_id",), ["x", "bar", "sym_id"], "n", "bar"), most)
    return rows.where("sym_id IS NOT NULL").select("image_id", "sym_id", (F.col("n") + 1).cast("int").alias("measure"))


def piece_recall(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Pieces (piece, expected) with what was found (piece, found): the ratio, 0 where nothing was expected or found."""
    both = expected.join(detected, "piece", "left").fillna(0, ["found"])
    return both.select("piece", "expected", "found", F.when(F.col("expected") > 0, F.col("found") / F.when(F.col("expected") > 0, F.col("expected"))).otherwise(0.0).alias("recall"))


def match_pitches(truth: DataFrame, predicted: DataFrame, reach: float = 30) -> DataFrame:
    """Truth notes (image_id, idx, x, y, midi) with the nearest prediction within `reach` pixels (several may share one): pred_midi, distance."""
    p = predicted.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("midi").alias("pm"), F.col("sym_id").alias("pid"))
    d = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    best = truth.join(p, "image_id").withColumn("d", d).where(F.col("d") <= reach).groupBy("image_id", "idx").agg(F.min_by(F.struct("pm", "d"), F.struct("d", "pid")).alias("b"))
    return truth.join(best, ["image_id", "idx"], "left").select("image_id", "idx", "midi", F.col("b.pm").alias("pred_midi"), F.col("b.d").alias("distance"))


def pitch_accuracy(matched: DataFrame, tolerance: int | None = None) -> DataFrame:
    """Per image: notes, exact and lenient accuracy; notes without a prediction count as wrong. Lenient: off by at most `tolerance` semitones, or, without it, by whole octaves."""
    off = F.col("midi") - F.col("pred_midi")
    exact = F.coalesce(off == 0, F.lit(False))
    lenient = F.coalesce(off % 12 == 0 if tolerance is None else F.abs(off) <= tolerance, F.lit(False))
    return matched.groupBy("image_id").agg(F.count("*").alias("notes"), F.count_if(exact).alias("matched"), F.avg(exact.cast("int")).alias("exact"), F.avg(lenient.cast("int")).alias("lenient"))


def pitch_errors(matched: DataFrame) -> DataFrame:
    """image_id, idx, midi, pred_midi, delta of every note that isn't met exactly; NULLs where nothing is near it."""
    return matched.where(~F.coalesce(F.col("midi") == F.col("pred_midi"), F.lit(False))).select("image_id", "idx", "midi", "pred_midi", (F.col("pred_midi") - F.col("midi")).alias("delta"))


def beats_by_barlines(notes: DataFrame, barlines: DataFrame, width: float = 800.0, grid: float = 200.0) -> DataFrame:
    """Notes (image_id, sym_id, x) with measure (1 and the barlines left of them) and beat (a quarter of the way between barlines, from 1).

    The first measure starts at 0, the last is `width` wide. On an image without barlines the measure is 1 and the beat counts steps of `grid`, up to 4.
    """
    sym = notes.schema["sym_id"].dataType
    both = notes.select("image_id", "x", "sym_id", F.lit(0).alias("bar")).union(barlines.select("image_id", "x", F.lit(None).cast(sym), F.lit(1)))
    # at one x the notes come first: a barline there is not left of them
    order, bar = Window.partitionBy("image_id").orderBy("x", "bar"), F.when(F.col("bar") == 1, F.col("x"))
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumns({"n": F.count(bar).over(upto), "left": F.last(bar, ignorenulls=True).over(upto), "right": F.first(bar, ignorenulls=True).over(after)}).where("sym_id IS NOT NULL")
    left = F.coalesce("left", F.lit(0.0))
    beat = beat_in_measure(F.col("x"), left, F.coalesce("right", left + width))
    bare = (1 + F.greatest(F.lit(0), F.least(F.lit(3), (F.col("x") / grid).cast("int")))).cast("double")
    return rows.select("image_id", "sym_id", (F.col("n") + 1).cast("int").alias("measure"), F.when(F.col("left").isNull() & F.col("right").isNull(), bare).otherwise(beat).alias("beat"))
