"""Readers: label text, chord cases, recognised scores, COCO-like JSON, symbol XML, metric CSV, file-name metadata."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from partita.sources.json_stream import json_members
from partita.sources.storage import written


def label_rows(texts: DataFrame, key: str = "file", text: str = "value", strict: bool = False) -> DataFrame:
    """Label lines `class cx cy w h` of whole texts: key, line_no (from 1), class_id, cx, cy, w, h.

    Blank lines, lines of fewer than five fields and fields that aren't numbers are skipped; strict takes lines of exactly five fields.
    """
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    f = F.split(F.btrim(F.regexp_replace("line", r"\s+", " ")), " ")
    ok = F.size("f") == 5 if strict else F.size("f") >= 5
    rows = lines.withColumn("f", f).where(ok).select(key, (F.col("pos") + 1).alias("line_no"), F.get("f", F.lit(0)).try_cast("int").alias("class_id"), *[F.get("f", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))])
    return rows.dropna(subset=["class_id", "cx", "cy", "w", "h"])


def read_labels(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A folder of label files: file, line_no, class_id, cx, cy, w, h."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return label_rows(texts, strict=strict)


def read_label_files(index: DataFrame, path: str, strict: bool = False, share: int = 4096) -> DataFrame:
    """The label files in the folder `path` that an index (file: their names) tells of, as write_labels gives it: the columns of read_labels.

    Tasks open the files of their rows themselves, about `share` each: nothing lists the folder, and the number of tasks doesn't follow from sizes
    that millions of small files don't have.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        for batch in batches:
            files, texts, size = [], [], 0
            for name in batch.column("file").to_pylist():
                with system.open_input_file(f"{root}/{name}") as f:
                    texts.append(f.read())
                files.append(f"{path}/{name}")
                size += len(texts[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.binary())], ["file", "value"])
                    files, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.binary())], ["file", "value"])

    tasks = max(1, -(-index.count() // share))
    texts = index.select("file").repartition(tasks).mapInArrow(get, "file string, value binary")
    return label_rows(texts.select("file", F.col("value").cast("string").alias("value")), strict=strict)


NOTE = "struct<voice:string,midi:int,measure:int,beat:double>"
CASE = f"test_id string, input struct<key_signature:struct<tonic_midi:int,mode:string>,chords:array<struct<index:int,measure:int,beat:double,notes:map<string,{NOTE}>>>>, expected_output struct<violation_count:int,violations:array<struct<rule_id:string,severity:string,message_zh_contains:string>>,cadence:string>"


def chord_cases(cases: DataFrame) -> DataFrame:
    """Parsed cases (schema CASE) to wide chords: score_id, chord_index (list position), measure, beat, s, a, t, b, tonic_midi, mode."""
    rows = cases.select(F.col("test_id").alias("score_id"), F.col("input.key_signature").alias("key"), F.posexplode("input.chords").alias("chord_index", "c"))
    voices = [F.col("c.notes")[v]["midi"].alias(v.lower()) for v in "SATB"]
    return rows.select("score_id", "chord_index", F.col("c.measure").alias("measure"), F.col("c.beat").alias("beat"), *voices, F.col("key.tonic_midi").alias("tonic_midi"), F.col("key.mode").alias("mode"))


def read_chord_cases(spark: SparkSession, path: str) -> DataFrame:
    return chord_cases(spark.read.schema(CASE).json(path, multiLine=True))


def expected_rows(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("test_id").alias("score_id"), F.explode("expected_output.violations").alias("v")).select("score_id", "v.*")


SCORE = "struct<measures:array<struct<index:int,chords:array<struct<beat:double,notes:array<struct<voice:string,pitch:string,duration:double>>>>>>,warnings:array<string>>"


def recognised_notes(scores: DataFrame, key: str = "score_id", column: str = "json") -> DataFrame:
    """Notes of recognised-score JSON: key, measure, chord_index (over the score, measures by index), beat, voice, pitch, duration."""
    m = scores.select(key, F.explode(F.from_json(column, SCORE)["measures"]).alias("m")).select(key, F.col("m.index").alias("measure"), F.posexplode("m.chords").alias("pos", "c"))
    index = F.row_number().over(Window.partitionBy(key).orderBy("measure", "pos")) - 1
    return m.withColumn("chord_index", index).select(key, "measure", "chord_index", F.col("c.beat").alias("beat"), F.explode("c.notes").alias("n")).select(key, "measure", "chord_index", "beat", "n.*")


_IMAGE = "struct<id:string,img_id:string,file_name:string,filename:string,width:double,height:double>"
_ANNOTATION = "struct<id:string,img_id:string,image_id:string,cat_id:string,category_id:string,a_bbox:array<double>,bbox:array<double>>"


def annotation_boxes(files: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """Annotations of COCO-like JSON texts: key, file_name, width, height, ann_id, cat_id, category, x1, y1, x2, y2.

    images, annotations and categories may be lists or maps by id; ids may be called id, img_id or image_id, cat_id (a value or a list; a row
    each) or category_id; a_bbox holds corners, bbox a corner and sides. Annotations without an image are dropped, categories without a
    name give NULL.
    """
    keyed = lambda name, kind: files.select(key, F.explode(F.map_entries(F.from_json(text, f"{name} map<string,{kind}>")[name])).alias("e"))
    listed = lambda name, kind: files.select(key, F.explode(F.from_json(text, f"{name} array<{kind}>")[name]).alias("v"))

    images = listed("images", _IMAGE).select(key, F.coalesce("v.id", "v.img_id").alias("img"), "v")
    images = images.union(keyed("images", _IMAGE).select(key, F.coalesce("e.value.id", "e.value.img_id", "e.key"), "e.value"))
    images = images.select(key, "img", F.coalesce("v.file_name", "v.filename").alias("file_name"), "v.width", "v.height")
    names = listed("categories", "struct<id:string,name:string>").select(key, F.col("v.id").alias("cat_id"), F.col("v.name").alias("category"))
    named = keyed("categories", "string").select(key, "e.key", F.when(F.col("e.value").startswith("{"), F.get_json_object("e.value", "$.name")).otherwise(F.col("e.value")))
    categories = names.union(named).where("cat_id IS NOT NULL")
    notes = listed("annotations", _ANNOTATION).select(key, F.col("v.id").alias("ann_id"), "v")
    notes = notes.union(keyed("annotations", _ANNOTATION).select(key, F.coalesce("e.value.id", "e.key"), "e.value"))
    return _joined(images, notes, categories, key)


def _joined(images: DataFrame, notes: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """Annotations (key, ann_id, v) with their image and the name of each of their categories."""
    cats = F.coalesce("v.cat_id", "v.category_id")
    cats = F.when(cats.startswith("["), F.from_json(cats, "array<string>")).otherwise(F.array(cats))
    side = lambda k, plus=None: F.coalesce(F.get("v.a_bbox", F.lit(k)), F.get("v.bbox", F.lit(k)) if plus is None else F.get("v.bbox", F.lit(plus)) + F.get("v.bbox", F.lit(k)))
    notes = notes.select(key, "ann_id", F.coalesce("v.img_id", "v.image_id").alias("img"), F.explode(cats).alias("cat_id"), side(0).alias("x1"), side(1).alias("y1"), side(2, 0).alias("x2"), side(3, 1).alias("y2"))
    both = notes.join(images, [key, "img"]).join(categories, [key, "cat_id"], "left")
    return both.select(key, "file_name", "width", "height", "ann_id", "cat_id", "category", "x1", "y1", "x2", "y2")


def member_boxes(members: DataFrame) -> DataFrame:
    """Annotations from the members of COCO-like JSON files (json_members): the columns of annotation_boxes."""
    of = lambda section, kind: members.where(F.col("section") == section).select("file", "key", "scalars", "value", F.from_json("value", kind).alias("v"))
    images = of("images", _IMAGE).where("NOT scalars").select("file", F.coalesce("v.id", "v.img_id", "key").alias("img"), F.coalesce("v.file_name", "v.filename").alias("file_name"), "v.width", "v.height")
    listed = of("categories", "struct<id:string,name:string>").where("NOT scalars").select("file", F.coalesce("key", "v.id").alias("cat_id"), F.col("v.name").alias("category"))
    named = of("categories", "map<string,string>").where("scalars").select("file", F.explode("v")).select("file", "key", "value")
    notes = of("annotations", _ANNOTATION).where("NOT scalars").select("file", F.coalesce("v.id", "key").alias("ann_id"), "v")
    return _joined(images, notes, listed.union(named).where("cat_id IS NOT NULL"), "file")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """COCO-like JSON files of any size, each read by many tasks; the rows of annotation_boxes."""
    return member_boxes(written(json_members(spark, path), "members"))  # read once for each section


def read_symbol_xml(spark: SparkSession, path: str, tag: str = "Node", whole: bool = True) -> DataFrame:
    """Symbol nodes of XML files, fields as elements or as attributes: file, name, x, y, w, h.

    whole: nodes with a missing field or a side that isn't positive are dropped; otherwise all nodes stay, with NULLs.
    """
    schema = "ClassName string, Top double, Left double, Width double, Height double, _class string, _top double, _left double, _width double, _height double"
    raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    both = {n: F.coalesce(a, b) for n, a, b in (("name", "ClassName", "_class"), ("x", "Left", "_left"), ("y", "Top", "_top"), ("w", "Width", "_width"), ("h", "Height", "_height"))}
    rows = raw.select(F.col("_metadata.file_path").alias("file"), *[c.alias(n) for n, c in both.items()])
    return rows.dropna().where("w > 0 AND h > 0") if whole else rows


def map_symbols(symbols: DataFrame, classes: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Symbols with their class by name (classes: name, class_id; a small table); unknown names are dropped.

    seen: an observation that counts mapped and unmapped symbols as the result is written.
    """
    both = symbols.join(F.broadcast(classes), "name", "left")
    if seen is not None:
        both = both.observe(seen, F.count("class_id").alias("mapped"), F.count_if(F.col("class_id").isNull()).alias("unmapped"))
    return both.where("class_id IS NOT NULL")


def unmapped_names(symbols: DataFrame, classes: DataFrame) -> DataFrame:
    """name, n: the names that the class table lacks."""
    return symbols.join(F.broadcast(classes), "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def normalised_boxes(symbols: DataFrame, width: float, height: float) -> DataFrame:
    """Pixel boxes (x, y, w, h) as centre boxes of an image of that size, cut to 0..1: cx, cy, w, h beside the other columns."""
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    new = {"cx": cut((F.col("x") + F.col("w") / 2) / width), "cy": cut((F.col("y") + F.col("h") / 2) / height), "w": cut(F.col("w") / width), "h": cut(F.col("h") / height)}
    return symbols.withColumns(new).drop("x", "y")


#: Parts of symbol names and the barline they stand for, in the order in which they are tried.
BARLINE_NAMES = [
    ("barline", "plain"), ("bar_line", "plain"), ("double_barline", "double"), ("final_barline", "final"), ("repeat_barline", "repeat"),
    ("barline_start_repeat", "repeat"), ("barline_end_repeat", "repeat"),
]


def barline_symbols(symbols: DataFrame, names: list[tuple[str, str]] = BARLINE_NAMES) -> DataFrame:
    """The symbols whose name speaks of a bar, with their kind: that of the first of `names` that is part of theirs, plain otherwise."""
    low, kind = F.lower("name"), F.lit("plain")
    for part, stands_for in reversed(names):
        kind = F.when(low.contains(part), stands_for).otherwise(kind)
    return symbols.where(low.contains("bar")).withColumn("kind", kind)


_MARKS = "path string, staff int, measure int, mark string, subtype string, time_stretch double, dx double, dy double, visible boolean"


def score_marks(files: DataFrame) -> DataFrame:
    """Marks of score XML files (path, content): fermatas by staff and measure, and the barline of each measure of the file.

    mark is fermata (with subtype, time_stretch, dx, dy, visible) or barline (subtype repeat_start, repeat_end, final for the last measure,
    else normal; measures count over the whole file, staff is NULL). A file that doesn't parse is one row of mark error.
    """

    def parse(batches: Iterator) -> Iterator:
        from xml.etree import ElementTree

        import pandas as pd

        names = [c.split()[0] for c in _MARKS.split(", ")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    root = ElementTree.fromstring(bytes(content))
                except ElementTree.ParseError:
                    rows.append((path, None, None, "error", None, None, None, None, None))
                    continue
                for s, staff in enumerate(root.iter("Staff"), 1):
                    for m, measure in enumerate(staff.iter("Measure"), 1):
                        for f in measure.iter("Fermata"):
                            moved, stretch = f.find("offset"), f.findtext("timeStretch")
                            at = (0.0, 0.0) if moved is None else (float(moved.get("x", 0)), float(moved.get("y", 0)))
                            rows.append((path, s, m, "fermata", f.findtext("subtype", "fermataAbove"), None if stretch is None else float(stretch), *at, f.findtext("visible") != "0"))
                every = list(root.iter("Measure"))
                for m, measure in enumerate(every, 1):
                    repeat = next((kind for tag, kind in (("startRepeat", "repeat_start"), ("endRepeat", "repeat_end")) if measure.find(f".//{tag}") is not None), None)
                    rows.append((path, None, m, "barline", repeat or ("final" if m == len(every) else "normal"), None, None, None, None))
            yield pd.DataFrame(rows, columns=names).astype({"staff": "Int32", "measure": "Int32", "time_stretch": float, "dx": float, "dy": float, "visible": "boolean"})

    return files.select("path", "content").mapInPandas(parse, _MARKS)


def measure_boxes(texts: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """Measure boxes of JSON texts ({"measures": [{"bbox": [x, y, w, h]}, ...]}): key, measure_id, x, y, w, h; measures without four numbers are skipped."""
    rows = texts.select(key, F.explode(F.from_json(text, "measures array<struct<measure_id:int,bbox:array<double>>>")["measures"]).alias("m"))
    rows = rows.where((F.size("m.bbox") == 4) & ~F.exists("m.bbox", lambda v: v.isNull()))
    return rows.select(key, "m.measure_id", *[F.get("m.bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")])


def read_measure_boxes(spark: SparkSession, path: str) -> DataFrame:
    return measure_boxes(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def with_class_names(df: DataFrame, names: DataFrame, column: str = "class_id", prefix: str = "unknown_") -> DataFrame:
    """`df` with class_name (names: class_id, class_name; a small table): the prefix and the id where the table lacks it, empty for negative ids."""
    table = names.select(F.col("class_id").alias("__id"), F.col("class_name").alias("__name"))
    both = df.join(F.broadcast(table), F.col(column) == F.col("__id"), "left")
    name = F.when(F.col(column) < 0, "").otherwise(F.coalesce("__name", F.concat(F.lit(prefix), F.col(column).cast("string"))))
    return both.withColumn("class_name", name).drop("__id", "__name")


def image_path(label: Column) -> Column:
    """The image that a label file belongs to: images in place of labels, without .txt."""
    return F.regexp_replace(F.replace(label, F.lit("/labels/"), F.lit("/images/")), r"\.txt$", "")


def corpus_statistics(files: DataFrame) -> DataFrame:
    """MusicXML files (path, content; zipped or not): path, title, parts, measures, fermatas, bar_styles, styles (how often each bar style). One file at a time in a task; files that don't parse give NULLs."""

    def parse(batches: Iterator) -> Iterator:
        import io
        import zipfile
        from collections import Counter
        from xml.etree import ElementTree

        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    data = bytes(content)
                    if data[:2] == b"PK":
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            data = z.read(next(n for n in z.namelist() if n.endswith((".xml", ".musicxml")) and not n.startswith("META-INF")))
                    root = ElementTree.fromstring(data)
                    styles = [(e.text or "").strip() for e in root.findall(".//bar-style")]
                    title = root.findtext(".//work-title") or root.findtext(".//movement-title")
                    rows.append((path, title, len(root.findall(".//score-part")), len(root.findall(".//measure")), len(root.findall(".//fermata")), len(styles), Counter(styles)))
                except Exception:  # a broken file is a row of its own, not a broken corpus
                    rows.append((path, None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "title", "parts", "measures", "fermatas", "bar_styles", "styles"]).astype({c: "Int64" for c in ("parts", "measures", "fermatas", "bar_styles")})

    return files.select("path", "content").mapInPandas(parse, "path string, title string, parts long, measures long, fermatas long, bar_styles long, styles map<string,long>")


def read_epochs(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Epoch metrics of CSV files with a header: run_id (the file's folder), and the columns `names` maps to new names, as doubles."""
    raw = spark.read.csv(path, header=True)
    clean = raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"), *[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns])
    return clean.select("run_id", *[F.btrim(F.col(f"`{old}`")).try_cast("double").alias(new) for old, new in names.items() if old in clean.columns])


def read_run_epochs(runs: DataFrame, path: str, names: dict[str, str], share: int = 1024) -> DataFrame:
    """read_epochs for the folders of `path` that runs (run_id: a folder's name) tells of: each folder is listed, and its CSV files are read, by the task that has its row.

    The driver holds no listing, and a file's own header tells its columns.
    """
    wanted = list(names.items())

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        found = [[] for _ in range(1 + len(wanted))]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in found], ["run_id", *[new for _, new in wanted]])
        for batch in batches:
            for run in batch.column("run_id").to_pylist():
                for info in sorted(system.get_file_info(fs.FileSelector(f"{root}/{run}")), key=lambda i: i.path):
                    if not info.is_file or info.base_name.startswith(("_", ".")):
                        continue
                    with system.open_input_stream(info.path) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as text:
                        rows = csv.reader(text)
                        header = [c.strip() for c in next(rows, [])]
                        at = [header.index(old) if old in header else None for old, _ in wanted]
                        for row in rows:
                            if row:
                                for cells, value in zip(found, [run, *[row[k] if k is not None and k < len(row) else None for k in at]]):
                                    cells.append(value)
                            if len(found[0]) >= 1 << 16:
                                yield pack()
                                found = [[] for _ in found]
        yield pack()

    tasks = max(1, -(-runs.count() // share))
    rows = runs.select("run_id").repartition(tasks).mapInArrow(get, ", ".join(f"`{c}` string" for c in ("run_id", *names.values())))
    return rows.select("run_id", *[F.btrim(F.col(f"`{new}`")).try_cast("double").alias(new) for new in names.values()])


def name_metadata(name: Column) -> Column:
    """struct(source, stem, page) from a path: the first fitting source, the file's stem, the trailing page number."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", "")
    source = F.when(stem.contains("lg-"), "openscore").when(stem.startswith("ds2_"), "deepscores").when(stem.contains("quartets_"), "quartets").otherwise("other")
    return F.struct(source.alias("source"), stem.alias("stem"), F.regexp_extract(stem, r"(\d+)$", 1).try_cast("int").alias("page"))


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and label files (stem, length) by stem; empty label files don't count."""
    return images.join(labels.where("length > 0").select("stem").distinct(), "stem")


#: Parts of file names and the source they stand for, in the order in which they are tried, by the report that uses them.
SOURCES = {
    "sizes": [("lg-", "openscore_lg"), ("lieder_openscore", "openscore_lieder"), ("muscima", "muscima"), ("cvc", "muscima"), ("_ds2_", "ds2"), ("ds2_train", "ds2"), ("ds2_val", "ds2"), ("doremi", "doremi"), ("rebelo", "rebelo"), ("fornes", "fornes")],
    "classes": [("lg-", "openscore"), ("doremi", "doremi"), ("muscima", "muscima")],
    "heads": [("muscima", "muscima"), ("doremi", "doremi"), ("beethoven", "beethoven"), ("emmentaler", "emmentaler"), ("lilyjazz", "lilyjazz"), ("gutenberg", "gutenberg")],
    "splits": [("^p4_", "Phase 4"), ("^ds2_", "DeepScoresV2"), ("^synth_f_", "Synthetic Fermata"), ("^synth_b_", "Synthetic Barline")],
}


def source_of(name: Column, rules: str = "sizes", other: str | None = None) -> Column:
    """The source of a file by the first of the SOURCES of `rules` that its name holds (^: starts with), else `other`.

    "classes" and "splits" heed case, the others don't.
    """
    plain = name if rules in ("classes", "splits") else F.lower(name)
    out = F.lit(other or ("Unknown" if rules == "splits" else "other"))
    for part, source in reversed(SOURCES[rules]):
        out = F.when(plain.startswith(part[1:]) if part[0] == "^" else plain.contains(part), source).otherwise(out)
    return F.when(name.isNotNull(), out)


def symbol_name(name: Column) -> Column:
    """struct(source, label, crop, left, right) of `source_label_box_box_box.jpg`, boxes as arrays of four ints; NULL with fewer parts, a NULL box where there aren't four numbers."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.(?:jpg|png)", ""), "_")
    numbers = lambda k: F.transform(F.split(F.get(parts, F.lit(k)), "x"), lambda v: v.try_cast("int"))
    box = lambda k: F.when((F.size(numbers(k)) == 4) & ~F.exists(numbers(k), lambda v: v.isNull()), numbers(k))
    return F.when(F.size(parts) >= 5, F.struct(F.get(parts, F.lit(0)).alias("source"), F.get(parts, F.lit(1)).alias("label"), box(2).alias("crop"), box(3).alias("left"), box(4).alias("right")))


def page_name(name: Column) -> Column:
    """struct(piece, page) of `Parsed_<piece>-layout-0-muscima_Page_<n>.xml` and of `<piece>-<n>.png`; NULL for other names. Pages pair by both."""
    file = F.element_at(F.split(name, "/"), -1)
    found = lambda regex: F.when(F.regexp_extract(file, regex, 2) != "", F.struct(F.regexp_extract(file, regex, 1).alias("piece"), F.regexp_extract(file, regex, 2).try_cast("int").alias("page")))
    return F.coalesce(found(r"^Parsed_(.+)-layout-0-muscima_Page_(\d+)\.xml$"), found(r"^(.+)-(\d+)\.png$"))


def pitched(notes: DataFrame, column: str = "pitch") -> tuple[DataFrame, DataFrame]:
    """Notes with the midi number of their pitch name, and those whose name can't be read, with the reason (missing, or unreadable)."""
    from partita.functions.pitch import midi_of_name

    both = notes.withColumn("midi", midi_of_name(F.col(column)))
    return both.where("midi IS NOT NULL"), both.where("midi IS NULL").drop("midi").withColumn("reason", F.when(F.col(column).isNull(), "missing").otherwise("unreadable"))


#: Where a source may keep its images and its labels, in the order in which they are looked for.
LAYOUTS = {"image": ("train/images", "images/train", "images"), "label": ("train/labels", "labels/train", "labels")}


def listed_pairs(files: DataFrame) -> DataFrame:
    """Images (png, jpg, jpeg) and label files that aren't empty, by source and stem, from a listing (source, path below the source, length): source, stem, image, label.

    Of each source the first folder of LAYOUTS that there is counts, for images and labels each; what lies in its other folders, or deeper, is left out.
    """
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select("source", "path", "length", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"))
    sides = {}
    for kind, folders in LAYOUTS.items():
        place = F.lit(None).cast("int")
        for k, folder in reversed(list(enumerate(folders))):
            place = F.when(F.col("path").startswith(folder + "/"), k).otherwise(place)
        first = parts.groupBy("source").agg(F.min(place).alias("place"))
        wanted = F.element_at(F.array(*map(F.lit, folders)), F.col("place") + 1)
        fits = F.col("ext").isin("png", "jpg", "jpeg") if kind == "image" else (F.col("ext") == "txt") & (F.col("length") > 0)
        sides[kind] = parts.where(fits).join(first.where("place IS NOT NULL"), "source").where(F.col("folder") == wanted).select("source", "stem", F.col("path").alias(kind))
    return sides["image"].join(sides["label"], ["source", "stem"])
