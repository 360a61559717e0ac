"""Queries over readers, writers and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.plans.registry import query
from partita.plans.views import CORNERS, boxes, epochs
from partita.sources import readers, writers

_TEXTS = f"SELECT image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h), chr(10) ORDER BY line_no) AS text FROM ({CORNERS}) t GROUP BY 1"


@query("k1_label_texts", _TEXTS)
def k1_label_texts(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return writers.label_texts(b, b)


@query("s1_label_rows", f"SELECT image_id, line_no, class_id, cx, cy, w, h FROM ({CORNERS}) t WHERE line_no%11<>0")
def s1_label_rows(spark, sf_dir):
    """Label texts written from the boxes, with every eleventh line spoilt, read again."""
    b = boxes(spark, sf_dir)
    spoilt = b.withColumn("class_id", F.when(F.col("line_no") % 11 == 0, -1).otherwise(F.col("class_id")))
    texts = writers.label_texts(spoilt, b).withColumn("text", F.regexp_replace("text", r"(?m)^-1 (\S+)", "x $1"))
    return readers.label_rows(texts, "image_id", "text").select("image_id", "line_no", "class_id", "cx", "cy", "w", "h")


@query("s3_recognised_notes", """SELECT l_orderkey AS score_id, l_linenumber AS measure, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)-1 AS INT) AS chord_index, CAST(l_linenumber%4 AS DOUBLE) AS beat, 'S' AS voice, 'C'||l_linenumber AS pitch, CAST(1 AS DOUBLE) AS duration
 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def s3_recognised_notes(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    note = F.struct(F.lit("S").alias("voice"), F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("pitch"), F.lit(1.0).alias("duration"))
    chord = F.struct((F.col("l_linenumber") % 4).cast("double").alias("beat"), F.array(note).alias("notes"))
    one = F.struct(F.col("l_linenumber").cast("int").alias("index"), F.array(chord).alias("chords"))
    scores = li.groupBy(F.col("l_orderkey").alias("score_id")).agg(F.to_json(F.struct(F.collect_list(one).alias("measures"))).alias("json"))
    return readers.recognised_notes(scores).withColumn("measure", F.col("measure").cast("int"))


@query("s9_name_metadata", "SELECT page_id, CASE WHEN contains(stem,'lg-') THEN 'openscore' WHEN starts_with(stem,'ds2_') THEN 'deepscores' WHEN contains(stem,'quartets_') THEN 'quartets' ELSE 'other' END AS source, stem, CAST(nullif(regexp_extract(stem,'([0-9]+)$',1),'') AS INT) AS page FROM (SELECT page_id, CASE page_id%3 WHEN 0 THEN 'ds2_x' WHEN 1 THEN 'lg-' ELSE 'quartets_' END||page_id AS stem FROM pages)")
def s9_name_metadata(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.when(F.col("page_id") % 3 == 0, "ds2_x").when(F.col("page_id") % 3 == 1, "lg-").otherwise("quartets_")
    path = F.concat(F.lit("images/"), kind, F.col("page_id").cast("string"), F.lit(".png"))
    return p.select("page_id", readers.name_metadata(path).alias("m")).select("page_id", "m.*")


@query("s13_pairs", "SELECT doc_id AS stem FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=1)")
def s13_pairs(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    return readers.paired(docs.select(F.col("doc_id").alias("stem")), labels.select(F.col("doc_id").alias("stem"), F.col("quality").alias("length")))


@query("r1_follow_metrics", "SELECT user_id AS run_id, CAST(count(*) AS INT) AS epoch, arg_max(value, struct_pack(t := ts, e := event_id)) AS metric, max(value) AS best FROM events GROUP BY 1")
def r1_follow_metrics(spark, sf_dir):
    from partita.streaming.live import follow_metrics

    return follow_metrics(epochs(spark, sf_dir))




@query("k1_label_files", f"SELECT CAST(image_id AS VARCHAR)||'.txt' AS file, strlen(text)+1 AS bytes FROM ({_TEXTS})")
def k1_label_files(spark, sf_dir):
    """Label files written one an image; the index tells their names and sizes."""
    from partita.sources.storage import shared_folder

    b = boxes(spark, sf_dir)
    return writers.write_labels(writers.label_texts(b, b), shared_folder(spark, "labels"))


@query("s1_label_folder", f"SELECT CAST(image_id AS VARCHAR)||'.txt' AS name, line_no, class_id, round(cx,6) AS cx, round(cy,6) AS cy, w, h FROM ({CORNERS}) t")
def s1_label_folder(spark, sf_dir):
    """The same files read back."""
    from partita.sources.storage import shared_folder

    b, path = boxes(spark, sf_dir), shared_folder(spark, "labels")
    index = writers.write_labels(writers.label_texts(b, b), path)
    rows = readers.read_label_files(index, path).withColumn("name", F.element_at(F.split("file", "/"), -1))
    return rows.select("name", "line_no", "class_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "w", "h")


@query("s4_annotations", "SELECT CAST(l_partkey AS VARCHAR)||'.png' AS file_name, CAST(l_suppkey%11 AS VARCHAR) AS cat_id, 'c'||(l_suppkey%11) AS category, CAST(l_linenumber*10 AS DOUBLE) AS x1, CAST(l_linenumber*10+CAST(l_quantity AS INT) AS DOUBLE) AS x2, count(*) AS n FROM lineitem GROUP BY ALL")
def s4_annotations(spark, sf_dir):
    """COCO-like JSON made of the line items, a document for each part: lists for even parts, maps by id for odd ones."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cat, x, part = (F.col("l_suppkey") % 11).cast("string"), (F.col("l_linenumber") * 10).cast("double"), F.col("l_partkey").cast("string")
    row = li.select("l_partkey", F.monotonically_increasing_id().cast("string").alias("id"), F.struct(part.alias("img_id"), F.array(cat).alias("cat_id"), F.array(x, F.lit(0.0), x + F.col("l_quantity").cast("int"), F.lit(9.0)).alias("a_bbox")).alias("a"))
    docs = row.groupBy("l_partkey").agg(F.collect_list(F.struct("id", "a")).alias("rows"))
    image = F.struct(F.col("l_partkey").cast("string").alias("id"), F.concat(F.col("l_partkey").cast("string"), F.lit(".png")).alias("file_name"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    cats = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.struct(k.cast("string").alias("id"), F.concat(F.lit("c"), k.cast("string")).alias("name")))
    lists = F.to_json(F.struct(F.array(image).alias("images"), F.transform("rows", lambda r: r["a"]).alias("annotations"), cats.alias("categories")))
    maps = F.to_json(F.struct(F.map_from_arrays(F.array(image["id"]), F.array(image)).alias("images"), F.map_from_entries(F.transform("rows", lambda r: F.struct(r["id"], r["a"]))).alias("annotations"), F.map_from_arrays(F.transform(cats, lambda c: c["id"]), F.transform(cats, lambda c: c["name"])).alias("categories")))
    texts = docs.select(F.col("l_partkey").alias("file"), F.when(F.col("l_partkey") % 2 == 0, lists).otherwise(maps).alias("value"))
    return readers.annotation_boxes(texts).groupBy("file_name", "cat_id", "category", "x1", "x2").agg(F.count("*").alias("n"))


@query("s8_measure_boxes", "SELECT l_orderkey AS image_id, CAST(l_linenumber*100 AS DOUBLE) AS x, CAST(CAST(l_quantity AS INT)%3*40 AS DOUBLE) AS y, count(*) AS n FROM lineitem GROUP BY ALL")
def s8_measure_boxes(spark, sf_dir):
    """Measure JSON made of the line items, one text an order; every text has a broken box too, which is skipped."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bbox = F.array((F.col("l_linenumber") * 100).cast("double"), (F.col("l_quantity").cast("int") % 3 * 40).cast("double"), F.lit(90.0), F.lit(30.0))
    one = F.struct(F.col("l_linenumber").cast("int").alias("measure_id"), bbox.alias("bbox"))
    broken = F.array(F.struct(F.lit(0).alias("measure_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("bbox")))
    texts = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.concat(F.collect_list(one), broken).alias("measures"))).alias("value"))
    return readers.measure_boxes(texts, "l_orderkey").groupBy(F.col("l_orderkey").alias("image_id"), "x", "y").agg(F.count("*").alias("n"))


@query("f18_f20_names", f"SELECT image_id, line_no, CASE WHEN class_id<20 THEN 'class-'||class_id ELSE 'unknown_'||class_id END AS class_name, 'data/images/'||image_id AS image FROM ({CORNERS}) t")
def f18_f20_names(spark, sf_dir):
    names = spark.createDataFrame([(k, f"class-{k}") for k in range(20)], "class_id int, class_name string")
    b = readers.with_class_names(boxes(spark, sf_dir), names)
    label = F.concat(F.lit("data/labels/"), F.col("image_id").cast("string"), F.lit(".txt"))
    return b.select("image_id", "line_no", "class_name", readers.image_path(label).alias("image"))


_FILES = "f AS (SELECT 'o'||l_orderkey AS path, CASE WHEN l_orderkey%50=0 THEN NULL ELSE count(DISTINCT l_linenumber) END AS parts, CASE WHEN l_orderkey%50=0 THEN NULL ELSE count(*) FILTER (WHERE l_suppkey%3=0) END AS fermatas, CASE WHEN l_orderkey%50=0 THEN NULL ELSE count(*) FILTER (WHERE l_suppkey%5=0) END AS bar_styles FROM lineitem GROUP BY l_orderkey)"


def _file_statistics(spark, sf_dir):
    """Orders stand for score files, their line items for what is in them; every fiftieth doesn't parse."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    good = lambda c: F.when(F.col("l_orderkey") % 50 != 0, c)
    n = li.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("parts"), F.count_if(F.col("l_suppkey") % 3 == 0).alias("fermatas"), F.count_if(F.col("l_suppkey") % 5 == 0).alias("bar_styles"))
    return n.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), *[good(F.col(c)).alias(c) for c in ("parts", "fermatas", "bar_styles")])


_N12 = ", ".join(f"count(*) FILTER (WHERE {c}>0) AS with_{c}, round(count(*) FILTER (WHERE {c}>0)/count(parts),9) AS share_{c}, CAST(coalesce(sum({c}),0) AS BIGINT) AS {c}, round(avg({c}),9) AS mean_{c}, round(avg({c}) FILTER (WHERE {c}>0),9) AS mean_{c}_where_any" for c in ("fermatas", "bar_styles"))


@query("n12_corpus_totals", f"WITH {_FILES} SELECT count(parts) AS files, count(*)-count(parts) AS errors, {_N12} FROM f")
def n12_corpus_totals(spark, sf_dir):
    from partita.operators.reports import corpus_totals

    t = corpus_totals(_file_statistics(spark, sf_dir))
    return t.withColumns({c: F.round(c, 9) for c in t.columns if c.startswith(("share", "mean"))})


@query("n12_part_distribution", f"WITH {_FILES} SELECT parts, count(*) AS files, round(count(*)/(SELECT count(parts) FROM f),9) AS share FROM f WHERE parts IS NOT NULL GROUP BY 1")
def n12_part_distribution(spark, sf_dir):
    from partita.operators.reports import part_distribution

    return part_distribution(_file_statistics(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("n12_top_files", f"WITH {_FILES} SELECT path, fermatas, CAST(row_number() OVER (ORDER BY fermatas DESC, path) AS INT) AS place FROM f WHERE fermatas>0 QUALIFY place<=10")
def n12_top_files(spark, sf_dir):
    from partita.operators.reports import top_files

    return top_files(_file_statistics(spark, sf_dir))
