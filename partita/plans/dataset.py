"""Dataset-engineering queries over the box view, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.functions import geometry as G
from partita.operators import dataset as S
from partita.operators import reports as R
from partita.plans.detection import BASE, ap_sql, fold_sql, iou_sql
from partita.plans.registry import query
from partita.plans.views import CORNERS, DET_CORNERS_2, EPOCHS, LABEL_LINES, boxes, detections, epochs, label_lines, view
from partita.sources import writers
from partita.sources.storage import shared_folder

B = f"WITH t AS ({CORNERS})"


def hashed_sql(key: str) -> str:
    return f"('0x'||substr(md5({key}),1,10))::BIGINT"


def draw_sql(key: str, seed: int = 42) -> str:
    return f"({hashed_sql(f"{key}||'/{seed}'")}/1099511627776::DOUBLE)"


C = ("cx", "cy", "w", "h")
CENTRE_IOU = iou_sql("k.", "x[1].")


def _images(b):
    return b.select("image_id", F.concat_ws("-", F.when(F.col("image_id") % 7 == 0, "quartets_x").otherwise("page"), F.col("image_id").cast("string")).alias("stem")).distinct()


@query("f1_f26_geometry", f"""{B} SELECT image_id, line_no, round(least(x1*1280,99999),6) AS px1, round((x1+x2)/2,9) AS back_cx, round(CASE WHEN h=0 THEN 'infinity'::DOUBLE ELSE w/h END,6) AS aspect, round(greatest(0,least(1,x1)),6) AS nx1,
 round(CASE WHEN w<0.05 THEN 0.06 ELSE w END,9) AS wide_w, round(CASE WHEN w<0.05 THEN greatest(0.03,least(0.97,cx)) ELSE cx END,9) AS wide_cx,
 round(greatest(0.01,least(0.99,cy-h/2+0.02/2)),9) AS top_cy, printf('%.1f,%.1f,%.1f,%.1f', x1*1280+0.0001, y1*1280+0.0001, x2*1280+0.0001, y2*1280+0.0001) AS txt,
 CASE WHEN w>=0.1 AND w<=0.2 THEN 2 WHEN w>=0 AND w<0.05 THEN 0 WHEN w>=0.05 AND w<0.1 THEN 1 END AS bin FROM t""")
def f_geometry(spark, sf_dir):
    b = boxes(spark, sf_dir)
    centre, corners = G.box("", C), G.box()
    px, back = G.to_corners(centre, 1280.0, 1280.0), G.to_centre(corners)
    wide = G.widened_line(centre, 0.05, 0.06)
    shift = G.Box(*(F.col(c) * 1280 + 0.0001 for c in ("x1", "y1", "x2", "y2")))
    r = lambda c, n, d=9: F.round(c, d).alias(n)
    return b.select("image_id", "line_no", r(px.a, "px1", 6), r(back.a, "back_cx"), r(G.aspect(F.col("w"), F.col("h")), "aspect", 6), r(G.normalised(corners, F.lit(1.0), F.lit(1.0)).a, "nx1", 6), r(wide.c, "wide_w"), r(wide.a, "wide_cx"), r(G.top_fixed(centre, 0.02, 0.02).b, "top_cy"), G.box_text(shift).alias("txt"), G.bucket(F.col("w"), [0, 0.05, 0.1, 0.2]).alias("bin"))


@query("f26_shrunk_oversize", f"""{B}, z AS (SELECT *, w*4 AS ww, h*4 AS hh FROM t), s AS (SELECT *, ww*hh>0.1 AS big, hh/ww AS ratio FROM z),
 u AS (SELECT *, CASE WHEN ratio>5 THEN greatest(least(ww,hh/15),0.01) ELSE ww END AS w1, CASE WHEN ratio<0.2 THEN greatest(least(hh,ww/15),0.01) ELSE hh END AS h1 FROM s),
 v AS (SELECT *, CASE WHEN w1*h1>0.05 THEN sqrt(0.05/(w1*h1)) ELSE 1.0 END AS f FROM u)
 SELECT image_id, line_no, round(CASE WHEN big THEN least(w1*f,1.0) ELSE ww END,6) AS w, round(CASE WHEN big THEN least(h1*f,1.0) ELSE hh END,6) AS h FROM v""")
def f26_shrunk_oversize(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("w", F.col("w") * 4).withColumn("h", F.col("h") * 4)
    s = G.shrunk_oversize(G.box("", C))
    return b.select("image_id", "line_no", F.round(s.c, 6).alias("w"), F.round(s.d, 6).alias("h"))


_JITTER = lambda n: f"(0.045::DOUBLE*(1+0.3::DOUBLE*({hashed_sql(f"image_id||'/'||line_no||'/42/{n}'")}%20001/10000-1)))"


@query("f22_f23_sizes", f"""{B}, j AS (SELECT *, {_JITTER(1)} AS jw, {_JITTER(2)} AS jh, cy+CASE WHEN class_id=0 THEN -0.25*h ELSE 0.0 END AS moved FROM t)
 SELECT image_id, line_no, round(cx,9) AS rcx, round(CASE WHEN class_id=0 THEN greatest(0.03::DOUBLE/2, least(1-0.03::DOUBLE/2, cy-h/2+0.03::DOUBLE/2)) ELSE cy END,9) AS rcy, CASE class_id WHEN 0 THEN 0.02::DOUBLE WHEN 3 THEN 0.05::DOUBLE ELSE w END AS rw, CASE class_id WHEN 0 THEN 0.03::DOUBLE ELSE h END AS rh,
 round(greatest(jw/2, least(1-jw/2, cx)),9) AS jcx, round(greatest(jh/2, least(1-jh/2, moved)),9) AS jcy, round(jw,9) AS jw, round(jh,9) AS jh FROM j""")
def f22_f23_sizes(spark, sf_dir):
    """Jittered target sizes and reference sizes by rule."""
    b = boxes(spark, sf_dir)
    rules = spark.createDataFrame([(0, "top", 0.02, 0.03), (3, "center", 0.05, None), (6, "skip", 0.1, 0.1)], "class_id int, rule string, tw double, th double")
    j = b.join(F.broadcast(rules), "class_id", "left")
    ref = G.reference_size(G.box("", C), F.col("rule"), F.col("tw"), F.col("th"))
    jit = G.shrunk_to_size(G.box("", C), F.lit(0.045), F.lit(0.045), F.coalesce("rule", F.lit("center")), F.concat_ws("/", "image_id", "line_no"))
    out = j.select("image_id", "line_no", *ref.named("rcx", "rcy", "rw", "rh"), *jit.named("jcx", "jcy", "jw", "jh"))
    return out.withColumns({c: F.round(c, 9) for c in ("rcx", "rcy", "jcx", "jcy", "jw", "jh")})


@query("d1_merge", """WITH b AS (SELECT rank, source, stem FROM (
  SELECT 0 AS rank, 'a' AS source, CAST(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION SELECT 1, 'b', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)))
 SELECT source, stem, CASE WHEN row_number() OVER w=1 THEN stem ELSE stem||'_'||(row_number() OVER w-1) END AS name FROM b WINDOW w AS (PARTITION BY stem ORDER BY rank)""")
def d1_merge(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet").select(F.col("doc_id").cast("string").alias("stem")) for n in ("documents", "labels"))
    return S.merge_images({"a": (docs, labels), "b": (labels, docs)}, prefix=False)


@query("d1d_merge_totals", f"{B} SELECT CASE WHEN image_id%3=0 THEN 'a' ELSE 'b' END AS source, class_id, count(*) AS n, count(DISTINCT image_id) AS images FROM t GROUP BY GROUPING SETS ((source, class_id), (source), ())")
def d1d_merge_totals(spark, sf_dir):
    return S.merge_totals(boxes(spark, sf_dir).withColumn("source", F.when(F.col("image_id") % 3 == 0, "a").otherwise("b")))


@query("d2b_single_class", f"{B}, i AS (SELECT image_id, 'one_'||lpad(CAST(row_number() OVER (ORDER BY stem, image_id)+99 AS VARCHAR), 6, '0') AS name FROM (SELECT DISTINCT image_id, CASE WHEN image_id%7=0 THEN 'quartets_x' ELSE 'page' END||'-'||image_id AS stem FROM t)) SELECT image_id, name, line_no, 17 AS class_id FROM t JOIN i USING (image_id)")
def d2b_single_class(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return S.single_class(b, _images(b), 17, "one_", 100).select("image_id", "name", "line_no", "class_id")


#: The taxonomy map of the remap queries: 3 joins 0, 30 is dropped, 27 is unknown.
MAP = [(0, 0), (3, 0), (6, 1), (9, 2), (12, 3), (15, 4), (18, 5), (21, 6), (24, 7), (30, -1)]
_MAP = "m(old_id, new_id) AS (VALUES " + ", ".join(map(str, MAP)) + ")"


def _map(spark):
    return spark.createDataFrame(MAP, "old_id int, new_id int")


@query("d2_remap", f"{B}, {_MAP} SELECT image_id, line_no, new_id AS class_id FROM t JOIN m ON class_id=old_id WHERE new_id<>-1")
def d2_remap(spark, sf_dir):
    return S.remap(boxes(spark, sf_dir), _map(spark)).select("image_id", "line_no", "class_id")


@query("d1b_remap_back", f"{B}, {_MAP} SELECT image_id, line_no, coalesce(new_id, class_id) AS class_id FROM t LEFT JOIN m ON class_id=old_id WHERE coalesce(new_id, class_id)<>-1")
def d1b_remap_back(spark, sf_dir):
    return S.remap(boxes(spark, sf_dir), _map(spark), keep_others=True).select("image_id", "line_no", "class_id")


@query("d2_quarantine", f"{B}, {_MAP} SELECT image_id, line_no, class_id FROM t WHERE class_id NOT IN (SELECT old_id FROM m)")
def d2_quarantine(spark, sf_dir):
    return S.remap_rejects(boxes(spark, sf_dir), _map(spark)).select("image_id", "line_no", "class_id")


@query("d2c_coverage", f"{B}, {_MAP} SELECT CASE WHEN new_id IS NULL THEN 'unknown' WHEN new_id=-1 THEN 'dropped' ELSE 'mapped' END AS fate, CASE WHEN new_id>=0 THEN new_id END AS new_id, count(*) AS n, count(DISTINCT class_id) AS old_classes FROM t LEFT JOIN m ON class_id=old_id GROUP BY 1,2")
def d2c_coverage(spark, sf_dir):
    return S.remap_coverage(boxes(spark, sf_dir), _map(spark))


@query("d3_repeated_lines", f"WITH l AS ({LABEL_LINES}), k AS (SELECT *, lag(line) OVER (PARTITION BY file_id ORDER BY line_no) AS p FROM l) SELECT file_id, CAST(line_no AS INT) AS line_no, md5(line) AS line FROM k WHERE p IS NULL OR p<>line")
def d3_repeated_lines(spark, sf_dir):
    return S.drop_repeated_lines(label_lines(spark, sf_dir)).select("file_id", "line_no", F.md5("line").alias("line"))


@query("n7_repeated_report", f"WITH l AS ({LABEL_LINES}), k AS (SELECT *, lag(line) OVER (PARTITION BY file_id ORDER BY line_no) AS p FROM l) SELECT prefix, count(*) AS n, count(*) FILTER (WHERE p=line) AS repeated, count(DISTINCT file_id) AS files FROM k GROUP BY ROLLUP (prefix)")
def n7_repeated_report(spark, sf_dir):
    return S.repeated_report(label_lines(spark, sf_dir))


_SPLIT_LINES = f"WITH l AS (SELECT *, CASE WHEN file_id%5=0 THEN 'val' ELSE 'train' END AS split FROM ({LABEL_LINES})), k AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY file_id ORDER BY line_no)=line, false) AS same FROM l)"


@query("n7_repeated_by_split", f"{_SPLIT_LINES} SELECT prefix, split, count(*) AS n, count(*) FILTER (WHERE same) AS repeated, count(DISTINCT file_id) AS files FROM k GROUP BY CUBE (prefix, split)")
def n7_repeated_by_split(spark, sf_dir):
    return S.repeated_report(label_lines(spark, sf_dir).withColumn("split", F.when(F.col("file_id") % 5 == 0, "val").otherwise("train")), ("prefix", "split"))


@query("k7_most_repeated", f"{_SPLIT_LINES} SELECT file_id, count(*) FILTER (WHERE same) AS repeated, count(*) AS lines FROM k GROUP BY 1 HAVING count(*) FILTER (WHERE same)>0 ORDER BY 2 DESC, 1 LIMIT 10")
def k7_most_repeated(spark, sf_dir):
    return S.most_repeated(label_lines(spark, sf_dir))


@query("d4_near_duplicates", f"{B} SELECT image_id, class_id, v.line_no AS line_no FROM ({fold_sql('t', 'image_id, class_id', 'line_no', ['line_no', 'x1', 'y1', 'x2', 'y2'], CENTRE_IOU + '>=0.3')})")
def d4_near_duplicates(spark, sf_dir):
    return S.near_duplicate_boxes(boxes(spark, sf_dir), 0.3).select("image_id", "class_id", "line_no")


_JOINS = "greatest(0.0, least(r.cx+r.w/2, o.cx+o.w/2)-greatest(r.cx-r.w/2, o.cx-o.w/2))"
_JOINS = f"(CASE WHEN r.w+o.w-{_JOINS}>0 THEN {_JOINS}/(r.w+o.w-{_JOINS}) ELSE 0 END>0.5)"


@query("d4b_merge_overlapping", f"""WITH RECURSIVE t AS ({CORNERS}), o AS (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY image_id, class_id ORDER BY cx, line_no) AS k FROM t),
 r AS (SELECT image_id, class_id, k, 0 AS g, cx, cy, w, h, 1 AS n FROM o WHERE k=1 UNION ALL SELECT o.image_id, o.class_id, o.k, CASE WHEN {_JOINS} THEN g ELSE g+1 END, CASE WHEN {_JOINS} THEN (r.cx*n+o.cx)/(n+1) ELSE o.cx END, CASE WHEN {_JOINS} THEN (r.cy*n+o.cy)/(n+1) ELSE o.cy END,
  CASE WHEN {_JOINS} THEN greatest(r.w,o.w) ELSE o.w END, CASE WHEN {_JOINS} THEN greatest(r.h,o.h) ELSE o.h END, CASE WHEN {_JOINS} THEN n+1 ELSE 1 END FROM r JOIN o ON o.image_id=r.image_id AND o.class_id=r.class_id AND o.k=r.k+1)
 SELECT image_id, class_id, round(cx,9) AS cx, round(cy,9) AS cy, w, h, n FROM (SELECT *, lead(g) OVER (PARTITION BY image_id, class_id ORDER BY k) AS next FROM r) WHERE next IS NULL OR next<>g""")
def d4b_merge_overlapping(spark, sf_dir):
    return S.merge_overlapping(boxes(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("cx", "cy")})


@query("d4c_keep_largest", f"{B} SELECT image_id, class_id, v.line_no AS line_no FROM ({fold_sql('t', 'image_id, class_id', 'w*h DESC, line_no', ['line_no', *C], 'abs(k.cx-x[1].cx)<0.1 AND abs(k.cy-x[1].cy)<0.1')})")
def d4c_keep_largest(spark, sf_dir):
    return S.keep_largest(boxes(spark, sf_dir), 0.1).select("image_id", "class_id", "line_no")


STEMS = f"{B}, i AS (SELECT DISTINCT image_id, CASE WHEN image_id%7=0 THEN 'quartets_x' ELSE 'page' END||'-'||image_id AS stem FROM t)"


@query("d5_hash_split", f"{STEMS} SELECT image_id, stem, CASE WHEN {draw_sql('stem')}<0.2::DOUBLE THEN 'val' ELSE 'train' END AS split FROM i")
def d5_hash_split(spark, sf_dir):
    return S.hash_split(_images(boxes(spark, sf_dir)), "stem", 0.2)


@query("d5_size_split", f"{STEMS} SELECT image_id, stem, CASE WHEN row_number() OVER (ORDER BY {draw_sql('stem')}, stem)<=150 THEN 'val' ELSE 'train' END AS split FROM i")
def d5_size_split(spark, sf_dir):
    return S.size_split(_images(boxes(spark, sf_dir)), "stem", 150)


@query("d5b_every_tenth", f"{B}, i AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS k FROM (SELECT DISTINCT image_id FROM t)) SELECT image_id, CASE WHEN k%10=0 THEN 'val' ELSE 'train' END AS split FROM i")
def d5b_every_tenth(spark, sf_dir):
    return S.every_nth(boxes(spark, sf_dir).select("image_id").distinct(), "image_id")


@query("d6_stratified_split", f"""{B}, p AS (SELECT DISTINCT image_id, class_id, {draw_sql('image_id::VARCHAR')} AS u FROM t), n AS (SELECT class_id, count(*) AS n FROM p GROUP BY 1),
 f AS (SELECT DISTINCT image_id FROM (SELECT image_id, n, row_number() OVER (PARTITION BY class_id ORDER BY u, image_id) AS k FROM p JOIN n USING (class_id) WHERE n<100) WHERE k<=greatest(1, n//10)),
 i AS (SELECT DISTINCT image_id, u, image_id IN (SELECT image_id FROM f) AS first FROM p)
 SELECT image_id, CASE WHEN row_number() OVER (ORDER BY first DESC, u, image_id)<=greatest((SELECT floor(count(*)*0.2::DOUBLE) FROM i), (SELECT count(*) FROM f)) THEN 'val' ELSE 'train' END AS split FROM i""")
def d6_stratified_split(spark, sf_dir):
    return S.stratified_split(boxes(spark, sf_dir))


_REPEAT = f"""{B}, w AS (SELECT class_id, 1/sqrt(count(*)) AS w FROM t GROUP BY 1), own AS (SELECT image_id, max(w.w) AS weight FROM t JOIN w USING (class_id) GROUP BY 1),
 rp AS (SELECT image_id, weight, CAST(greatest(1, least(10, round_even(weight/(SELECT min(weight) FROM own),0))) AS INT) AS repeat FROM own)"""


@query("d7_repeat_counts", f"{_REPEAT} SELECT image_id, round(weight,9) AS weight, repeat FROM rp")
def d7_repeat_counts(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return S.repeat_counts(b, b).withColumn("weight", F.round("weight", 9))


@query("d7b_effective_counts", f"{_REPEAT} SELECT class_id, count(*) AS n, CAST(sum(repeat) AS BIGINT) AS effective, round(sum(repeat)/count(*),9) AS boost FROM t JOIN rp USING (image_id) GROUP BY 1")
def d7b_effective_counts(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return S.effective_counts(b, S.repeat_counts(b, b)).withColumn("boost", F.round("boost", 9))


@query("k4_training_list", f"{_REPEAT} SELECT 'images/'||image_id||'.png' AS path, CAST(repeat AS BIGINT) AS times FROM rp")
def k4_training_list(spark, sf_dir):
    b = boxes(spark, sf_dir)
    path = shared_folder(spark, "list")
    writers.write_training_list(S.repeat_counts(b, b).select(F.concat(F.lit("images/"), F.col("image_id").cast("string"), F.lit(".png")).alias("path"), "repeat"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("path")).agg(F.count("*").alias("times"))


@query("d8_image_weights", f"{B}, n AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1), w AS (SELECT class_id, (1/sqrt(n))/(SELECT min(1/sqrt(n)) FROM n) AS w FROM n) SELECT image_id, round(greatest(1, 1+(max(w.w)-1)*0.5),9) AS weight FROM t JOIN w USING (class_id) GROUP BY 1")
def d8_image_weights(spark, sf_dir):
    b = boxes(spark, sf_dir)
    w = S.image_weights(b, b, S.class_weights(S.class_counts(b), "inverse_sqrt"))
    return S.ramped(w, 5, 10).withColumn("weight", F.round("weight", 9))


@query("d8b_weighted_sample", f"""{B}, c AS (SELECT class_id, 1/count(*) AS raw FROM t GROUP BY 1), cw AS (SELECT class_id, raw/(SELECT min(raw) FROM c) AS w FROM c),
 iw AS (SELECT image_id, greatest(1.0::DOUBLE, max(cw.w)) AS weight FROM t JOIN cw USING (class_id) GROUP BY 1), sp AS (SELECT image_id, weight, sum(weight) OVER (ORDER BY image_id) AS hi FROM iw),
 dr AS (SELECT i AS draw, {draw_sql('i::VARCHAR')}*(SELECT sum(weight) FROM iw) AS spot FROM (SELECT unnest(range(0, (SELECT count(*) FROM iw))) AS i))
 SELECT 'without' AS kind, CAST(NULL AS BIGINT) AS draw, image_id FROM (SELECT image_id, row_number() OVER (ORDER BY ln(greatest({draw_sql('image_id::VARCHAR')}, 1e-12))/weight DESC, image_id) AS k FROM iw) WHERE k<=(SELECT count(*) FROM iw)//2
 UNION ALL SELECT 'with', draw, image_id FROM dr JOIN sp ON spot>=hi-weight AND spot<hi""")
def d8b_weighted_sample(spark, sf_dir):
    b = boxes(spark, sf_dir)
    w = S.image_weights(b, b, S.class_weights(S.class_counts(b), "inverse"))
    n = w.count()
    without = S.weighted_sample(w, "image_id", n // 2).select(F.lit("without").alias("kind"), F.lit(None).cast("long").alias("draw"), "image_id")
    return without.union(S.weighted_sample(w, "image_id", n, replacement=True).select(F.lit("with"), "draw", "image_id"))


@query("d9_class_weights", f"""{B}, n AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1), r AS (SELECT class_id, 1/n AS a, 1/sqrt(n) AS b, (1-0.9999::DOUBLE)/(1-power(0.9999::DOUBLE,n)) AS c FROM n)
 SELECT class_id, round(a/(SELECT min(a) FROM r),6) AS inverse, round(b/(SELECT min(b) FROM r),6) AS inverse_sqrt, round(c/(SELECT min(c) FROM r),6) AS effective FROM r""")
def d9_class_weights(spark, sf_dir):
    n = S.class_counts(boxes(spark, sf_dir))
    out = None
    for how in ("inverse", "inverse_sqrt", "effective"):
        part = S.class_weights(n, how).select("class_id", F.round("weight", 6).alias(how))
        out = part if out is None else out.join(part, "class_id")
    return out


@query("d9b_quality_weights", f"{ap_sql()}, r AS (SELECT class_id, (1/sqrt(n/1000)+1/(ap+0.1))/2 AS raw FROM ap JOIN nt USING (class_id)) SELECT class_id, round(1+9*(raw-(SELECT min(raw) FROM r))/((SELECT max(raw) FROM r)-(SELECT min(raw) FROM r)),6) AS weight FROM r")
def d9b_quality_weights(spark, sf_dir):
    from partita.operators import detection as D

    t = boxes(spark, sf_dir)
    ap = D.average_precision(D.assign(t, detections(spark, sf_dir)), t).select("class_id", "ap")
    return S.quality_weights(S.class_counts(t), ap).withColumn("weight", F.round("weight", 6))


@query("d10_tail_classes", f"{B} SELECT c AS class_id, coalesce(n,0) AS n FROM (SELECT unnest(range(33))::INT AS c) LEFT JOIN (SELECT class_id, count(*) AS n FROM t GROUP BY 1) ON c=class_id ORDER BY 2, 1 LIMIT 25")
def d10_tail_classes(spark, sf_dir):
    return S.tail_classes(S.class_counts(boxes(spark, sf_dir)), spark.range(33).select(F.col("id").cast("int").alias("class_id")), 25)


@query("d10b_background", f"{B} SELECT image_id, round(s,9) AS share, row_number() OVER (ORDER BY s DESC, image_id) AS place FROM (SELECT image_id, avg(CASE WHEN class_id IN (0,3) THEN 1 ELSE 0 END) AS s FROM t GROUP BY 1)")
def d10b_background(spark, sf_dir):
    return S.background_preference(boxes(spark, sf_dir), (0, 3)).withColumn("share", F.round("share", 9))


_PASTE_KEY = "source_image||'/'||source_line||'/'||try"


@query("d10c_paste_plan", f"""{B}, n AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1), la AS (SELECT class_id, (SELECT max(n) FROM n)-n AS lack FROM n QUALIFY row_number() OVER (ORDER BY n, class_id)<=3),
 im AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS rank FROM (SELECT DISTINCT image_id FROM t)),
 ofr AS MATERIALIZED (SELECT class_id, lack, image_id AS source_image, line_no AS source_line, w, h, try FROM t JOIN la USING (class_id) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS try) WHERE lack>0 AND w>=0.03 AND h>=0.03),
 pl AS MATERIALIZED (SELECT ofr.*, im.image_id, w/2+{draw_sql(_PASTE_KEY, 43)}*(1-w) AS cx, h/2+{draw_sql(_PASTE_KEY, 44)}*(1-h) AS cy, {hashed_sql(_PASTE_KEY)} AS turn FROM ofr JOIN im ON im.rank=floor({draw_sql(_PASTE_KEY)}*(SELECT count(*) FROM im))+1),
 bx AS (SELECT *, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM pl),
 fr AS (SELECT * FROM bx WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id=bx.image_id AND {iou_sql('bx.', 't.')}>0.1)),
 a AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY turn, class_id, source_image, source_line)<=5)
 SELECT class_id, source_image, source_line, image_id, round(cx,9) AS cx, round(cy,9) AS cy, w, h FROM a QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY turn, source_image, source_line)<=lack""")
def d10c_paste_plan(spark, sf_dir):
    b = boxes(spark, sf_dir)
    n = S.class_counts(b)
    plan = S.paste_plan(b, S.tail_classes(n, n.select("class_id"), 3), int(n.agg(F.max("n")).first()[0]))
    return plan.withColumns({c: F.round(c, 9) for c in ("cx", "cy")})


@query("d11_quality_subset", f"{B} SELECT image_id, CAST(sum(CASE WHEN class_id IN (9,21) THEN 10 ELSE 0 END)+count(*) AS BIGINT) AS score FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def d11_quality_subset(spark, sf_dir):
    return S.quality_subset(boxes(spark, sf_dir), (9, 21), 50)


SIZES = [(3, 0.045, 0.045, "top"), (6, 0.03, 0.05, None)]


def _pseudo_side(n: int, side: str) -> str:
    return f"(CASE class_id WHEN 3 THEN 0.045::DOUBLE ELSE {'0.03' if side == 'w' else '0.05'}::DOUBLE END*(1+0.3::DOUBLE*({hashed_sql(f"image_id||'/'||det_id||'/42/{n}'")}%20001/10000-1)))"


@query("d12_pseudo_labels", f"""{BASE}, d2 AS ({DET_CORNERS_2}), o AS (SELECT *, {_pseudo_side(1, 'w')} AS jw, {_pseudo_side(2, 'h')} AS jh, cy+CASE WHEN class_id=3 THEN -0.25*h ELSE 0.0 END AS moved FROM d WHERE image_id%3=0 AND class_id<>0),
 a AS (SELECT image_id, class_id, cx, cy, w, h, 'trusted' AS origin FROM t WHERE image_id%3<>0 UNION ALL SELECT image_id, class_id, cx, cy, w, h, 'notehead' FROM d2 WHERE image_id%3=0 AND class_id=0
 UNION ALL SELECT image_id, class_id, CASE WHEN class_id IN (3,6) THEN greatest(jw/2, least(1-jw/2, cx)) ELSE cx END, CASE WHEN class_id IN (3,6) THEN greatest(jh/2, least(1-jh/2, moved)) ELSE cy END, CASE WHEN class_id IN (3,6) THEN jw ELSE w END, CASE WHEN class_id IN (3,6) THEN jh ELSE h END, 'predicted' FROM o)
 SELECT image_id, class_id, round(cx,9) AS cx, round(cy,9) AS cy, round(w,9) AS w, round(h,9) AS h, origin FROM a""")
def d12_pseudo_labels(spark, sf_dir):
    """The second model's class 0 stands for the notehead detector."""
    from partita.operators.curation import pseudo_labels

    sizes = spark.createDataFrame(SIZES, "class_id int, width double, height double, bias string")
    noteheads = view(spark, sf_dir, DET_CORNERS_2).where("class_id = 0")
    p = pseudo_labels(boxes(spark, sf_dir), detections(spark, sf_dir), noteheads, F.col("image_id") % 3 != 0, (0,), sizes)
    return p.withColumns({c: F.round(c, 9) for c in C})


@query("d13_change_counts", f"""{B}, s AS (SELECT image_id, line_no, class_id, w FROM t), n AS (SELECT image_id, line_no, CASE WHEN class_id=0 THEN w+0.01 ELSE w END AS w FROM s WHERE (image_id+line_no)%4<>0)
 SELECT s.class_id, count(*) AS before, count(n.w) AS after, count(*)-count(n.w) AS removed, count(*) FILTER (WHERE n.w IS NOT NULL AND n.w<>s.w) AS changed FROM s LEFT JOIN n USING (image_id, line_no) GROUP BY 1""")
def d13_change_counts(spark, sf_dir):
    b = boxes(spark, sf_dir)
    after = b.where((F.col("image_id") + F.col("line_no")) % 4 != 0).withColumn("w", F.when(F.col("class_id") == 0, F.col("w") + 0.01).otherwise(F.col("w")))
    return S.change_counts(b, after)


@query("d13_repair", f"""{B}, r AS (SELECT image_id, line_no, class_id, cx, CASE WHEN image_id%2=0 AND class_id=0 THEN greatest(0.01,least(0.99,cy-h/2+0.01)) ELSE cy END AS cy, CASE WHEN image_id%2=0 AND class_id=0 THEN 0.02 ELSE w END AS w, CASE WHEN image_id%2=0 AND class_id=0 THEN 0.02 ELSE h END AS h FROM t),
 rc AS (SELECT image_id, line_no, class_id, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM r) SELECT image_id, class_id, v.line_no AS line_no FROM ({fold_sql('rc', 'image_id, class_id', 'line_no', ['line_no', 'x1', 'y1', 'x2', 'y2'], CENTRE_IOU + '>=0.7')})""")
def d13_repair(spark, sf_dir):
    from partita.operators.curation import repaired

    rules = spark.createDataFrame([(0, "top", 0.02, 0.02)], "class_id int, rule string, width double, height double")
    return repaired(boxes(spark, sf_dir), F.col("image_id") % 2 == 0, rules).select("image_id", "class_id", "line_no")


@query("d14_clean", f"""{B}, i AS (SELECT image_id, CASE WHEN image_id%7=0 THEN 'quartets_x' ELSE 'page' END||'-'||image_id AS stem, count(*) AS n FROM t GROUP BY 1)
 SELECT image_id, line_no FROM t JOIN i USING (image_id) WHERE NOT starts_with(stem,'page-11') AND NOT (starts_with(stem,'quartets_') AND n<=28) AND NOT (w<0.05 AND h<0.05)""")
def d14_clean(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return S.clean(b, _images(b), ("page-11",), "quartets_", few=28, tiny=0.05).select("image_id", "line_no")


@query("d15_integrity", """SELECT 'image_without_label' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'label_without_image', count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
 UNION ALL SELECT 'class_out_of_range', count(*) FILTER (WHERE quality NOT BETWEEN 0 AND 0) FROM labels UNION ALL SELECT 'pair', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def d15_integrity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    return S.integrity(docs.select(F.col("doc_id").alias("stem")), labels.select(F.col("doc_id").alias("stem"), F.col("quality").alias("class_id")), 1)


@query("g6_range_errors", f"{B} SELECT image_id, line_no, list_concat(CASE WHEN cx<0 OR cx>1 OR cy<0 OR cy>1 THEN ['centre'] ELSE [] END, list_concat(CASE WHEN w<=0 OR w>1 OR h<=0 OR h>1 THEN ['size'] ELSE [] END, CASE WHEN cx-w/2<0 OR cx+w/2>1 OR cy-h/2<0 OR cy+h/2>1 THEN ['edge'] ELSE [] END)) AS errors FROM t WHERE len(errors)>0")
def g6_range_errors(spark, sf_dir):
    return S.range_errors(boxes(spark, sf_dir)).select("image_id", "line_no", "errors")


@query("n1_n2_class_counts", f"{B} SELECT class_id, count(*) AS n, count(DISTINCT image_id) AS images, round(count(*)/count(DISTINCT image_id),9) AS per_image FROM t GROUP BY 1")
def n2_class_counts(spark, sf_dir):
    return S.class_counts(boxes(spark, sf_dir)).withColumn("per_image", F.round("per_image", 9))


@query("n3_image_statistics", f"{B}, n AS (SELECT image_id, count(*) AS n FROM t GROUP BY 1) SELECT count(*) AS images, round(avg(n),6) AS mean, round(median(n),6) AS median, round(stddev_pop(n),6) AS sd, round(stddev_pop(n)/avg(n),6) AS cv FROM n")
def n3_image_statistics(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return S.image_statistics(b, b).select("images", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "cv")])


@query("n4_concentration", f"{B}, n AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT (SELECT sum(n) FROM (SELECT n FROM n ORDER BY n DESC, class_id LIMIT 4))/(SELECT count(*) FROM t) AS s) SELECT round(s,9) AS top_share, CASE WHEN s>0.8 THEN 'high' WHEN s>0.6 THEN 'medium' ELSE 'low' END AS concentration, round((SELECT avg(CASE WHEN w<0.05 AND h<0.05 THEN 1 ELSE 0 END) FROM t),9) AS small_share FROM s")
def n4_concentration(spark, sf_dir):
    return S.concentration(boxes(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("top_share", "small_share")})


@query("n6_size_variety", f"{B} SELECT class_id, count(DISTINCT (round_even(w,3), round_even(h,3))) AS sizes, round(stddev_pop(w)/avg(w),6) AS cv_w, round(stddev_pop(h)/avg(h),6) AS cv_h FROM t GROUP BY 1")
def n6_size_variety(spark, sf_dir):
    return S.size_variety(boxes(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("cv_w", "cv_h")})


@query("n8_imbalance", f"{B} SELECT round(max(n)/min(n),9) AS imbalance FROM (SELECT class_id, count(*) AS n FROM t GROUP BY 1)")
def n8_imbalance(spark, sf_dir):
    return S.imbalance(S.class_counts(boxes(spark, sf_dir))).withColumn("imbalance", F.round("imbalance", 9))


@query("n9_n10_run_report", f"""WITH e AS ({EPOCHS}), b AS (SELECT *, lag(metric,20) OVER (PARTITION BY run_id ORDER BY epoch) AS before FROM e),
 r AS (SELECT run_id, count(*) AS epochs, arg_min(metric,epoch) AS first, arg_max(metric,epoch) AS last, max(metric) AS best, arg_max(before, epoch) AS before0, max(CASE WHEN before IS NOT NULL THEN epoch END) AS lb, avg(metric) AS mean, stddev_pop(metric) AS sd FROM b GROUP BY 1),
 x AS (SELECT r.*, (SELECT min(epoch) FROM e WHERE e.run_id=r.run_id AND e.metric=r.best) AS best_epoch, CASE WHEN epochs>20 THEN last-before0 END AS gain FROM r)
 SELECT run_id, epochs, round(first,6) AS first, round(last,6) AS last, round(best,6) AS best, best_epoch, round(gain,6) AS gain, round((first-last)/nullif(first,0)*100,4) AS reduction, round(sd/nullif(mean,0),6) AS cv, CASE WHEN sd/nullif(mean,0)>1 THEN 'high' WHEN sd/nullif(mean,0)>0.5 THEN 'medium' ELSE 'low' END AS spread, best>last*1.1 AS falling, coalesce(gain<0.001,false) AS stagnant FROM x""")
def n9_run_report(spark, sf_dir):
    r = R.run_report(epochs(spark, sf_dir))
    return r.withColumns({c: F.round(c, 6) for c in ("first", "last", "best", "gain", "cv")} | {"reduction": F.round("reduction", 4)})


@query("n11_repair_statistics", f"{B}, s AS (SELECT 'before' AS stage, class_id, w FROM t UNION ALL SELECT 'after', class_id, CASE WHEN w<0.04 THEN 0.05 ELSE w END FROM t) SELECT stage, class_id, count(*) AS n, round(min(w),9) AS least, round(max(w),9) AS most, round(avg(w),6) AS mean, round(median(w),9) AS median, round(avg(CASE WHEN w<0.04 THEN 1 ELSE 0 END),9) AS thin_share FROM s GROUP BY 1,2")
def n11_repair_statistics(spark, sf_dir):
    b = boxes(spark, sf_dir)
    after = b.withColumn("w", G.widened_line(G.box("", C), 0.04, 0.05).c)
    s = S.repair_statistics({"before": b, "after": after})
    return s.withColumns({c: F.round(c, 9) for c in ("least", "most", "median", "thin_share")} | {"mean": F.round("mean", 6)})


@query("n13_gate", f"{ap_sql()} SELECT class_id, round(ap,6) AS ap, ap>=0.65 AS passed FROM ap")
def n13_gate(spark, sf_dir):
    from partita.operators import detection as D

    t = boxes(spark, sf_dir)
    ap = D.average_precision(D.assign(t, detections(spark, sf_dir)), t).select("class_id", "ap")
    return R.gate(ap, {"ap": 0.65}).withColumn("ap", F.round("ap", 6))


@query("k5_leaderboard", f"WITH e AS ({EPOCHS}), b AS (SELECT run_id, max(metric) AS m FROM e WHERE epoch<=5 GROUP BY 1), n AS (SELECT run_id, max(metric) AS m FROM e WHERE epoch>5 GROUP BY 1) SELECT run_id AS model, round(coalesce(n.m, b.m),6) AS map50 FROM b FULL JOIN n USING (run_id)")
def k5_leaderboard(spark, sf_dir):
    e = epochs(spark, sf_dir)
    best = lambda df: df.groupBy(F.col("run_id").alias("model")).agg(F.round(F.max("metric"), 6).alias("map50"))
    return R.upsert_board(best(e.where("epoch <= 5")), best(e.where("epoch > 5")))


@query("k6_metric_columns", f"""WITH e AS ({EPOCHS}) SELECT run_id AS class_id, coalesce(max(metric) FILTER (WHERE epoch%2=0 AND epoch%3=0),0) AS strict_map, coalesce(max(metric) FILTER (WHERE epoch%2=0 AND epoch%3<>0),0) AS strict_recall, coalesce(max(metric) FILTER (WHERE epoch%2=1 AND epoch%3=0),0) AS deploy_map, coalesce(max(metric) FILTER (WHERE epoch%2=1 AND epoch%3<>0),0) AS deploy_recall FROM e GROUP BY 1""")
def k6_metric_columns(spark, sf_dir):
    e = epochs(spark, sf_dir).select(F.col("run_id").alias("class_id"), F.when(F.col("epoch") % 2 == 0, "strict").otherwise("deploy").alias("protocol"), F.when(F.col("epoch") % 3 == 0, "map").otherwise("recall").alias("metric"), F.col("metric").alias("value"))
    return R.pivot_metrics(e, ["strict", "deploy"], ["map", "recall"])
