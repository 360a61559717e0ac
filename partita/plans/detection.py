"""Scoring queries over the box and detection views."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.operators import detection as D
from partita.operators import sweeps
from partita.plans.registry import query
from partita.plans.views import CORNERS, DET_CORNERS, DET_CORNERS_2, boxes, by_image, detections, view


def iou_sql(a: str, b: str) -> str:
    """IoU of two corner boxes, in the order of operations of the column form."""
    common = f"(greatest(0.0, least({a}x2,{b}x2)-greatest({a}x1,{b}x1))*greatest(0.0, least({a}y2,{b}y2)-greatest({a}y1,{b}y1)))"
    union = f"(({a}x2-{a}x1)*({a}y2-{a}y1)+({b}x2-{b}x1)*({b}y2-{b}y1)-{common})"
    return f"(CASE WHEN {union}>0 THEN {common}/{union} ELSE 0.0 END)"


MEET = "t.x1<d.x2 AND d.x1<t.x2 AND t.y1<d.y2 AND d.y1<t.y2"
BASE = f"WITH t AS ({CORNERS}), d AS ({DET_CORNERS})"
PAIRS = f"""{BASE}, p AS (SELECT t.image_id, t.line_no, t.class_id AS tc, d.det_id, d.class_id AS dc, d.conf, {iou_sql('t.', 'd.')} AS iou
 FROM t JOIN d ON t.image_id=d.image_id AND {MEET})"""


@query("pair_iou", f"{PAIRS} SELECT image_id, line_no, det_id, iou FROM p")
def pair_iou(spark, sf_dir):
    pairs = D.box_pairs(boxes(spark, sf_dir), detections(spark, sf_dir))
    return pairs.select("image_id", F.col("t_line_no").alias("line_no"), F.col("d_det_id").alias("det_id"), "iou")


@query("e0_pairs_by_cell", f"{PAIRS} SELECT image_id, line_no, det_id, iou FROM p")
def pairs_by_cell(spark, sf_dir):
    pairs = D.box_pairs(boxes(spark, sf_dir), detections(spark, sf_dir), cell=0.25)
    return pairs.select("image_id", F.col("t_line_no").alias("line_no"), F.col("d_det_id").alias("det_id"), "iou")


def assigned_sql(levels: str = "[0.5]") -> str:
    return f"""{PAIRS}, best AS (SELECT image_id, dc AS class_id, det_id, line_no, iou, row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, line_no) AS k FROM p WHERE tc=dc),
 lv AS (SELECT unnest({levels}) AS threshold), al AS (SELECT lv.threshold, d.image_id, d.class_id, d.det_id, d.conf, b.line_no, coalesce(b.iou>=lv.threshold, false) AS hit
 FROM d CROSS JOIN lv LEFT JOIN (SELECT * FROM best WHERE k=1) b ON b.image_id=d.image_id AND b.det_id=d.det_id),
 a AS (SELECT *, CASE WHEN hit AND row_number() OVER (PARTITION BY threshold, image_id, class_id, line_no, hit ORDER BY conf DESC, det_id)=1 THEN 1 ELSE 0 END AS tp FROM al)"""


def ap_sql(levels: str = "[0.5]") -> str:
    return f"""{assigned_sql(levels)}, nt AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1),
 cu AS (SELECT a.*, n, sum(tp) OVER w AS s, row_number() OVER w AS k FROM a JOIN nt USING (class_id) WINDOW w AS (PARTITION BY threshold, class_id ORDER BY conf DESC, image_id, det_id)),
 en AS (SELECT *, s/n AS recall, max(s/k) OVER (PARTITION BY threshold, class_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cu),
 ga AS (SELECT *, recall-coalesce(lag(recall) OVER (PARTITION BY threshold, class_id ORDER BY k), 0) AS gain FROM en),
 ap AS (SELECT threshold, class_id, coalesce(sum(gain*env), 0) AS ap FROM (SELECT * FROM nt CROSS JOIN lv) LEFT JOIN (SELECT threshold, class_id, gain, env FROM ga) USING (threshold, class_id) GROUP BY 1, 2)"""


@query("e1_assign", f"{assigned_sql()} SELECT image_id, det_id, class_id, tp FROM a")
def e1_assign(spark, sf_dir):
    return D.assign(boxes(spark, sf_dir), detections(spark, sf_dir)).select("image_id", "det_id", "class_id", "tp")


@query("e2_curve", f"{ap_sql()} SELECT class_id, image_id, det_id, s AS tp_sum, k, round(s/n,9) AS recall, round(s/k,9) AS precision FROM cu")
def e2_curve(spark, sf_dir):
    t = boxes(spark, sf_dir)
    c = D.curve(D.assign(t, detections(spark, sf_dir)), t)
    return c.select("class_id", "image_id", "det_id", "tp_sum", F.col("k").cast("long").alias("k"), F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query("e3_average_precision", f"{ap_sql()} SELECT class_id, round(ap,6) AS ap FROM ap")
def e3_average_precision(spark, sf_dir):
    t = boxes(spark, sf_dir)
    return D.average_precision(D.assign(t, detections(spark, sf_dir)), t).select("class_id", F.round("ap", 6).alias("ap"))


@query("map_eval", f"{ap_sql()} SELECT round(avg(ap),6) AS map50, (SELECT count(*) FROM a) AS detections, (SELECT sum(tp) FROM a) AS true_positives FROM ap")
def map_eval(spark, sf_dir):
    t = boxes(spark, sf_dir)
    m = D.summarised(D.class_report(D.assign(t, detections(spark, sf_dir)), t), ("threshold",))
    return m.select(F.round("map", 6).alias("map50"), "detections", "true_positives")


LEVELS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))


@query("e4b_map_coco", f"{ap_sql(str(list(LEVELS)))} SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(ap),6) AS map FROM ap GROUP BY 1")
def e4b_map_coco(spark, sf_dir):
    t, d = by_image(spark, sf_dir)
    m = sweeps.report(sweeps.by_thresholds(t, d, LEVELS), boxes(spark, sf_dir), len(LEVELS)).groupBy("setting").agg(F.avg("ap").alias("map"))
    return m.select(F.element_at(F.array(*map(F.lit, LEVELS)), F.col("setting") + 1).alias("threshold"), F.round("map", 6).alias("map"))


def fold_sql(rows: str, keys: str, order: str, fields: list[str], clash: str) -> str:
    """Rows that clash with none kept before, one after the other: k is a kept row, x[1] the row at hand."""
    pack = ", ".join(f"'{f}': {f}" for f in fields)
    return f"""SELECT {keys}, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {clash}))>0 THEN acc ELSE list_concat(acc, x) END)) AS v
 FROM (SELECT {keys}, list({{{pack}}} ORDER BY {order}) AS xs FROM {rows} GROUP BY {keys})"""


BOX_FIELDS = ["x1", "y1", "x2", "y2"]


@query("nms", f"{BASE} SELECT image_id, v.det_id AS det_id, v.class_id AS class_id FROM ({fold_sql('d', 'image_id', 'conf DESC, det_id', ['det_id', 'class_id', *BOX_FIELDS], iou_sql('k.', 'x[1].') + '>0.5')})")
def nms(spark, sf_dir):
    return D.nms(detections(spark, sf_dir), 0.5).select("image_id", "det_id", "class_id")


@query("e7b_nms_truth", f"{BASE} SELECT image_id, class_id, v.line_no AS line_no FROM ({fold_sql('t', 'image_id, class_id', 'w*h DESC, line_no', ['line_no', *BOX_FIELDS], iou_sql('k.', 'x[1].') + '>=0.3')})")
def e7b_nms_truth(spark, sf_dir):
    return D.nms_truth(boxes(spark, sf_dir), 0.3).select("image_id", "class_id", "line_no")


@query("e7b_recall_ceiling", f"""{BASE}, z AS (SELECT image_id, class_id, v.w AS w FROM ({fold_sql('t', 'image_id, class_id', 'w*h DESC, line_no', ['line_no', 'w', *BOX_FIELDS], iou_sql('k.', 'x[1].') + '>=0.3')})),
 s AS (SELECT t0.class_id, t0.size, t0.n, coalesce(k0.kept,0) AS kept FROM (SELECT class_id, CASE WHEN w<0.05 THEN 'small' ELSE 'large' END AS size, count(*) AS n FROM t GROUP BY 1,2) t0 LEFT JOIN (SELECT class_id, CASE WHEN w<0.05 THEN 'small' ELSE 'large' END AS size, count(*) AS kept FROM z GROUP BY 1,2) k0 USING (class_id, size))
 SELECT class_id, size, n, kept, round(kept/n,9) AS ceiling FROM (SELECT * FROM s UNION ALL SELECT class_id, 'all', sum(n), sum(kept) FROM s GROUP BY 1)""")
def e7b_recall_ceiling(spark, sf_dir):
    r = D.recall_ceiling(boxes(spark, sf_dir), 0.3)
    return r.select("class_id", "size", "n", "kept", F.round("ceiling", 9).alias("ceiling"))


def greedy_sql(order: str, same_class: bool = True) -> str:
    where, keys = ("WHERE tc=dc AND iou>=0.5", "image_id, tc") if same_class else ("WHERE iou>=0.5", "image_id")
    return fold_sql(f"(SELECT * FROM p {where})", keys, f"{order}, iou DESC, line_no", ["det_id", "line_no", "iou"], "k.det_id=x[1].det_id OR k.line_no=x[1].line_no")


@query("e1b_greedy_match", f"{PAIRS} SELECT image_id, tc AS class_id, v.det_id AS det_id, v.line_no AS line_no, v.iou AS iou FROM ({greedy_sql('conf DESC, det_id')})")
def e1b_greedy_match(spark, sf_dir):
    return D.greedy_match(boxes(spark, sf_dir), detections(spark, sf_dir), 0.5)


def fusion_sql(weights: tuple[float, float]) -> str:
    """CTEs up to fu: boxes of two models by weighted confidence, each merged into the fused box it overlaps most, or a new one."""
    total = sum(weights)
    box_of = "{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'conf': o.conf, 'n': 1}"
    merged = ", ".join(f"'{p}': (c.{p}*c.conf+o.{p}*o.conf)/(c.conf+o.conf)" for p in BOX_FIELDS)
    return f"""WITH RECURSIVE m1 AS ({DET_CORNERS}), m2 AS ({DET_CORNERS_2}),
 al AS (SELECT image_id, class_id, 0 AS model, det_id, conf*{weights[0]}::DOUBLE AS conf, x1, y1, x2, y2 FROM m1 WHERE conf>=0.01 UNION ALL SELECT image_id, class_id, 1, det_id, conf*{weights[1]}::DOUBLE, x1, y1, x2, y2 FROM m2 WHERE conf>=0.01),
 o AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY conf DESC, model, det_id) AS k FROM al),
 r AS (SELECT image_id, class_id, k, [{box_of}] AS cl FROM o WHERE k=1
  UNION ALL SELECT o.image_id, o.class_id, o.k, CASE WHEN list_max(list_transform(r.cl, lambda c: {iou_sql('c.', 'o.')}))>0.55
   THEN list_transform(r.cl, lambda c, i: CASE WHEN i=list_position(list_transform(r.cl, lambda z: {iou_sql('z.', 'o.')}), list_max(list_transform(r.cl, lambda z: {iou_sql('z.', 'o.')}))) THEN {{{merged}, 'conf': c.conf+o.conf, 'n': c.n+1}} ELSE c END)
   ELSE list_concat(r.cl, [{box_of}]) END FROM r JOIN o ON o.image_id=r.image_id AND o.class_id=r.class_id AND o.k=r.k+1),
 fu AS (SELECT image_id, class_id, c.x1 AS x1, c.y1 AS y1, c.x2 AS x2, c.y2 AS y2, c.conf/c.n*least({total}::DOUBLE, c.n)/{total}::DOUBLE AS conf, c.n AS members FROM (SELECT image_id, class_id, unnest(cl) AS c FROM r QUALIFY row_number() OVER (PARTITION BY image_id, class_id ORDER BY k DESC)=1))"""


@query("e8_fusion", f"{fusion_sql((1.0, 2.0))} SELECT * FROM fu")
def e8_fusion(spark, sf_dir):
    one, two = detections(spark, sf_dir), view(spark, sf_dir, DET_CORNERS_2)
    return D.fuse([(one, 1.0), (two, 2.0)])


@query("e8b_agreement", f"{fusion_sql((1.0, 1.0))}, mo AS (SELECT image_id, max(n) AS most FROM (SELECT image_id, count(*) AS n FROM m1 GROUP BY 1 UNION ALL SELECT image_id, count(*) FROM m2 GROUP BY 1) GROUP BY 1) SELECT image_id, most, coalesce(fused,0) AS fused, round(coalesce(fused,0)/most,9) AS ratio FROM mo LEFT JOIN (SELECT image_id, count(*) AS fused FROM fu GROUP BY 1) USING (image_id)")
def e8b_agreement(spark, sf_dir):
    one, two = detections(spark, sf_dir), view(spark, sf_dir, DET_CORNERS_2)
    return D.agreement(D.fuse([(one, 1.0), (two, 1.0)]), [one, two]).withColumn("ratio", F.round("ratio", 9))


#: The two usual protocols.
PROTOCOLS = [("strict", 0.001, 0.7), ("deploy", 0.25, 0.55)]


def protocol_sql(rows: list[tuple[str, float, float]]) -> str:
    values = ", ".join(f"('{n}', CAST({c} AS DOUBLE), CAST({i} AS DOUBLE))" for n, c, i in rows)
    return f"""WITH t AS ({CORNERS}), d0 AS ({DET_CORNERS}), pr(name, min_conf, nms_iou) AS (VALUES {values}),
 q AS (SELECT name, nms_iou, d0.* FROM d0 JOIN pr ON conf>=min_conf),
 d AS (SELECT name, image_id, v.det_id AS det_id, v.class_id AS class_id, v.conf AS conf, v.x1 AS x1, v.y1 AS y1, v.x2 AS x2, v.y2 AS y2
  FROM ({fold_sql('q', 'name, image_id', 'conf DESC, det_id', ['det_id', 'class_id', 'conf', 'nms_iou', *BOX_FIELDS], iou_sql('k.', 'x[1].') + '>x[1].nms_iou')})),
 best AS (SELECT name, d.image_id, d.det_id, line_no, {iou_sql('t.', 'd.')} AS iou, row_number() OVER (PARTITION BY name, d.image_id, det_id ORDER BY {iou_sql('t.', 'd.')} DESC, line_no) AS k FROM t JOIN d ON t.image_id=d.image_id AND t.class_id=d.class_id AND {MEET}),
 al AS (SELECT d.*, b.line_no, coalesce(b.iou>=0.5, false) AS hit FROM d LEFT JOIN (SELECT * FROM best WHERE k=1) b ON b.name=d.name AND b.image_id=d.image_id AND b.det_id=d.det_id),
 a AS (SELECT *, CASE WHEN hit AND row_number() OVER (PARTITION BY name, image_id, class_id, line_no, hit ORDER BY conf DESC, det_id)=1 THEN 1 ELSE 0 END AS tp FROM al),
 nt AS (SELECT class_id, count(*) AS n FROM t GROUP BY 1),
 cu AS (SELECT a.*, n, sum(tp) OVER w AS s, row_number() OVER w AS k FROM a JOIN nt USING (class_id) WINDOW w AS (PARTITION BY name, class_id ORDER BY conf DESC, image_id, det_id)),
 en AS (SELECT *, s/n AS recall, max(s/k) OVER (PARTITION BY name, class_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cu),
 ga AS (SELECT *, recall-coalesce(lag(recall) OVER (PARTITION BY name, class_id ORDER BY k), 0) AS gain FROM en),
 ap AS (SELECT name, class_id, coalesce(sum(gain*env), 0) AS ap FROM (SELECT * FROM nt CROSS JOIN (SELECT DISTINCT name FROM d)) LEFT JOIN (SELECT name, class_id, gain, env FROM ga) USING (name, class_id) GROUP BY 1, 2),
 ev AS (SELECT name, avg(ap) AS map50, any_value(pq.precision) AS precision, any_value(pq.recall) AS recall FROM ap JOIN (SELECT name, sum(tp)/count(*) AS precision, sum(tp)/(SELECT count(*) FROM t) AS recall FROM a GROUP BY 1) pq USING (name) GROUP BY 1)"""


def _rounded(df):
    return df.select("name", *[F.round(c, 6).alias(c) for c in ("map50", "precision", "recall")])


@query("e5_protocols", f"{protocol_sql(PROTOCOLS)} SELECT name, round(map50,6) AS map50, round(precision,6) AS precision, round(recall,6) AS recall FROM ev")
def e5_protocols(spark, sf_dir):
    return _rounded(sweeps.evaluate(*by_image(spark, sf_dir), PROTOCOLS))


GRID = [(f"{c}/{i}", c, i) for c in (0.15, 0.3, 0.5) for i in (0.5, 0.6)]


@query("e6_sweep", f"{protocol_sql(GRID)} SELECT name, round(map50,6) AS map50, CAST(row_number() OVER (ORDER BY map50 DESC, name) AS INT) AS place FROM ev QUALIFY place<=5")
def e6_sweep(spark, sf_dir):
    from partita.operators.reports import best_first

    found = sweeps.evaluate(*by_image(spark, sf_dir), GRID)
    return best_first(found, [F.desc("map50"), F.col("name")], 5).select("name", F.round("map50", 6).alias("map50"), "place")


_STAGES = [(f"{c}/{i}", c, i) for c in (0.15, 0.25, 0.4, 0.6) for i in (0.5, 0.55, 0.7)]


@query("e6b_staged_sweep", f"""{protocol_sql(_STAGES)}, ea AS (SELECT ev.*, pr.min_conf, pr.nms_iou FROM ev JOIN pr USING (name)), s1 AS (SELECT min_conf FROM ea WHERE nms_iou=0.55 QUALIFY row_number() OVER (ORDER BY precision>=0.5 DESC, map50 DESC, min_conf::VARCHAR)<=3)
 SELECT name, round(map50,6) AS map50, round(precision,6) AS precision, round(recall,6) AS recall, CAST(row_number() OVER (ORDER BY precision>=0.5 DESC, map50 DESC, name) AS INT) AS place FROM ea WHERE nms_iou IN (0.5,0.7) AND min_conf IN (SELECT min_conf FROM s1)""")
def e6b_staged_sweep(spark, sf_dir):
    found = D.staged_sweep(*by_image(spark, sf_dir), (0.15, 0.25, 0.4, 0.6), 0.55, (0.5, 0.7))
    return found.select("name", *[F.round(c, 6).alias(c) for c in ("map50", "precision", "recall")], "place")


@query("e9_error_classes", f"""{PAIRS}, top AS (SELECT image_id, det_id, max(iou) FILTER (WHERE tc=dc) AS si, arg_max(line_no, iou*1e9-line_no*1e-3) FILTER (WHERE tc=dc) AS st, max(iou) FILTER (WHERE tc<>dc) AS oi, arg_max(line_no, iou*1e9-line_no*1e-3) FILTER (WHERE tc<>dc) AS ot FROM p GROUP BY 1,2),
 x AS (SELECT d.image_id, d.det_id, d.conf, coalesce(si,0) AS si, st, coalesce(oi,0) AS oi, ot FROM d LEFT JOIN top USING (image_id, det_id)),
 e AS (SELECT *, CASE WHEN si>=0.5 AND row_number() OVER (PARTITION BY image_id, st, si>=0.5 ORDER BY conf DESC, det_id)=1 THEN 'Match' WHEN si>=0.5 THEN 'Dupe' WHEN si>=0.1 THEN 'Loc' WHEN oi>=0.5 THEN 'Cls' WHEN oi>=0.1 THEN 'Both' ELSE 'Bkg' END AS error FROM x),
 pt AS (SELECT DISTINCT image_id, CASE WHEN error IN ('Match','Loc') THEN st WHEN error='Cls' THEN ot END AS line_no FROM e)
 SELECT image_id, 'detection' AS kind, det_id AS id, error FROM e UNION ALL SELECT image_id, 'truth', line_no, 'Miss' FROM t WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.image_id=t.image_id AND pt.line_no=t.line_no)""")
def e9_error_classes(spark, sf_dir):
    return D.error_classes(boxes(spark, sf_dir), detections(spark, sf_dir))
