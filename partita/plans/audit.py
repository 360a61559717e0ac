"""Audit queries over the box and detection views."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.operators import audit as A
from partita.plans.detection import BASE, MEET, PAIRS, fold_sql, greedy_sql, iou_sql
from partita.plans.registry import query
from partita.plans.views import CORNERS, DET_CORNERS, boxes, detections

_LONG = f"""{BASE}, m AS (SELECT image_id, line_no, class_id, cx, cy, w, h, w*h AS area, CASE WHEN h=0 THEN 'infinity'::DOUBLE ELSE w/h END AS aspect FROM t),
 l AS (SELECT image_id, line_no, class_id, unnest(['w','h','area','aspect']) AS metric, unnest([w,h,area,aspect]) AS value FROM m),
 st AS (SELECT class_id, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS least, max(value) AS most FROM l WHERE value<'infinity'::DOUBLE GROUP BY 1,2)"""


@query("e14_class_statistics", f"{_LONG} SELECT class_id, metric, n, round(mean,6) AS mean, round(sd,6) AS sd, least, most FROM st")
def e14_class_statistics(spark, sf_dir):
    s = A.class_statistics(boxes(spark, sf_dir))
    return s.select("class_id", "metric", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "least", "most")


_ANOMALIES = f"""{_LONG}, an AS (
 SELECT image_id, line_no, class_id, 'zero_side' AS anomaly, 'critical' AS severity FROM m WHERE w<=0 OR h<=0
 UNION ALL SELECT image_id, line_no, class_id, 'centre_outside', 'critical' FROM m WHERE cx<0 OR cx>1 OR cy<0 OR cy>1
 UNION ALL SELECT image_id, line_no, class_id, 'exceeds_image', 'high' FROM m WHERE cx-w/2<0 OR cy-h/2<0 OR cx+w/2>1 OR cy+h/2>1
 UNION ALL SELECT image_id, line_no, class_id, 'too_small', 'medium' FROM m WHERE area>0 AND area<0.0001
 UNION ALL SELECT image_id, line_no, class_id, 'too_large', 'high' FROM m WHERE area>0.5
 UNION ALL SELECT image_id, line_no, class_id, 'aspect_wide', 'medium' FROM m WHERE aspect>20 AND aspect<'infinity'::DOUBLE
 UNION ALL SELECT image_id, line_no, class_id, 'aspect_tall', 'medium' FROM m WHERE aspect>0 AND aspect<1/20
 UNION ALL SELECT image_id, line_no, class_id, 'aspect_infinite', 'critical' FROM m WHERE aspect='infinity'::DOUBLE AND w>0
 UNION ALL SELECT image_id, line_no, class_id, metric||'_sigma_'||printf('%.1f', abs(value-mean)/sd), CASE WHEN abs(value-mean)/sd>=6 THEN 'critical' WHEN abs(value-mean)/sd>=4.5 THEN 'high' ELSE 'medium' END
  FROM l JOIN st USING (class_id, metric) WHERE sd>0 AND value<'infinity'::DOUBLE AND abs(value-mean)/sd>3)"""


@query("geometry_audit", f"{_ANOMALIES} SELECT * FROM an")
def geometry_audit(spark, sf_dir):
    return A.geometry_anomalies(boxes(spark, sf_dir))


@query("e14c_anomaly_summary", f"{_ANOMALIES} SELECT split_part(anomaly,'_sigma_',1) AS base, severity, count(*) AS n, count(DISTINCT image_id) AS images, round(count(DISTINCT image_id)/(SELECT count(DISTINCT image_id) FROM t),9) AS rate FROM an GROUP BY 1,2")
def e14c_anomaly_summary(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return A.anomaly_summary(A.geometry_anomalies(b), b).withColumn("rate", F.round("rate", 9))


_FINDINGS = f"""{PAIRS}, fi AS (
 SELECT d.image_id, 'missing' AS kind, CAST(NULL AS INT) AS gt_class, class_id AS pred_class, CAST(NULL AS INT) AS line_no, det_id, conf, coalesce(b,0) AS iou, 0.9*conf AS severity FROM d LEFT JOIN (SELECT image_id, det_id, max(iou) AS b FROM p GROUP BY 1,2) USING (image_id, det_id) WHERE conf>0.5 AND coalesce(b,0)<0.3
 UNION ALL SELECT t.image_id, 'phantom', class_id, NULL, line_no, NULL, NULL, coalesce(b,0), 0.8 FROM t LEFT JOIN (SELECT image_id, line_no, max(iou) AS b FROM p GROUP BY 1,2) USING (image_id, line_no) WHERE coalesce(b,0)<0.3
 UNION ALL SELECT image_id, 'misaligned', tc, dc, line_no, det_id, conf, iou, 0.4*(1-iou) FROM p WHERE tc=dc AND iou>=0.3 AND iou<0.5
 UNION ALL SELECT image_id, 'mismatch', tc, dc, line_no, det_id, conf, iou, 0.7*iou FROM p WHERE tc<>dc AND iou>=0.5)"""


@query("confidence_audit", f"{_FINDINGS} SELECT image_id, kind, gt_class, pred_class, line_no, det_id, conf, round(iou,9) AS iou, round(severity,9) AS severity FROM fi")
def confidence_audit(spark, sf_dir):
    found = A.confidence_findings(boxes(spark, sf_dir), detections(spark, sf_dir), digits=None)
    return found.withColumns({c: F.round(c, 9) for c in ("iou", "severity")})


@query("e11b_finding_summary", f"{_FINDINGS} SELECT class_id, {', '.join(f"count(*) FILTER (WHERE kind='{k}') AS {k}" for k in A.FINDINGS)} FROM (SELECT coalesce(gt_class, pred_class) AS class_id, kind FROM fi) GROUP BY ROLLUP (class_id)")
def e11b_finding_summary(spark, sf_dir):
    return A.finding_summary(A.confidence_findings(boxes(spark, sf_dir), detections(spark, sf_dir)))


_CONFUSION = f"""{PAIRS}, g AS (SELECT image_id, v.det_id AS det_id, v.line_no AS line_no FROM ({greedy_sql('conf DESC, det_id', False)})),
 cm AS (SELECT gt_class, pred_class, count(*) AS n FROM (SELECT t.image_id, t.class_id AS gt_class, g.det_id FROM t LEFT JOIN g USING (image_id, line_no)) x
  FULL JOIN (SELECT image_id, det_id, class_id AS pred_class FROM d) y ON x.image_id=y.image_id AND x.det_id=y.det_id GROUP BY 1,2)"""


@query("e12_confusion", f"{_CONFUSION} SELECT * FROM cm")
def e12_confusion(spark, sf_dir):
    return A.confusion(boxes(spark, sf_dir), detections(spark, sf_dir))


@query("e12b_top_confusions", f"{_CONFUSION} SELECT gt_class, pred_class, n, gt_class IN (0, 3) AS priority FROM cm WHERE gt_class<>pred_class ORDER BY n DESC, gt_class, pred_class LIMIT 10")
def e12b_top_confusions(spark, sf_dir):
    return A.top_confusions(A.confusion(boxes(spark, sf_dir), detections(spark, sf_dir)), 10, (0, 3))


@query("e12c_confusion_examples", f"""{PAIRS}, b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, line_no)=1)
 SELECT tc AS gt_class, dc AS pred_class, CAST(row_number() OVER (PARTITION BY tc, dc ORDER BY image_id, det_id) AS INT) AS example, image_id, line_no, det_id, iou FROM b WHERE iou>=0.5 AND tc<>dc QUALIFY example<=3""")
def e12c_confusion_examples(spark, sf_dir):
    return A.confusion_examples(boxes(spark, sf_dir), detections(spark, sf_dir))


_HARD = f"""WITH RECURSIVE t AS ({CORNERS}), d AS ({DET_CORNERS}), t0 AS (SELECT * FROM t WHERE class_id IN (0, 9, 21)),
 p AS MATERIALIZED (SELECT image_id, det_id, line_no, row_number() OVER (PARTITION BY image_id ORDER BY det_id, iou DESC, line_no) AS turn FROM (SELECT t.image_id, t.line_no, d.det_id, {iou_sql('t.', 'd.')} AS iou FROM t0 t JOIN (SELECT * FROM d WHERE class_id IN (0, 9, 21)) d ON t.image_id=d.image_id AND {MEET}) WHERE iou>=0.5),
 w AS (SELECT image_id, CAST(0 AS BIGINT) AS turn, CAST([] AS INT[]) AS dets, CAST([] AS INT[]) AS lines, CAST(NULL AS INT) AS det_id, CAST(NULL AS INT) AS line_no FROM (SELECT DISTINCT image_id FROM p)
  UNION ALL SELECT p.image_id, p.turn, CASE WHEN free THEN list_append(dets, p.det_id) ELSE dets END, CASE WHEN free THEN list_append(lines, p.line_no) ELSE lines END, CASE WHEN free THEN p.det_id END, CASE WHEN free THEN p.line_no END
  FROM (SELECT p.*, dets, lines, NOT list_contains(dets, p.det_id) AND NOT list_contains(lines, p.line_no) AS free FROM w JOIN p ON p.image_id=w.image_id AND p.turn=w.turn+1) p),
 g AS (SELECT image_id, det_id, line_no FROM w WHERE det_id IS NOT NULL),
 r AS (SELECT g.image_id, g.line_no, t0.class_id, d.class_id AS pred, d.conf FROM g JOIN t0 ON t0.image_id=g.image_id AND t0.line_no=g.line_no JOIN d ON d.image_id=g.image_id AND d.det_id=g.det_id),
 hx AS (SELECT image_id, CASE WHEN pred<>class_id THEN 'misclass' ELSE 'low_conf' END AS kind, class_id, line_no, CASE WHEN pred<>class_id THEN 1.5 ELSE 1+(CAST(0.3 AS DOUBLE)-conf) END AS difficulty FROM r WHERE pred<>class_id OR conf<0.3
  UNION ALL SELECT image_id, 'FN', class_id, line_no, 2.0 FROM t0 WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.image_id=t0.image_id AND g.line_no=t0.line_no))"""


@query("e13_hard_examples", f"{_HARD} SELECT image_id, kind, class_id, line_no, round(difficulty,9) AS difficulty FROM hx")
def e13_hard_examples(spark, sf_dir):
    return A.hard_examples(boxes(spark, sf_dir), detections(spark, sf_dir), (0, 9, 21)).withColumn("difficulty", F.round("difficulty", 9))


@query("e13b_hard_summary", f"""{_HARD} SELECT class_id, count(*) FILTER (WHERE kind='FN') AS fn, count(*) FILTER (WHERE kind='low_conf') AS low_conf, count(*) FILTER (WHERE kind='misclass') AS misclass, count(DISTINCT image_id) AS images,
 count(DISTINCT CASE WHEN difficulty>=1.5 THEN image_id END) AS hard_images, round(avg(difficulty),9) AS mean_difficulty, round(max(difficulty),9) AS most FROM hx GROUP BY 1""")
def e13b_hard_summary(spark, sf_dir):
    s = A.hard_summary(A.hard_examples(boxes(spark, sf_dir), detections(spark, sf_dir), (0, 9, 21)))
    return s.withColumns({c: F.round(c, 9) for c in ("mean_difficulty", "most")})


_QUALITY = f"""{PAIRS}, gt AS (SELECT image_id, line_no, coalesce(max(iou) FILTER (WHERE tc=dc),0) AS own, coalesce(max(iou*conf) FILTER (WHERE tc<>dc),0) AS other FROM p GROUP BY 1,2),
 g AS (SELECT t.image_id, avg(coalesce(own,0)) AS located, avg(1-coalesce(other,0)) AS swapped FROM t LEFT JOIN gt USING (image_id, line_no) GROUP BY 1),
 o AS (SELECT d.image_id, avg(1-CASE WHEN coalesce(b,0)<0.1 THEN conf ELSE 0 END) AS overlooked FROM d LEFT JOIN (SELECT image_id, det_id, max(iou) AS b FROM p GROUP BY 1,2) USING (image_id, det_id) GROUP BY 1),
 s AS (SELECT image_id, power(coalesce(located,1)*coalesce(swapped,1)*coalesce(overlooked,1), 1.0::DOUBLE/3) AS score FROM g FULL JOIN o USING (image_id))
"""


@query("e10_label_quality", f"{_QUALITY} SELECT image_id, round(score,6) AS score, score<0.5 AS issue FROM s")
def e10_label_quality(spark, sf_dir):
    return A.label_quality(boxes(spark, sf_dir), detections(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("e10_quality_summary", f"{_QUALITY} SELECT count(*) AS images, count(*) FILTER (WHERE score<0.5) AS issues, round(avg(score),9) AS mean, round(median(score),9) AS median, round(min(score),9) AS least FROM s")
def e10_quality_summary(spark, sf_dir):
    q = A.quality_summary(A.label_quality(boxes(spark, sf_dir), detections(spark, sf_dir)))
    return q.withColumns({c: F.round(c, 9) for c in ("mean", "median", "least")})


@query("e10_worst_images", f"{_QUALITY} SELECT image_id, round(score,6) AS score, CAST(row_number() OVER (ORDER BY score, image_id) AS INT) AS place FROM s QUALIFY place<=100")
def e10_worst_images(spark, sf_dir):
    return A.worst_images(A.label_quality(boxes(spark, sf_dir), detections(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query("e10_worst_classes", f"{_QUALITY} SELECT class_id, count(*) AS n, count(DISTINCT image_id) AS images FROM t WHERE image_id IN (SELECT image_id FROM s ORDER BY score, image_id LIMIT 100) GROUP BY 1")
def e10_worst_classes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return A.worst_classes(A.label_quality(b, detections(spark, sf_dir)), b)


_SELF = f"""{BASE}, sp AS (SELECT a.image_id, a.line_no AS la, a.class_id AS ca, b.line_no AS lb, b.class_id AS cb, {iou_sql('a.', 'b.')} AS iou FROM t a JOIN t b ON a.image_id=b.image_id AND a.line_no<b.line_no AND a.x1<b.x2 AND b.x1<a.x2 AND a.y1<b.y2 AND b.y1<a.y2)"""


_ANCHORS, _OVERSIZED = (0, 3), (6, 9, 12, 15)


@query("e15_co_location", f"""{BASE}, x AS (SELECT o.image_id, o.line_no, o.class_id, o.w*o.h AS ao, m.line_no AS ml, m.class_id AS mc, m.w*m.h AS am FROM t o JOIN t m ON o.image_id=m.image_id AND o.x1<m.x2 AND m.x1<o.x2 AND o.y1<m.y2 AND m.y1<o.y2 AND {iou_sql('o.', 'm.')}>=0.5 WHERE o.class_id IN {_OVERSIZED} AND m.class_id IN {_ANCHORS + _OVERSIZED}),
 y AS (SELECT image_id, line_no, count(*) FILTER (WHERE mc IN {_ANCHORS})>0 AS a, bool_or(mc IN {_OVERSIZED} AND mc<>class_id) AS o, coalesce(arg_min(ao>=am, ml) FILTER (WHERE mc IN {_ANCHORS}), false) AS l FROM x GROUP BY 1,2),
 z AS (SELECT class_id, count(*) AS n, count(*) FILTER (WHERE a) AS with_anchor, count(*) FILTER (WHERE o) AS with_oversized, count(*) FILTER (WHERE l) AS larger FROM t LEFT JOIN y USING (image_id, line_no) WHERE class_id IN {_OVERSIZED} GROUP BY 1)
 SELECT *, round(with_anchor/n,9) AS share, CASE WHEN with_anchor/n>=0.7 THEN CASE WHEN larger>with_anchor*0.5 THEN 'top_edge' ELSE 'centre' END WHEN with_anchor/n>=0.3 THEN 'per_image' ELSE 'manual' END AS strategy FROM z""")
def e15_co_location(spark, sf_dir):
    """At IoU 0.5, for boxes drawn at random hardly ever reach 0.85."""
    return A.co_location(boxes(spark, sf_dir), _ANCHORS, _OVERSIZED, 0.5).withColumn("share", F.round("share", 9))


@query("e15c_class_matrix", f"{_SELF} SELECT least(ca,cb) AS class_a, greatest(ca,cb) AS class_b, count(DISTINCT image_id) AS images FROM sp WHERE iou>=0.5 AND ca<>cb GROUP BY 1,2")
def e15c_class_matrix(spark, sf_dir):
    return A.class_matrix(boxes(spark, sf_dir), 0.5)


@query("e15d_rounded_duplicates", f"{BASE} SELECT image_id, CAST(round_even(cx/0.05::DOUBLE,0) AS BIGINT) AS k_cx, CAST(round_even(cy/0.05::DOUBLE,0) AS BIGINT) AS k_cy, CAST(round_even(w/0.05::DOUBLE,0) AS BIGINT) AS k_w, CAST(round_even(h/0.05::DOUBLE,0) AS BIGINT) AS k_h, count(*) AS n, count(DISTINCT class_id) AS classes FROM t GROUP BY 1,2,3,4,5 HAVING count(*)>1")
def e15d_rounded_duplicates(spark, sf_dir):
    return A.rounded_duplicates(boxes(spark, sf_dir), 0.05)


_NEAR = f"""{BASE}, b AS (SELECT * FROM t WHERE class_id IN (0,3)), nn AS (SELECT x.image_id, x.line_no, sqrt(min((x.cx-y.cx)*(x.cx-y.cx)+(x.cy-y.cy)*(x.cy-y.cy))) AS distance, max({iou_sql('x.', 'y.')}) AS overlap FROM b x JOIN b y ON x.image_id=y.image_id AND x.line_no<>y.line_no GROUP BY 1,2)"""


@query("e17_nearest", f"{_NEAR} SELECT image_id, line_no, distance, overlap FROM nn")
def e17_nearest(spark, sf_dir):
    return A.nearest(boxes(spark, sf_dir), (0, 3))


@query("e17_distance_percentiles", f"{_NEAR} " + " UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS share, round(quantile_cont(distance, {s}),9) AS value FROM nn" for s in (0.05, 0.25, 0.5, 0.75, 0.95)))
def e17_distance_percentiles(spark, sf_dir):
    return A.distribution(A.nearest(boxes(spark, sf_dir), (0, 3)), "distance").withColumn("value", F.round("value", 9))


@query("e15e_nearest_shares", f"{_NEAR} SELECT count(*) AS n, round(avg(CASE WHEN overlap>0.9 THEN 1 ELSE 0 END),9) AS coincide, round(avg(CASE WHEN distance<0.05 THEN 1 ELSE 0 END),9) AS close FROM nn")
def e15e_nearest_shares(spark, sf_dir):
    n = A.nearest_shares(A.nearest(boxes(spark, sf_dir), (0, 3)))
    return n.withColumns({c: F.round(c, 9) for c in ("coincide", "close")})


@query("e15b_relative_position", f"""{_SELF}, r AS (SELECT t.image_id, t.line_no, t.class_id, arg_min((t.cx-a.cx)/a.w, a.line_no) AS dx FROM t JOIN t a ON t.image_id=a.image_id AND a.class_id IN (0,3) AND t.class_id NOT IN (0,3) AND {iou_sql('t.', 'a.')}>=0.3 GROUP BY 1,2,3)
 SELECT class_id, count(*) AS n, round(quantile_cont(dx,0.05),9) AS p5, round(quantile_cont(dx,0.5),9) AS p50, round(quantile_cont(dx,0.95),9) AS p95 FROM r GROUP BY 1""")
def e15b_relative_position(spark, sf_dir):
    r = A.relative_position(boxes(spark, sf_dir), (0, 3))
    q = lambda s: F.round(F.percentile("dx", F.lit(s)), 9)
    return r.groupBy("class_id").agg(F.count("*").alias("n"), q(0.05).alias("p5"), q(0.5).alias("p50"), q(0.95).alias("p95"))


@query("e16_oversize", f"""{BASE}, m AS (SELECT class_id, median(w) FILTER (WHERE image_id%2=0) AS wa, median(h) FILTER (WHERE image_id%2=0) AS ha, median(w) FILTER (WHERE image_id%2=1) AS wb, median(h) FILTER (WHERE image_id%2=1) AS hb FROM t GROUP BY 1)
 SELECT class_id, round(wa/wb,9) AS w_ratio, round(ha/hb,9) AS h_ratio, CASE WHEN greatest(wa/wb,ha/hb) IS NULL THEN 'no_reference' WHEN greatest(wa/wb,ha/hb)>2 THEN 'oversized' WHEN greatest(wa/wb,ha/hb)>1.5 THEN 'slightly_oversized' ELSE 'ok' END AS verdict FROM m""")
def e16_oversize(spark, sf_dir):
    o = A.oversize(boxes(spark, sf_dir), F.when(F.col("image_id") % 2 == 0, "a").otherwise("b"))
    return o.withColumns({c: F.round(c, 9) for c in ("w_ratio", "h_ratio")})


@query("e17b_densest", f"{_SELF}, tp AS (SELECT image_id, count(*) AS boxes FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100) SELECT image_id, boxes, coalesce(n,0) AS pairs FROM tp LEFT JOIN (SELECT image_id, count(*) AS n FROM sp WHERE iou>0.01 GROUP BY 1) USING (image_id)")
def e17b_densest(spark, sf_dir):
    return A.densest(boxes(spark, sf_dir), 100)


@query("e18_sizes_by_source", f"{BASE} SELECT CASE WHEN image_id%5=0 THEN 'a' ELSE 'b' END AS source, class_id, count(*) AS n, count(*) FILTER (WHERE w<0.05) AS small, round(quantile_cont(w*h,0.5),9) AS median_area FROM t GROUP BY 1,2")
def e18_sizes_by_source(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("source", F.when(F.col("image_id") % 5 == 0, "a").otherwise("b"))
    return A.sizes_by_source(b).withColumn("median_area", F.round("median_area", 9))


@query("e18_oversampling", f"{BASE} SELECT class_id, count(*) FILTER (WHERE image_id%4<>0) AS originals, count(*) FILTER (WHERE image_id%4=0) AS copies, count(DISTINCT CASE WHEN image_id%4<>0 THEN image_id END) AS original_images, count(DISTINCT CASE WHEN image_id%4=0 THEN image_id END) AS copied_images, round(count(*)/nullif(count(*) FILTER (WHERE image_id%4<>0),0),9) AS factor FROM t GROUP BY 1")
def e18_oversampling(spark, sf_dir):
    return A.oversampling(boxes(spark, sf_dir), F.col("image_id") % 4 == 0).withColumn("factor", F.round("factor", 9))


@query("e18b_sample_sizes", f"{BASE} SELECT class_id, count(*) AS n, list({{'w': w, 'h': h}} ORDER BY line_no)[1:3] AS sizes FROM t WHERE image_id=(SELECT min(image_id) FROM t) GROUP BY 1")
def e18b_sample_sizes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return A.sample_sizes(b, b.agg(F.min("image_id")).first()[0])


@query("e18c_suppressed_images", f"""{BASE}, z AS (SELECT image_id FROM ({fold_sql('t', 'image_id, class_id', 'w*h DESC, line_no', ['line_no', 'x1', 'y1', 'x2', 'y2'], iou_sql('k.', 'x[1].') + '>=0.3')})),
 s AS (SELECT image_id, n-k AS lost FROM (SELECT image_id, count(*) AS n FROM t GROUP BY 1) JOIN (SELECT image_id, count(*) AS k FROM z GROUP BY 1) USING (image_id))
 SELECT unnest([1,2,5]) AS at_least, unnest([count(*) FILTER (WHERE lost>=1), count(*) FILTER (WHERE lost>=2), count(*) FILTER (WHERE lost>=5)]) AS images FROM s""")
def e18c_suppressed_images(spark, sf_dir):
    return A.suppressed_images(boxes(spark, sf_dir), 0.3)


@query("e19_size_kinds", f"{BASE} SELECT class_id, CASE WHEN least(w,h)<=0 THEN 'degenerate' WHEN least(w,h)<0.03 THEN 'tiny' WHEN greatest(w,h)>0.15 THEN 'large' ELSE 'ordinary' END AS kind, count(*) AS n FROM t GROUP BY 1,2")
def e19_size_kinds(spark, sf_dir):
    return A.size_kinds(boxes(spark, sf_dir))
