"""Assembly queries: symbols from the box view, scaled to pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.functions import pitch
from partita.operators import assembly as M
from partita.operators import harmony
from partita.plans.detection import fold_sql
from partita.plans.harmony import violations_sql
from partita.plans.registry import query
from partita.plans.views import CORNERS, DET_CORNERS, boxes, by_image, detections
from partita.sources.storage import written

#: Symbols in pixels; four staves a page at fixed heights.
S = f"WITH sy AS (SELECT image_id, line_no AS sym_id, class_id, cx*1280 AS x, cy*1280 AS y FROM ({CORNERS}) t), st AS (SELECT image_id, k AS staff_idx, CAST(100+300*k AS DOUBLE) AS top, CAST(20 AS DOUBLE) AS spacing FROM (SELECT DISTINCT image_id FROM sy), (SELECT unnest([0,1,2,3]) AS k))"
HEADS, BARS, CLEFS = (0, 3, 6, 18, 27), (21, 24), {9: "treble", 30: "bass"}
RS = S.replace("WITH sy", "WITH RECURSIVE sy", 1)


def clusters_sql(rows: str, keys: str, name: str = "cl") -> str:
    """CTEs: rows (keys, sym_id, x) from left to right, each beside the running mean of the cluster at hand, or in a new one."""
    on = " AND ".join(f"b.{k}=a.{k}" for k in keys.split(", "))
    out = ", ".join(f"b.{k}" for k in keys.split(", "))
    near = "abs(b.x-a.s/a.n)<=20"
    return f"""{name}_o AS (SELECT {keys}, sym_id, x, row_number() OVER (PARTITION BY {keys} ORDER BY x, sym_id) AS k FROM {rows}),
 {name} AS (SELECT {keys}, sym_id, k, x AS s, 1 AS n, 0 AS cluster FROM {name}_o WHERE k=1
  UNION ALL SELECT {out}, b.sym_id, b.k, CASE WHEN {near} THEN a.s+b.x ELSE b.x END, CASE WHEN {near} THEN a.n+1 ELSE 1 END, CASE WHEN {near} THEN a.cluster ELSE a.cluster+1 END FROM {name} a JOIN {name}_o b ON {on} AND b.k=a.k+1)"""


def clefs_sql(staves_: str, symbols_: str) -> str:
    """CTEs: the clef of each staff, from the left seventh of the page."""
    rows = f"(SELECT sy.image_id, sym_id AS clef_id, CASE class_id WHEN 9 THEN 'treble' ELSE 'bass' END AS kind, staff_idx, abs(y-top-2*spacing) AS d FROM {symbols_} sy JOIN {staves_} st USING (image_id) WHERE class_id IN (9, 30) AND x<=192 AND y>=top-100 AND y<=top+180)"
    won = fold_sql(rows, "image_id", "d, clef_id, staff_idx", ["clef_id", "staff_idx", "kind"], "k.clef_id=x[1].clef_id OR k.staff_idx=x[1].staff_idx")
    return f"won AS (SELECT image_id, v.staff_idx AS staff_idx, v.kind AS clef FROM ({won})), clefs AS (SELECT st.image_id, st.staff_idx, coalesce(clef, 'treble') AS clef FROM {staves_} st LEFT JOIN won USING (image_id, staff_idx))"


def symbols(spark, sf_dir, rows=None):
    return (boxes(spark, sf_dir) if rows is None else rows).select("image_id", F.col("line_no").alias("sym_id"), "class_id", (F.col("cx") * 1280).alias("x"), (F.col("cy") * 1280).alias("y"))


def staves(sy, n: int = 4):
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return sy.select("image_id").distinct().withColumn("staff_idx", k).select("image_id", "staff_idx", (100.0 + 300 * F.col("staff_idx")).alias("top"), F.lit(20.0).alias("spacing"), F.lit(0.0).alias("x_min"), F.lit(1280.0).alias("x_max"))


@query("a1_merge_peaks", f"{S}, p AS (SELECT DISTINCT image_id, CAST(round(y) AS INT) AS y FROM sy), l AS (SELECT *, sum(CASE WHEN g>3 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY y) AS line FROM (SELECT *, y-lag(y) OVER (PARTITION BY image_id ORDER BY y) AS g FROM p)) SELECT image_id, max(y) AS y FROM l GROUP BY image_id, line")
def a1_merge_peaks(spark, sf_dir):
    return M.merge_peaks(symbols(spark, sf_dir).select("image_id", F.round("y").cast("int").alias("y")).distinct())


_A2 = """, g AS (SELECT *, y-lag(y) OVER w AS gap FROM p WINDOW w AS (PARTITION BY image_id ORDER BY y)), r AS (SELECT g.*, sum(CASE WHEN gap>lim THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY y) AS run FROM g JOIN (SELECT image_id, median(gap)*2.5 AS lim FROM g GROUP BY 1) USING (image_id)),
 f AS (SELECT image_id, run, five, list(y ORDER BY y) AS ys FROM (SELECT *, (row_number() OVER (PARTITION BY image_id, run ORDER BY y)-1)//5 AS five FROM r) GROUP BY 1,2,3 HAVING count(*)=5),
 sv AS (SELECT image_id, ys, CAST(row_number() OVER (PARTITION BY image_id ORDER BY run, five)-1 AS INT) AS staff_idx, (ys[5]-ys[1])/4 AS spacing, CAST(ys[1] AS DOUBLE) AS top, CAST(ys[5] AS DOUBLE) AS bottom FROM f)"""


@query("a2_staves", f"{S}, p AS (SELECT DISTINCT image_id, CAST(round(y) AS INT) AS y FROM sy){_A2} SELECT image_id, staff_idx, spacing, top, bottom FROM sv")
def a2_staves(spark, sf_dir):
    return M.group_staves(symbols(spark, sf_dir).select("image_id", F.round("y").cast("int").alias("y")).distinct()).drop("line_ys")


@query("a2b_staves_fixed", f"""{S}, p AS (SELECT DISTINCT image_id, CAST(round(y) AS INT) AS y FROM sy WHERE image_id%3<>0 OR sym_id%9=0 AND image_id%2=0), r AS (SELECT *, sum(CASE WHEN gap>60 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY y) AS run
  FROM (SELECT *, y-lag(y) OVER (PARTITION BY image_id ORDER BY y) AS gap FROM p)),
 k AS (SELECT image_id, run, min(y) AS top, max(y) AS bottom, count(*) AS lines FROM r GROUP BY 1,2 HAVING count(*)>=5)
 SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY run)-1 AS INT) AS staff_idx, CAST(top AS DOUBLE) AS top, CAST(bottom AS DOUBLE) AS bottom, lines FROM k
 UNION ALL SELECT DISTINCT image_id, 0, 0.0, 1000.0, 0 FROM sy WHERE image_id NOT IN (SELECT image_id FROM p)""")
def a2b_staves_fixed(spark, sf_dir):
    """Two images in three have many lines, some a few, the rest none."""
    sy = symbols(spark, sf_dir)
    lines = sy.where("image_id % 3 <> 0 OR sym_id % 9 = 0 AND image_id % 2 = 0").select("image_id", F.round("y").cast("int").alias("y")).distinct()
    return M.staff_regions(lines, sy)


@query("a3_staff_bounds", f"""{S}, p AS (SELECT image_id, CAST(round(y) AS INT) AS y, min(x) AS x1, max(x)+sum(sym_id) AS x2 FROM sy GROUP BY 1,2){_A2}
 SELECT s.image_id, staff_idx, spacing, top, bottom, min(x1) AS x_min, max(x2) AS x_max FROM (SELECT *, unnest(ys) AS y FROM sv) s JOIN p ON p.image_id=s.image_id AND p.y=s.y GROUP BY ALL""")
def a3_staff_bounds(spark, sf_dir):
    """A line reaches from its first symbol to beyond its last one."""
    lines = symbols(spark, sf_dir).groupBy("image_id", F.round("y").cast("int").alias("y")).agg(F.min("x").alias("x1"), (F.max("x") + F.sum("sym_id")).alias("x2"))
    return M.staff_bounds(M.group_staves(lines.select("image_id", "y")), lines).drop("line_ys")


_MEASURES = f"""{S}, n AS (SELECT * FROM sy WHERE class_id IN {HEADS}), e AS (SELECT image_id, min(x)-10 AS lo, max(x)+10 AS hi FROM n GROUP BY 1),
 ed AS (SELECT image_id, lo AS x FROM e UNION SELECT sy.image_id, x FROM sy JOIN e ON sy.image_id=e.image_id AND x>lo AND x<hi WHERE class_id IN {BARS}),
 iv AS (SELECT n.image_id, n.sym_id, (SELECT count(*) FROM ed WHERE ed.image_id=n.image_id AND ed.x<=n.x) AS k FROM n),
 ms AS (SELECT image_id, sym_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY k)+(min(k) OVER (PARTITION BY image_id)>1)::INT AS INT) AS measure FROM iv)"""


@query("a4_measures", f"{_MEASURES} SELECT * FROM ms")
def a4_measures(spark, sf_dir):
    sy = symbols(spark, sf_dir)
    return M.measures(sy.where(F.col("class_id").isin(*HEADS)).select("image_id", "sym_id", "x"), sy.where(F.col("class_id").isin(*BARS)).select("image_id", "x"))


@query("a5_clusters", f"{RS}, h AS (SELECT image_id, sym_id, x FROM sy WHERE class_id IN {HEADS}), {clusters_sql('h', 'image_id')} SELECT image_id, sym_id, cluster FROM cl")
def a5_clusters(spark, sf_dir):
    sy = symbols(spark, sf_dir)
    return M.clusters(sy.where(F.col("class_id").isin(*HEADS)).select("image_id", "sym_id", "x"))


@query("a6_nearest_staff", f"{S}, b AS (SELECT sy.image_id, sym_id, y, staff_idx, top, spacing, row_number() OVER (PARTITION BY sy.image_id, sym_id ORDER BY abs(y-(top+2*spacing)), staff_idx) AS k FROM sy JOIN st USING (image_id) WHERE class_id IN {HEADS}) SELECT image_id, sym_id, staff_idx, CAST(round_even((y-top)/(spacing/2),0) AS INT) AS step FROM b WHERE k=1")
def a6_nearest_staff(spark, sf_dir):
    sy = symbols(spark, sf_dir)
    return M.nearest_staff(sy.where(F.col("class_id").isin(*HEADS)).select("image_id", "sym_id", "y"), staves(sy)).select("image_id", "sym_id", "staff_idx", "step")


@query("a9b_topmost", f"{S}, k AS (SELECT *, floor(x/320) AS measure, CAST(round(y) AS INT)%60+36 AS midi, row_number() OVER (PARTITION BY image_id, floor(x/320) ORDER BY y, sym_id) AS k FROM sy) SELECT image_id, CAST(measure AS BIGINT) AS measure, max(midi) FILTER (WHERE k=1) AS s, max(midi) FILTER (WHERE k=2) AS a, max(midi) FILTER (WHERE k=3) AS t, max(midi) FILTER (WHERE k=4) AS b FROM k WHERE k<=4 GROUP BY 1,2 HAVING count(*)=4")
def a9b_topmost(spark, sf_dir):
    n = symbols(spark, sf_dir).withColumn("measure", F.floor(F.col("x") / 320)).withColumn("beat", F.lit(1.0)).withColumn("midi", F.round("y").cast("int") % 60 + 36)
    return M.bind_topmost(n).select("image_id", "measure", "s", "a", "t", "b")


@query("a10_a11_accidentals", f"""{_MEASURES}, ac AS (SELECT image_id, x AS ax, y AS ay, CASE class_id WHEN 12 THEN 'sharp' ELSE 'double_sharp' END AS accidental FROM sy WHERE class_id IN (12,15)),
 nr AS (SELECT n.image_id, n.sym_id, arg_min(accidental, (n.x-ax)) AS accidental FROM n JOIN ac ON n.image_id=ac.image_id AND n.x-ax>0 AND n.x-ax<40 AND abs(n.y-ay)<15 GROUP BY 1,2),
 ns AS (SELECT n.image_id, n.sym_id, n.x, accidental, measure, staff_idx, step FROM n LEFT JOIN nr USING (image_id, sym_id) JOIN ms USING (image_id, sym_id) JOIN (SELECT image_id, sym_id, staff_idx, CAST(round_even((y-top)/(spacing/2),0) AS INT) AS step FROM (SELECT n.image_id, sym_id, y, staff_idx, top, spacing, row_number() OVER (PARTITION BY n.image_id, sym_id ORDER BY abs(y-(top+2*spacing)), staff_idx) AS k FROM n JOIN st USING (image_id)) WHERE k=1) USING (image_id, sym_id))
 SELECT image_id, sym_id, accidental, last_value(accidental IGNORE NULLS) OVER (PARTITION BY image_id, measure, staff_idx, step ORDER BY x, sym_id ROWS UNBOUNDED PRECEDING) AS resolved FROM ns""")
def a10_accidentals(spark, sf_dir):
    sy = symbols(spark, sf_dir)
    n = sy.where(F.col("class_id").isin(*HEADS)).select("image_id", "sym_id", "x", "y")
    m = M.measures(n.drop("y"), sy.where(F.col("class_id").isin(*BARS)).select("image_id", "x"))
    a = M.accidentals_left(n, sy).join(M.nearest_staff(n.drop("x"), staves(sy)).drop("y"), ["image_id", "sym_id"]).join(m, ["image_id", "sym_id"])
    return M.resolve_accidentals(a).select("image_id", "sym_id", "accidental", "resolved")


@query("a12_clefs", f"{S}, {clefs_sql('st', 'sy')} SELECT * FROM clefs")
def a12_clefs(spark, sf_dir):
    sy = symbols(spark, sf_dir)
    k = sy.where(F.col("class_id").isin(*CLEFS)).select("image_id", F.col("sym_id").alias("clef_id"), pitch.lookup(CLEFS, F.col("class_id")).alias("kind"), "x", "y")
    return M.assign_clefs(k, staves(sy))


def _chords(spark, sf_dir, lines: int):
    sy = symbols(spark, sf_dir, by_image(spark, sf_dir)[0])
    # clusters are per page: a quarter of the page is one column of notes here
    wide = sy.withColumn("x", F.when(F.col("class_id").isin(*HEADS), F.floor(F.col("x") / 160) * 160 + F.col("sym_id") % 7).otherwise(F.col("x")))
    return sy, M.assemble(wide, staves(sy, lines), HEADS, (24,), CLEFS)


def assembly_sql(lines: int) -> str:
    """CTEs up to ch: the whole assembly on pages of two or four staves."""
    side = "CASE WHEN y<290 THEN 0 ELSE 1 END" if lines == 2 else "staff_idx"  # 290: the middle between the two staves
    voice = "CASE WHEN k<=2 THEN side*2+k-1 END" if lines == 2 else "CASE WHEN k=1 THEN side END"
    return f"""{RS}, s2 AS (SELECT image_id, k AS staff_idx, CAST(100+300*k AS DOUBLE) AS top, CAST(20 AS DOUBLE) AS spacing FROM (SELECT DISTINCT image_id FROM sy), (SELECT unnest(range(0, {lines})) AS k)),
 wide AS (SELECT image_id, sym_id, class_id, CASE WHEN class_id IN {HEADS} THEN floor(x/160)*160+sym_id%7 ELSE x END AS x, y FROM sy), nh AS (SELECT * FROM wide WHERE class_id IN {HEADS}), {clefs_sql('s2', 'wide')},
 en AS (SELECT image_id, min(x)-10 AS lo, max(x)+10 AS hi FROM nh GROUP BY 1), ed AS (SELECT image_id, lo AS x FROM en UNION SELECT w.image_id, x FROM wide w JOIN en ON w.image_id=en.image_id AND x>lo AND x<hi WHERE class_id=24),
 iv AS (SELECT n.image_id, n.sym_id, (SELECT count(*) FROM ed WHERE ed.image_id=n.image_id AND ed.x<=n.x) AS k FROM nh n), ms AS (SELECT image_id, sym_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY k)+(min(k) OVER (PARTITION BY image_id)>1)::INT AS INT) AS measure FROM iv),
 ns AS (SELECT image_id, sym_id, staff_idx, CAST(round_even((y-top)/(spacing/2),0) AS INT) AS step FROM nh n JOIN s2 USING (image_id) QUALIFY row_number() OVER (PARTITION BY image_id, sym_id ORDER BY abs(y-(top+2*spacing)), staff_idx)=1),
 ac AS (SELECT n.image_id, n.sym_id, CASE a.class_id WHEN 12 THEN 1 ELSE 2 END AS shift FROM nh n JOIN wide a ON a.image_id=n.image_id AND a.class_id IN (12,15) AND n.x-a.x>0 AND n.x-a.x<40 AND abs(n.y-a.y)<15 QUALIFY row_number() OVER (PARTITION BY n.image_id, n.sym_id ORDER BY n.x-a.x, a.y, CASE a.class_id WHEN 12 THEN 'sharp' ELSE 'double_sharp' END)=1),
 al AS (SELECT n.image_id, n.sym_id, n.x, n.y, measure, staff_idx, step, last_value(shift IGNORE NULLS) OVER (PARTITION BY n.image_id, measure, staff_idx, step ORDER BY n.x, n.sym_id ROWS UNBOUNDED PRECEDING) AS shift FROM nh n LEFT JOIN ac USING (image_id, sym_id) JOIN ns USING (image_id, sym_id) JOIN ms USING (image_id, sym_id)),
 pl AS (SELECT al.*, CASE clef WHEN 'bass' THEN 26 ELSE 38 END-step AS place FROM al JOIN clefs USING (image_id, staff_idx)),
 mi AS (SELECT *, CAST(greatest(21, least(108, floor(place/7)*12+12+[0,2,4,5,7,9,11][1+(place%7+7)%7]+coalesce(shift,0))) AS INT) AS midi FROM pl), {clusters_sql('al', 'image_id, measure')},
 vo AS (SELECT image_id, cluster, midi, side, row_number() OVER (PARTITION BY image_id, cluster, side ORDER BY y, sym_id) AS k FROM (SELECT mi.image_id, cl.measure*100000+cl.cluster AS cluster, midi, y, mi.sym_id, {side} AS side FROM mi JOIN cl ON cl.image_id=mi.image_id AND cl.sym_id=mi.sym_id)),
 fo AS (SELECT image_id, cluster, {', '.join(f"max(midi) FILTER (WHERE {voice}={k}) AS {v}" for k, v in enumerate('satb'))} FROM vo GROUP BY 1,2),
 ch AS (SELECT image_id AS score_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY cluster)-1 AS INT) AS chord_index, CAST(cluster//100000 AS INT) AS measure, CAST(cluster%100000 AS DOUBLE) AS beat, s, a, t, b, CAST(NULL AS INT) AS tonic_midi, CAST(NULL AS VARCHAR) AS mode FROM fo WHERE s IS NOT NULL AND a IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL)"""


@query("a13_assembly", f"{assembly_sql(2)} SELECT * FROM ch")
def a13_assembly(spark, sf_dir):
    return _chords(spark, sf_dir, 2)[1]


@query("a13_assembly_four", f"{assembly_sql(4)} SELECT * FROM ch")
def a13_assembly_four(spark, sf_dir):
    return _chords(spark, sf_dir, 4)[1]


@query("a14_counters", f"""{assembly_sql(2)}, {violations_sql('ch')}
 SELECT image_id, count(*) AS symbols, count(*) FILTER (WHERE class_id IN {HEADS}) AS noteheads, coalesce(any_value(chords), 0) AS chords, coalesce(any_value(violations), 0) AS violations FROM sy
 LEFT JOIN (SELECT score_id AS image_id, count(*) AS chords FROM ch GROUP BY 1) USING (image_id) LEFT JOIN (SELECT score_id AS image_id, count(*) AS violations FROM vio GROUP BY 1) USING (image_id) GROUP BY 1""")
def a14_counters(spark, sf_dir):
    sy, chords = _chords(spark, sf_dir, 2)
    chords = written(chords, "chords")  # they are few, and read twice
    return M.counters(sy, chords, harmony.violations(chords), HEADS)


@query("a15_dynamics", f"""{S}, l AS (SELECT image_id, sym_id, CASE class_id WHEN 0 THEN 'p' WHEN 3 THEN 'f' WHEN 9 THEN 'z' ELSE CASE WHEN sym_id%2=0 THEN 'm' ELSE 's' END END AS letter, x AS x1, floor(y/40)*40 AS y1, x+10 AS x2, floor(y/40)*40+10+sym_id%3*4 AS y2 FROM sy WHERE class_id IN (0,3,6,9)),
 o AS (SELECT *, (x1+x2)/2-lag((x1+x2)/2) OVER w AS dx, abs((y1+y2)/2-lag((y1+y2)/2) OVER w) AS dy, row_number() OVER w AS k FROM l WINDOW w AS (PARTITION BY image_id ORDER BY (y1+y2)/2, (x1+x2)/2, sym_id)),
 g AS (SELECT *, sum(CASE WHEN dy<=20 AND dx>=0 AND dx<=100 THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY k) AS word FROM o),
 v AS (SELECT image_id, string_agg(letter, '' ORDER BY k) AS d, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM g GROUP BY image_id, word),
 r AS (SELECT image_id, CASE WHEN d NOT IN {M.DYNAMICS} AND starts_with(d,'sf') AND contains(d,'z') THEN 'sfz' WHEN d NOT IN {M.DYNAMICS} AND starts_with(d,'sf') AND contains(d,'p') THEN 'sfp' ELSE d END AS dynamic, x1, y1, x2, y2 FROM v)
 SELECT * FROM r WHERE dynamic IN {M.DYNAMICS}""")
def a15_dynamics(spark, sf_dir):
    sy = symbols(spark, sf_dir).where(F.col("class_id").isin(0, 3, 6, 9))
    letter = F.when(F.col("class_id") == 0, "p").when(F.col("class_id") == 3, "f").when(F.col("class_id") == 9, "z").when(F.col("sym_id") % 2 == 0, "m").otherwise("s")
    y = (F.floor(F.col("y") / 40) * 40).cast("double")
    l = sy.select("image_id", "sym_id", letter.alias("letter"), F.col("x").alias("x1"), y.alias("y1"), (F.col("x") + 10).alias("x2"), (y + 10 + F.col("sym_id") % 3 * 4).alias("y2"))
    return M.dynamics(l, dx=100).select("image_id", "dynamic", "x1", "y1", "x2", "y2")


@query("a17_barlines", f"""{S}, m AS (SELECT image_id, x, y, CAST(50 AS DOUBLE) AS w, CAST(60 AS DOUBLE) AS h FROM sy WHERE class_id IN (21,24)), l AS (SELECT *, lead(y) OVER (PARTITION BY image_id ORDER BY x, y) AS ny FROM m)
 SELECT image_id, x, y, h, 'plain' AS kind FROM l UNION ALL SELECT image_id, x+w, y, h, CASE WHEN ny IS NULL OR abs(ny-y)>h/2 THEN 'final' ELSE 'plain' END FROM l""")
def a17_barlines(spark, sf_dir):
    m = symbols(spark, sf_dir).where(F.col("class_id").isin(21, 24)).select("image_id", "x", "y", F.lit(50.0).alias("w"), F.lit(60.0).alias("h"))
    return M.barlines_of_measures(m)


@query("a17b_edge_barlines", f"SELECT image_id, line_no, unnest(['left', 'right']) AS side, unnest([x1, x2]) AS cx, cy, CAST(0.005 AS DOUBLE) AS w, h FROM ({CORNERS}) t WHERE class_id IN (3, 6)")
def a17b_edge_barlines(spark, sf_dir):
    return M.edge_barlines(boxes(spark, sf_dir), (3, 6))


@query("a4b_measures_by_count", f"""{S}, u AS (SELECT image_id, sym_id, x, CAST(class_id IN {BARS} AS INT) AS bar FROM sy WHERE class_id IN {HEADS} OR class_id IN {BARS}),
 m AS (SELECT *, CAST(1+sum(bar) OVER (PARTITION BY image_id ORDER BY x, bar ROWS UNBOUNDED PRECEDING) AS INT) AS measure FROM u) SELECT image_id, sym_id, measure FROM m WHERE bar=0""")
def a4b_measures_by_count(spark, sf_dir):
    sy = symbols(spark, sf_dir)
    return M.measures_by_count(sy.where(F.col("class_id").isin(*HEADS)).select("image_id", "sym_id", "x"), sy.where(F.col("class_id").isin(*BARS)).select("image_id", "x"))


@query("a20_piece_recall", f"WITH e AS (SELECT image_id AS piece, count(*) FILTER (WHERE class_id=0) AS expected FROM ({CORNERS}) t GROUP BY 1), f AS (SELECT image_id AS piece, count(*) AS found FROM ({DET_CORNERS}) d WHERE class_id=0 GROUP BY 1) SELECT piece, expected, coalesce(found,0) AS found, CASE WHEN expected>0 THEN round(coalesce(found,0)/expected,9) ELSE 0 END AS recall FROM e LEFT JOIN f USING (piece)")
def a20_piece_recall(spark, sf_dir):
    e = boxes(spark, sf_dir).groupBy(F.col("image_id").alias("piece")).agg(F.count_if(F.col("class_id") == 0).alias("expected"))
    d = detections(spark, sf_dir).where("class_id = 0").groupBy(F.col("image_id").alias("piece")).agg(F.count("*").alias("found"))
    return M.piece_recall(e, d).withColumn("recall", F.round("recall", 9))


_A18 = f"{S}, tr AS (SELECT image_id, sym_id AS idx, x, y, 60+sym_id%12 AS midi FROM sy WHERE class_id=0), pr AS (SELECT image_id, sym_id, x+(sym_id%5)*6 AS x, y, 60+(sym_id%12)+CASE WHEN sym_id%4=0 THEN 12 ELSE 0 END AS midi FROM sy WHERE class_id IN (0,3)), mt AS (SELECT tr.image_id, tr.idx, tr.midi, b.midi AS pred_midi FROM tr LEFT JOIN (SELECT tr.image_id, idx, pr.midi, row_number() OVER (PARTITION BY tr.image_id, idx ORDER BY sqrt((tr.x-pr.x)*(tr.x-pr.x)+(tr.y-pr.y)*(tr.y-pr.y)), sym_id) AS k FROM tr JOIN pr ON tr.image_id=pr.image_id AND sqrt((tr.x-pr.x)*(tr.x-pr.x)+(tr.y-pr.y)*(tr.y-pr.y))<=30) b ON b.image_id=tr.image_id AND b.idx=tr.idx AND k=1)"


def _matched(spark, sf_dir):
    sy = symbols(spark, sf_dir)
    truth = sy.where("class_id = 0").select("image_id", F.col("sym_id").alias("idx"), "x", "y", (60 + F.col("sym_id") % 12).alias("midi"))
    octave = F.when(F.col("sym_id") % 4 == 0, 12).otherwise(0)
    pred = sy.where("class_id IN (0, 3)").select("image_id", "sym_id", (F.col("x") + (F.col("sym_id") % 5) * 6).alias("x"), "y", (60 + F.col("sym_id") % 12 + octave).alias("midi"))
    return M.match_pitches(truth, pred)


@query("a18_match_pitches", f"{_A18} SELECT image_id, idx, midi, pred_midi FROM mt")
def a18_match_pitches(spark, sf_dir):
    return _matched(spark, sf_dir).select("image_id", "idx", "midi", "pred_midi")


@query("a19_pitch_accuracy", f"{_A18} SELECT image_id, count(*) AS notes, count(*) FILTER (WHERE midi=pred_midi) AS matched, round(avg(CASE WHEN midi=pred_midi THEN 1 ELSE 0 END),9) AS exact, round(avg(CASE WHEN (midi-pred_midi)%12=0 THEN 1 ELSE 0 END),9) AS lenient FROM mt GROUP BY 1")
def a19_pitch_accuracy(spark, sf_dir):
    return M.pitch_accuracy(_matched(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("exact", "lenient")})


_CLEF_OF = "CASE sym_id%4 WHEN 0 THEN 'treble' WHEN 1 THEN 'bass' WHEN 2 THEN 'alto' ELSE 'tenor' END"


@query("f13_f16_pitch", f"""{S}, x AS (SELECT image_id, sym_id, y, substr('CDEFGAB', 1+sym_id%7, 1)||CASE sym_id%3 WHEN 0 THEN '#' WHEN 1 THEN 'b' ELSE '' END||(sym_id%9) AS name, CAST(round_even((y-100)/10,0) AS INT) AS step, {_CLEF_OF} AS clef, (image_id+sym_id)%6 AS a FROM sy),
 z AS (SELECT *, CASE clef WHEN 'treble' THEN 38 WHEN 'bass' THEN 26 WHEN 'alto' THEN 32 ELSE 30 END-step AS place FROM x)
 SELECT image_id, sym_id, name, (sym_id%9)*12+12+[0,2,4,5,7,9,11][1+sym_id%7]+CASE sym_id%3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS midi, step,
  greatest(21, least(108, CAST(floor(place/7) AS INT)*12+12+[0,2,4,5,7,9,11][1+(place%7+7)%7]+[0,1,-1,2,-2,0][1+a])) AS staff_midi, greatest(36, least(84, 60+CAST(trunc((500-y)/10) AS INT))) AS coarse FROM z""")
def f13_pitch(spark, sf_dir):
    """Every clef with every accidental, and one that no table has."""
    sy = symbols(spark, sf_dir)
    name = F.concat(F.substring(F.lit("CDEFGAB"), 1 + F.col("sym_id") % 7, F.lit(1)), F.when(F.col("sym_id") % 3 == 0, "#").when(F.col("sym_id") % 3 == 1, "b").otherwise(""), (F.col("sym_id") % 9).cast("string"))
    s = pitch.staff_step(F.col("y"), F.lit(100.0), F.lit(20.0))
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    clef = pick(("treble", "bass", "alto", "tenor"), F.col("sym_id") % 4)
    accidental = pick(("natural", "sharp", "flat", "double_sharp", "double_flat", "quarter_tone"), (F.col("image_id") + F.col("sym_id")) % 6)
    return sy.select("image_id", "sym_id", name.alias("name"), pitch.midi_of_name(name).alias("midi"), s.alias("step"), pitch.staff_pitch(s, clef, accidental).alias("staff_midi"), pitch.coarse_pitch(F.col("y")).alias("coarse"))
