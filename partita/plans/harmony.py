"""Harmony queries over the chord view."""

from __future__ import annotations

from pyspark.sql import functions as F

from partita.functions import pitch
from partita.operators import harmony
from partita.plans.registry import query
from partita.plans.views import CHORDS, chords

_LAGGED = f"""WITH c AS ({CHORDS}), n AS (
 SELECT *, lag(s) OVER w AS ps, lag(a) OVER w AS pa, lag(t) OVER w AS pt, lag(b) OVER w AS pb, lag(chord_index) OVER w AS pi, lag(measure) OVER w AS pm, lag(beat) OVER w AS pbeat
 FROM c WINDOW w AS (PARTITION BY score_id ORDER BY chord_index)
)"""

_VOICE = {"S": "s", "A": "a", "T": "t", "B": "b"}


def _m1() -> str:
    out = []
    for v, c in _VOICE.items():
        d, detail = f"abs({c}-p{c})", f"'from '||p{c}||' to '||{c}||', diff='||abs({c}-p{c})||' semitones.'"
        out.append(f"SELECT score_id, chord_index, 'M1' AS rule_id, CASE WHEN {d}>12 THEN 'leap_octave' WHEN {d}>=10 THEN 'leap_seventh' ELSE 'leap_tritone' END AS kind, CASE WHEN {d} IN (10,11) THEN 'warning' ELSE 'error' END AS severity, '{v}' AS voices, {detail} AS detail, pi AS from_index FROM n WHERE {d}>12 OR {d} IN (6,10,11)")
        if v in "AT":
            out.append(f"SELECT score_id, chord_index, 'M1', 'leap_inner', 'error', '{v}', {detail}, pi FROM n WHERE {d}>5")
    return " UNION ALL ".join(out)


def _v1() -> str:
    out = []
    for hi, lo in ("SA", "AT", "TB"):
        h, low = _VOICE[hi], _VOICE[lo]
        out.append(f"SELECT score_id, chord_index, 'V1' AS rule_id, 'crossing_{hi}{lo}' AS kind, 'error' AS severity, '{hi}{lo}' AS voices, '{hi}='||{h}||', {lo}='||{low} AS detail, CAST(NULL AS INT) AS from_index FROM n WHERE {h}<{low}")
        out.append(f"SELECT score_id, chord_index, 'V1', 'overlap', 'warning', '{lo}/{hi}', 'prev {hi}='||p{h}||', {lo}='||p{low}||'; next {hi}='||{h}||', {lo}='||{low}, pi FROM n WHERE {low}>p{h}")
    return " UNION ALL ".join(out)


def _p1() -> str:
    out = []
    for x, y in ("SA", "ST", "SB", "AT", "AB", "TB"):
        u, v = _VOICE[x], _VOICE[y]
        out.append(f"SELECT score_id, chord_index, 'P1' AS rule_id, 'parallel' AS kind, 'error' AS severity, '{x}-{y}' AS voices, 'chord '||pi||'->'||chord_index||', interval1='||(p{u}-p{v})||', interval2='||({u}-{v}) AS detail, pi AS from_index FROM n WHERE {u}<>p{u} AND {v}<>p{v} AND ({u}>p{u})=({v}>p{v}) AND abs(p{u}-p{v})%12 IN (0,7) AND abs({u}-{v})%12 IN (0,7)")
    return " UNION ALL ".join(out)


_P2 = """SELECT score_id, chord_index, 'P2' AS rule_id, CASE WHEN e THEN 'hidden_excused' ELSE 'hidden' END AS kind, CASE WHEN e THEN 'warning' ELSE 'error' END AS severity, 'S-B' AS voices,
 'chord '||pi||'->'||chord_index||', interval1='||(ps-pb)||', interval2='||(s-b)||', dir_s='||sign(s-ps)||', dir_b='||sign(b-pb) AS detail, pi AS from_index
 FROM (SELECT *, abs(s-ps) IN (1,2) AND abs(b-pb)>2 AS e FROM n) WHERE s<>ps AND b<>pb AND (s>ps)=(b>pb) AND abs(ps-pb)%12 NOT IN (0,7) AND abs(s-b)%12 IN (0,7)"""

#: A chord's triad: the least root r for which the other classes are a third and a fifth over it, three classes in all.
_TRIAD = """, pcs AS (
 SELECT *, list_sort(list_distinct([s%12, a%12, t%12, b%12])) AS pc FROM n
), tri AS (
 SELECT *, CASE WHEN len(pc)=3 THEN list_filter(pc, lambda r: list_sort(list_transform(list_filter(pc, lambda x: x<>r), lambda x: (x-r+12)%12)) IN ([3,7],[4,7],[3,6],[4,8]))[1] END AS root FROM pcs
)"""

_D1 = """SELECT score_id, chord_index, 'D1' AS rule_id, 'leading_doubled' AS kind, 'error' AS severity, '' AS voices, 'leading_pc='||lead_pc||', root_count='||roots||', chord_index='||chord_index AS detail, CAST(NULL AS INT) AS from_index
 FROM (SELECT *, (tonic_midi%12+11)%12 AS lead_pc, (s%12=root)::INT+(a%12=root)::INT+(t%12=root)::INT+(b%12=root)::INT AS roots FROM tri) WHERE root=lead_pc AND roots>1"""


def _l1() -> str:
    return " UNION ALL ".join(
        f"SELECT score_id, chord_index, 'L1' AS rule_id, 'leading_unresolved' AS kind, 'error' AS severity, '{v}' AS voices, 'leading tone MIDI='||p{c}||', next MIDI='||{c}||', expected tonic_pc='||tonic_midi%12 AS detail, pi AS from_index FROM n WHERE p{c}%12=(tonic_midi%12+11)%12 AND NOT ({c}%12=tonic_midi%12 AND {c}>p{c})"
        for v, c in _VOICE.items() if v in "SB"
    )


_RULES = {"M1": _m1(), "V1": _v1(), "P1": _p1(), "P2": _P2, "D1": _D1, "L1": _l1()}
_ALL = " UNION ALL ".join(f"({sql})" for sql in _RULES.values())
_COLUMNS = ["score_id", "chord_index", "rule_id", "kind", "severity", "voices", "detail", "from_index"]


def violations_sql(chords_table: str) -> str:
    """CTEs up to vio: every rule over a table of chords."""
    return f"{_LAGGED[5:].replace(CHORDS, f'SELECT * FROM {chords_table}')}{_TRIAD}, vio AS ({_ALL})"


@query("harmony_all", f"{_LAGGED}{_TRIAD} SELECT * FROM ({_ALL})")
def harmony_all(spark, sf_dir):
    return harmony.violations(chords(spark, sf_dir)).select(*_COLUMNS)


for _rule, _name in {"M1": "h1_h2_leaps", "V1": "h3_h4_crossing_overlap", "P1": "h5_parallels", "P2": "h6_hidden", "D1": "h7_doubling", "L1": "h8_leading_tone"}.items():
    query(_name, f"{_LAGGED}{_TRIAD} {_RULES[_rule]}")(lambda spark, sf_dir, r=_rule: harmony.violations(chords(spark, sf_dir), (r,)).select(*_COLUMNS))

_H9 = f"""{_LAGGED}{_TRIAD}, last AS (
 SELECT *, lag(root) OVER w AS proot, row_number() OVER (PARTITION BY score_id ORDER BY chord_index DESC) AS k FROM tri WINDOW w AS (PARTITION BY score_id ORDER BY chord_index)
), deg AS (
 SELECT *, list_position([0,2,CASE WHEN mode='major' THEN 4 ELSE 3 END,5,7,CASE WHEN mode='major' THEN 9 ELSE 8 END,11], (root-tonic_midi%12+12)%12) AS d1,
  list_position([0,2,CASE WHEN mode='major' THEN 4 ELSE 3 END,5,7,CASE WHEN mode='major' THEN 9 ELSE 8 END,11], (proot-tonic_midi%12+12)%12) AS d0 FROM last WHERE k=1
)
SELECT score_id, CASE WHEN d0=5 AND d1=1 THEN CASE WHEN b%12=root AND pb%12=proot AND s%12=tonic_midi%12 THEN 'PAC' ELSE 'IAC' END
 WHEN d0=4 AND d1=1 THEN 'PC' WHEN d0=5 AND d1=6 THEN 'DC' WHEN d0 IS NOT NULL AND d0>0 AND d1=5 THEN 'HC' END AS cadence FROM deg"""


@query("h9_cadence", _H9)
def h9_cadence(spark, sf_dir):
    return harmony.cadences(chords(spark, sf_dir))


@query("h12_summary", f"""{_LAGGED}{_TRIAD}, v AS ({_ALL}), per AS (
 SELECT score_id, count(*) AS violations, {', '.join(f"count(*) FILTER (WHERE rule_id='{r}') AS {r.lower()}" for r in _RULES)} FROM v GROUP BY 1)
 SELECT x.score_id, x.chords, {', '.join(f'coalesce({c},0) AS {c}' for c in ['violations', *map(str.lower, _RULES)])}, coalesce(violations,0)/x.chords AS per_chord
 FROM (SELECT score_id, count(*) AS chords FROM c GROUP BY 1) x LEFT JOIN per USING (score_id)""")
def h12_summary(spark, sf_dir):
    c = chords(spark, sf_dir)
    return harmony.summary(c, harmony.violations(c))


@query("h13_expected_match", f"""{_LAGGED}{_TRIAD}, v AS ({_ALL}), a AS (SELECT score_id, rule_id, severity, count(*) AS actual FROM v GROUP BY ALL),
 e AS (SELECT score_id, rule_id, severity, count(*) AS expected FROM v WHERE chord_index%7<>3 GROUP BY ALL)
 SELECT score_id, rule_id, severity, coalesce(expected,0) AS expected, coalesce(actual,0) AS actual, greatest(0, coalesce(expected,0)-coalesce(actual,0)) AS missing, greatest(0, coalesce(actual,0)-coalesce(expected,0)) AS extra
 FROM e FULL JOIN a USING (score_id, rule_id, severity)""")
def h13_expected_match(spark, sf_dir):
    found = harmony.violations(chords(spark, sf_dir))
    return harmony.match_expected(found.where("chord_index % 7 <> 3"), found, ["score_id", "rule_id", "severity"])


@query("h13_cases_match", f"""{_LAGGED}{_TRIAD}, v AS ({_ALL}), a AS (SELECT score_id, count(*) AS actual FROM v GROUP BY 1), e AS (SELECT score_id, count(*) AS expected FROM v WHERE (chord_index+score_id)%9<>3 GROUP BY 1)
 SELECT score_id, CAST(actual AS INT) AS actual, CAST(coalesce(expected,0) AS INT) AS expected, actual=coalesce(expected,0) AS matches FROM a LEFT JOIN e USING (score_id)""")
def h13_cases_match(spark, sf_dir):
    """What the rules find, held against itself less some chords: scores match where nothing was left out."""
    message = F.coalesce("detail", F.lit(""))
    found = harmony.violations(chords(spark, sf_dir))
    some = found.where((F.col("chord_index") + F.col("score_id")) % 9 != 3)
    expected = some.select("score_id", F.col("chord_index").alias("pos"), "rule_id", "severity", message.alias("contains"))
    return harmony.cases_match(found.select("score_id", "chord_index", "rule_id", "severity", message.alias("message")), expected)


#: Usual ranges of the four voices.
RANGES = [("S", 60, 81), ("A", 53, 74), ("T", 47, 69), ("B", 40, 64)]


@query("h14_h15_ranges", f"""WITH c AS ({CHORDS}) {' UNION ALL '.join(f"SELECT score_id, chord_index, 'range' AS kind, '{v}' AS voices FROM c WHERE {v.lower()} NOT BETWEEN {lo} AND {hi}" for v, lo, hi in RANGES)}
 UNION ALL SELECT score_id, chord_index, 'spacing', 'S-A' FROM c WHERE abs(s-a)>12 UNION ALL SELECT score_id, chord_index, 'spacing', 'A-T' FROM c WHERE abs(a-t)>12""")
def h14_h15_ranges(spark, sf_dir):
    return harmony.ranges(chords(spark, sf_dir), spark.createDataFrame(RANGES, "voice string, low int, high int"))


@query("h11_missing_voices", f"""{_LAGGED.replace(CHORDS, f"SELECT score_id, chord_index, CASE WHEN chord_index%3<>1 THEN s END AS s, CASE WHEN chord_index%4<>2 THEN a END AS a, t, CASE WHEN chord_index%5<>0 THEN b END AS b, tonic_midi, mode, measure, beat FROM ({CHORDS}) x")}{_TRIAD.replace('len(pc)=3', 's IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND len(pc)=3')} SELECT * FROM ({_ALL}) WHERE detail IS NOT NULL""")
def h11_missing_voices(spark, sf_dir):
    """A rule needs all the notes it speaks of; in the SQL, a missing one makes the detail NULL."""
    c = chords(spark, sf_dir)
    some = c.withColumns({v: F.when(F.col("chord_index") % k != r, F.col(v)) for v, k, r in (("s", 3, 1), ("a", 4, 2), ("b", 5, 0))})
    return harmony.violations(some).select(*_COLUMNS)


@query("f9_f17_pitch", f"""{_LAGGED}{_TRIAD} SELECT score_id, chord_index, s-ps AS interval_s, CAST(sign(s-ps) AS INT) AS direction_s, b%12 AS pc_b, root AS root_pc,
 CASE list_sort(list_transform(list_filter(pc, lambda x: x<>root), lambda x: (x-root+12)%12)) WHEN [3,7] THEN 'minor' WHEN [4,7] THEN 'major' WHEN [3,6] THEN 'diminished' WHEN [4,8] THEN 'augmented' END AS quality,
 CASE WHEN root IS NOT NULL THEN CASE (b%12-root+12)%12 WHEN 0 THEN 'root' WHEN 3 THEN 'third' WHEN 4 THEN 'third' ELSE 'fifth' END END AS role_b,
 nullif(list_position([0,2,CASE WHEN mode='major' THEN 4 ELSE 3 END,5,7,CASE WHEN mode='major' THEN 9 ELSE 8 END,11], (b%12-tonic_midi%12+12)%12), 0) AS degree_b FROM tri""")
def f9_f17_pitch(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("score_id").orderBy("chord_index")
    c = chords(spark, sf_dir).withColumn("d", F.col("s") - F.lag("s").over(w)).withColumn("x", pitch.triad(*[F.col(v) for v in "satb"]))
    return c.select("score_id", "chord_index", F.col("d").alias("interval_s"), F.signum("d").cast("int").alias("direction_s"), pitch.pitch_class(F.col("b")).alias("pc_b"), F.col("x.root_pc").alias("root_pc"), F.col("x.quality").alias("quality"), F.element_at("x.roles", F.lit("B")).alias("role_b"), pitch.scale_degree(pitch.pitch_class(F.col("b")), F.col("tonic_midi"), F.col("mode")).alias("degree_b"))
