"""Voice-leading rules over chords (score_id, chord_index, measure, beat, s, a, t, b, tonic_midi, mode).

Violations come out of one pass: a window per score brings the chord before, an array tells which rules apply, and a
single explode hands those out. A rule that meets a NULL voice gives no row.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.pitch import perfect, pitch_class, scale_degree, step, triad
from partita.operators.ranges import LONG, previous

#: The messages of the rules, by kind.
MESSAGES = {
    "leap_octave": "%s 聲部旋律跳進超過八度，違反聲部進行原則。",
    "leap_seventh": "%s 聲部出現七度跳進，需確認後續是否有適當解決。",
    "leap_tritone": "%s 聲部出現增四度／減五度的跳進，一般視為不佳旋律。",
    "leap_inner": "%s 聲部跳進超過完全四度，違反內聲部平穩進行原則。",
    "crossing_SA": "Soprano 低於 Alto，發生聲部交錯（Crossing）。",
    "crossing_AT": "Alto 低於 Tenor，發生聲部交錯（Crossing）。",
    "crossing_TB": "Tenor 低於 Bass，發生聲部交錯（Crossing）。",
    "overlap": "%s 聲部之間發生超越（Overlap）。",
    "parallel": "%s 聲部之間出現平行八度或平行五度。",
    "hidden_excused": "外聲部出現隱伏八/五度，但屬於 S 級進、B 跳進的例外情形。",
    "hidden": "外聲部出現隱伏八度或隱伏五度，需避免。",
    "leading_doubled": "導音根音被重複，違反七級和弦常見配置原則。",
    "root_or_third_missing": "三和弦省略了根音或三音，違反基本配置原則。",
    "fifth_missing": "省略五音時，四部和聲應為三根一三，根音數量不足。",
    "leading_unresolved": "%s 聲部的導音未向上解決到主音。",
}

ROW = "rule_id string, kind string, severity string, voices string, message string, detail string, from_measure int, from_beat double, from_index int"
VOICES = "satb"
ORDER = {"M1": 1, "V1": 2, "P1": 3, "P2": 4, "D1": 5, "L1": 6}


class Candidate(NamedTuple):
    """What a rule may say of a chord: when it says it, and what. back: whether it names the chord before."""

    when: Column
    rule: str
    kind: Column | str
    severity: Column | str
    voices: str
    detail: Column
    back: bool


def _row(when: Column, rule: str, kind: Column | str, severity: Column | str, voices: str, detail: Column, back: bool = True) -> Candidate:
    return Candidate(when, rule, kind, severity, voices, detail, back)


def applied(chords: DataFrame, rules: list[Candidate], keep: list[str]) -> DataFrame:
    """The candidates that apply to chords (with the voices before as p_s to p_b): keep, and the fields of ROW, in the order of the rules.

    First only which apply, and their kind, which is short; texts are made for those, after the chords are taken apart.
    """
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    hits = [F.when(c.when, F.struct(F.lit(k).alias("k"), lit(c.kind).alias("kind"), lit(c.severity).alias("severity"))) for k, c in enumerate(rules)]
    rows = chords.select("*", F.explode(F.array_compact(F.array(*hits))).alias("__hit"))
    k, kind = F.col("__hit.k"), F.col("__hit.kind")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)
    detail = F.lit(None).cast("string")
    for at, c in reversed(list(enumerate(rules))):
        detail = F.when(k == at, c.detail).otherwise(detail)
    voices = of([c.voices for c in rules])
    texts = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    back = of([c.back for c in rules])
    before = [F.when(back, F.col(c)) for c in ("p_measure", "p_beat", "p_index")]
    fields = [of([c.rule for c in rules]), kind, F.col("__hit.severity"), voices, F.replace(texts[kind], F.lit("%s"), voices), detail, *before]
    return rows.select(*keep, *[f.alias(c.split()[0]) for f, c in zip(fields, ROW.split(", "))])


def candidates(extended: bool = False) -> dict[str, list[Candidate]]:
    """What a chord may give, by rule, from its voices s, a, t, b and those before, p_s to p_b."""
    now, before = {v: F.col(v) for v in VOICES}, {v: F.col("p_" + v) for v in VOICES}
    out: dict[str, list[Candidate]] = {r: [] for r in ORDER}
    for v in VOICES:
        d = F.abs(now[v] - before[v])
        detail = F.format_string("from %d to %d, diff=%d semitones.", before[v], now[v], d)
        kind = F.when(d > 12, "leap_octave").when(d.isin(10, 11), "leap_seventh").when(d == 6, "leap_tritone")
        out["M1"].append(_row(kind.isNotNull(), "M1", kind, F.when(d.isin(10, 11), "warning").otherwise("error"), v.upper(), detail))
        if v in "at":
            out["M1"].append(_row(d > 5, "M1", "leap_inner", "error", v.upper(), detail))
    for hi, lo in ("sa", "at", "tb"):
        names = (hi + lo).upper()
        out["V1"].append(_row(now[hi] < now[lo], "V1", "crossing_" + names, "error", names, F.format_string(f"{hi.upper()}=%d, {lo.upper()}=%d", now[hi], now[lo]), back=False))
    for hi, lo in ("sa", "at", "tb"):
        H, L = hi.upper(), lo.upper()
        detail = F.format_string(f"prev {H}=%d, {L}=%d; next {H}=%d, {L}=%d", before[hi], before[lo], now[hi], now[lo])
        out["V1"].append(_row((now[lo] > before[hi]) & now[hi].isNotNull() & before[lo].isNotNull(), "V1", "overlap", "warning", f"{L}/{H}", detail))
    for x, y in combinations(VOICES, 2):
        one, two = before[x] - before[y], now[x] - now[y]
        dx, dy = F.signum(now[x] - before[x]), F.signum(now[y] - before[y])
        same = (dx != 0) & (dx == dy)
        links = [F.col("p_index"), F.col("chord_index"), one, two]
        out["P1"].append(_row(same & perfect(one) & perfect(two), "P1", "parallel", "error", f"{x}-{y}".upper(), F.format_string("chord %d->%d, interval1=%d, interval2=%d", *links)))
        if x + y == "sb":
            excused = step(now["s"] - before["s"]) & (F.abs(now["b"] - before["b"]) > 2)
            kind = F.when(excused, "hidden_excused").otherwise("hidden")
            detail = F.format_string("chord %d->%d, interval1=%d, interval2=%d, dir_s=%d, dir_b=%d", *links, dx.cast("int"), dy.cast("int"))
            out["P2"].append(_row(same & ~perfect(one) & perfect(two), "P2", kind, F.when(excused, "warning").otherwise("error"), "S-B", detail))
    t = F.col("triad")
    tonic = pitch_class(F.col("tonic_midi"))
    leading = F.pmod(tonic - 1, F.lit(12))
    roots = sum(F.when(pitch_class(now[v]) == t["root_pc"], 1).otherwise(0) for v in VOICES)
    out["D1"].append(_row((t["root_pc"] == leading) & (roots > 1), "D1", "leading_doubled", "error", "", F.format_string("leading_pc=%d, root_count=%d, chord_index=%d", leading, roots, F.col("chord_index")), back=False))
    if extended:
        pcs = F.array_distinct(F.array(*[pitch_class(now[v]) for v in VOICES]))
        root = F.col("bare_root")
        has = lambda *ds: F.exists(pcs, lambda p: F.pmod(p - root, F.lit(12)).isin(*ds))
        n = sum(F.when(pitch_class(now[v]) == root, 1).otherwise(0) for v in VOICES)
        out["D1"].append(_row(t.isNull() & ~has(3, 4), "D1", "root_or_third_missing", "error", "", F.format_string("root_pc=%d, chord_index=%d", root, F.col("chord_index")), back=False))
        out["D1"].append(_row(t.isNull() & ~has(6, 7, 8) & (F.size(pcs) <= 3) & (n < 3), "D1", "fifth_missing", "warning", "", F.format_string("root_pc=%d, root_count=%d, chord_index=%d", root, n, F.col("chord_index")), back=False))
    for v in "sb":
        wrong = (pitch_class(before[v]) == leading) & ~((pitch_class(now[v]) == tonic) & (now[v] > before[v]))
        out["L1"].append(_row(wrong, "L1", "leading_unresolved", "error", v.upper(), F.format_string("leading tone MIDI=%d, next MIDI=%d, expected tonic_pc=%d", before[v], now[v], tonic)))
    return out


def violations(chords: DataFrame, rules: tuple[str, ...] = tuple(ORDER), extended: bool = False, most: int = LONG) -> DataFrame:
    """All violations: score_id, chord_index (the later chord), measure, beat, rule_order, and the fields of ROW.

    Rules: M1 leaps, V1 crossing and overlap, P1 parallels, P2 hidden intervals of the outer voices, D1 doubled leading tone, L1
    leading tones that don't rise to the tonic. extended: D1 also on chords that are no full triad, read on their bass as root.
    One shuffle by score_id; a score of more than `most` chords spreads over ranges of chords, each with the last chord before it.
    """
    before = {"p_" + n: c for c, n in [*((v, v) for v in VOICES), ("measure", "measure"), ("beat", "beat"), ("chord_index", "index")]}
    both = previous(chords.select("score_id", "chord_index", "measure", "beat", *VOICES, "tonic_midi", "mode"), ("score_id",), ["chord_index"], before, most)
    if "D1" in rules:
        both = both.withColumn("triad", triad(*[F.col(v) for v in VOICES], roles=False)).withColumn("bare_root", pitch_class(F.col("b")))
    table = candidates(extended)
    return applied(both, [c for r in ORDER if r in rules for c in table[r]], ["score_id", "chord_index", "measure", "beat"])


def cadences(chords: DataFrame) -> DataFrame:
    """score_id and cadence (PAC, IAC, PC, DC, HC or NULL) of every score, from its last two chords."""
    w = Window.partitionBy("score_id").orderBy("chord_index")
    ends = chords.select("score_id", "chord_index", "tonic_midi", "mode", *VOICES, *[F.lag(v).over(w).alias("p_" + v) for v in VOICES], F.row_number().over(Window.partitionBy("score_id").orderBy(F.desc("chord_index"))).alias("k")).where("k = 1")
    t1, t0 = triad(*[F.col(v) for v in VOICES]), triad(*[F.col("p_" + v) for v in VOICES])
    ends = ends.withColumn("t1", t1).withColumn("t0", t0)
    tonic = pitch_class(F.col("tonic_midi"))
    d1, d0 = (scale_degree(F.col(t)["root_pc"], F.col("tonic_midi"), F.col("mode")) for t in ("t1", "t0"))
    rooted = (pitch_class(F.col("b")) == F.col("t1")["root_pc"]) & (pitch_class(F.col("p_b")) == F.col("t0")["root_pc"])
    authentic = F.when(rooted & (pitch_class(F.col("s")) == tonic), "PAC").otherwise("IAC")
    kind = F.when((d0 == 5) & (d1 == 1), authentic).when((d0 == 4) & (d1 == 1), "PC").when((d0 == 5) & (d1 == 6), "DC").when(d0.isNotNull() & (d1 == 5), "HC")
    return ends.select("score_id", kind.alias("cadence"))


def summary(chords: DataFrame, found: DataFrame) -> DataFrame:
    """Per score: chords, violations, one count a rule, and violations per chord (0 for a score without chords)."""
    n = chords.groupBy("score_id").agg(F.count("*").alias("chords"))
    counts = found.groupBy("score_id").agg(F.count("*").alias("violations"), *[F.count_if(F.col("rule_id") == r).alias(r.lower()) for r in ORDER])
    out = n.join(counts, "score_id", "left").fillna(0)
    return out.withColumn("per_chord", F.when(F.col("chords") > 0, F.col("violations") / F.col("chords")).otherwise(0.0))


def ranges(chords: DataFrame, bounds: DataFrame) -> DataFrame:
    """Notes outside `bounds` (voice, low, high) and upper voices more than an octave apart: score_id, chord_index, kind, voices."""
    notes = chords.select("score_id", "chord_index", F.explode(F.array(*[F.struct(F.lit(v.upper()).alias("voice"), F.col(v).alias("midi")) for v in VOICES])).alias("n")).select("score_id", "chord_index", "n.*")
    outside = notes.join(F.broadcast(bounds), "voice").where("midi NOT BETWEEN low AND high").select("score_id", "chord_index", F.lit("range").alias("kind"), F.col("voice").alias("voices"))
    wide = chords.select("score_id", "chord_index", F.explode(F.array_compact(F.array(F.when(F.abs(F.col("s") - F.col("a")) > 12, F.lit("S-A")), F.when(F.abs(F.col("a") - F.col("t")) > 12, F.lit("A-T"))))).alias("voices"))
    return outside.union(wide.select("score_id", "chord_index", F.lit("spacing").alias("kind"), "voices"))


def cases_match(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """score_id, actual, expected and matches: whether a case's violations are those expected.

    actual: score_id, chord_index, rule_id, severity, message; expected: score_id, pos, rule_id, severity, contains. The counts have to be equal,
    and each violation, in order, takes the first free expected one of its rule and severity whose `contains` is part of its message.
    """
    order = ("chord_index", "rule_id", "severity", "message")
    a = actual.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("a"))
    e = expected.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rule_id", "severity", "contains"))).alias("e"))
    both = a.join(e, "score_id", "full").select("score_id", *[F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c) for c, df in (("a", a), ("e", e))])

    def take(left: Column, x: Column) -> Column:
        fits = F.transform(left, lambda w: (w["rule_id"] == x["rule_id"]) & (w["severity"] == x["severity"]) & F.contains(x["message"], w["contains"]))
        at = F.array_position(fits, F.lit(True))
        return F.filter(left, lambda w, i: i + 1 != at)

    left = F.size(F.aggregate("a", F.col("e"), take))
    return both.select("score_id", F.size("a").alias("actual"), F.size("e").alias("expected"), ((F.size("a") == F.size("e")) & (left == 0)).alias("matches"))


def match_expected(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """A multiset match on `keys`: per key group the counts found on both sides, and how many are missing or extra."""
    e, a = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((expected, "expected"), (actual, "actual")))
    both = e.join(a, keys, "full").fillna(0, ["expected", "actual"])
    return both.withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("actual")).cast("long")).withColumn("extra", F.greatest(F.lit(0), F.col("actual") - F.col("expected")).cast("long"))
