"""Pitch, interval and staff arithmetic as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale degree by semitones over the tonic.
MAJOR = {0: 1, 2: 2, 4: 3, 5: 4, 7: 5, 9: 6, 11: 7}
MINOR = {0: 1, 2: 2, 3: 3, 5: 4, 7: 5, 8: 6, 11: 7}
#: Triads by the two intervals over the root.
TRIADS = {(3, 7): "minor", (4, 7): "major", (3, 6): "diminished", (4, 8): "augmented"}
#: Semitones of letters over C, and of accidentals.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
ACCIDENTALS = {"natural": 0, "sharp": 1, "flat": -1, "double_sharp": 2, "double_flat": -2}
#: The note of a clef's top line, as octave * 7 + letter (C = 0).
CLEF_TOP = {"treble": 7 * 5 + 3, "bass": 7 * 3 + 5, "alto": 7 * 4 + 4, "tenor": 7 * 4 + 2}


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def pitch_class(midi: Column) -> Column:
    return F.pmod(midi, F.lit(12))


def perfect(d: Column) -> Column:
    """A perfect fifth, octave or unison, whatever octaves lie between."""
    return (F.abs(d) % 12).isin(0, 7)


def step(d: Column) -> Column:
    return F.abs(d).isin(1, 2)


def scale_degree(pc: Column, tonic: Column, mode: Column) -> Column:
    d = F.pmod(pc - tonic, F.lit(12))
    return F.when(mode == "major", lookup(MAJOR, d)).otherwise(lookup(MINOR, d))


def triad(*voices: Column, roles: bool = True) -> Column:
    """struct(root_pc, quality, roles) of a chord whose pitch classes are the three of one triad; NULL for all others.

    Roots are tried upwards, so an augmented chord is named after its lowest class. roles is a map from S, A, T, B. The classes of a chord are the
    bits of a number, and the numbers of all triads a table: no lambdas and no arrays a chord.
    """
    qualities, found = list(TRIADS.items()), {}
    for root in range(12):
        for k, ((third, fifth), _) in enumerate(qualities):
            found.setdefault(sum(1 << (root + step) % 12 for step in (0, third, fifth)), root * 8 + k)
    bits = [F.expr("1") for _ in voices]
    bits = [F.call_function("shiftleft", one, pitch_class(v).cast("int")) for one, v in zip(bits, voices)]
    classes = bits[0]
    for b in bits[1:]:
        classes = classes.bitwiseOR(b)
    code = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])[classes]
    root, quality = (code / F.lit(8)).cast("int"), F.element_at(F.array(*[F.lit(name) for _, name in qualities]), code % 8 + 1)
    fields = [root.alias("root_pc"), quality.alias("quality")]
    if roles:
        role = lambda v: lookup({0: "root", 3: "third", 4: "third", 6: "fifth", 7: "fifth", 8: "fifth"}, F.pmod(pitch_class(v) - root, F.lit(12)))
        fields.append(F.create_map(*chain(*[(F.lit(n), role(v)) for n, v in zip("SATB", voices)])).alias("roles"))
    return F.when(code.isNotNull(), F.struct(*fields))


def midi_of_name(name: Column) -> Column:
    """'F#3' to its MIDI number (C4 = 60); NULL for anything else."""
    part = lambda k: F.regexp_extract(name, r"^([A-Ga-g])([#b]?)(-?\d+)$", k)
    shift = F.when(part(2) == "#", 1).when(part(2) == "b", -1).otherwise(0)
    return F.when(part(1) != "", part(3).try_cast("int") * 12 + 12 + lookup(LETTERS, F.upper(F.when(part(1) != "", part(1)).otherwise("C"))) + shift)


def staff_step(y: Column, top: Column, spacing: Column) -> Column:
    """Diatonic steps below the top line, halves to even; 0 where the spacing isn't positive."""
    return F.when(spacing > 0, F.bround((y - top) / (F.when(spacing > 0, spacing) / 2), 0).cast("int")).otherwise(0)


def staff_pitch(steps: Column, clef: Column, accidental: Column) -> Column:
    """MIDI pitch of a note so many diatonic steps under the clef's top line, 21 to 108; unknown clefs read as treble."""
    place = F.coalesce(lookup(CLEF_TOP, clef), F.lit(CLEF_TOP["treble"])) - steps
    letter = F.element_at(F.array(*[F.lit(v) for v in LETTERS.values()]), (F.pmod(place, F.lit(7)) + 1).cast("int"))
    natural = F.floor(place / F.lit(7)) * 12 + 12 + letter
    return F.greatest(F.lit(21), F.least(F.lit(108), natural + F.coalesce(lookup(ACCIDENTALS, accidental), F.lit(0)))).cast("int")


def coarse_pitch(y: Column, line_gap: float = 20.0) -> Column:
    """A pitch from the height alone: middle C at y 500, a semitone each half gap, cut to 36..84."""
    return F.greatest(F.lit(36), F.least(F.lit(84), F.lit(60) + ((500 - y) / (line_gap / 2)).cast("int")))


def beat_in_measure(x: Column, left: Column, right: Column) -> Column:
    """The quarter of a measure in which x lies, from 1; measures without width count as 800 wide."""
    width = F.when(right - left > 1, right - left).otherwise(800.0)
    return (1 + (F.greatest(F.lit(0.0), F.least(F.lit(0.999), (x - left) / width)) * 4).cast("int")).cast("double")
