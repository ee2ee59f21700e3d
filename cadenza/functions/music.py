"""Scalar music functions as columns."""

from __future__ import annotations

from functools import reduce

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: semitones above C and place in the scale of each step
SEMITONE = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
DIATONIC = {"C": 0, "D": 1, "E": 2, "F": 3, "G": 4, "A": 5, "B": 6}
# fixed values: pitch classes of the white keys
WHITE = (0, 2, 4, 5, 7, 9, 11)
# fixed values: staff steps of sharps and of flats in the order of fifths, for a treble staff
SHARP_STEPS = (8, 5, 9, 6, 3, 7, 4)
FLAT_STEPS = (4, 7, 3, 6, 2, 5, 1)


def lookup(key: Column, values: dict, default=None) -> Column:
    pick = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(None)))
    return pick if default is None else pick.otherwise(F.lit(default))


def midi_number(step: Column, octave: Column, alter: Column) -> Column:
    return (octave + 1) * 12 + lookup(step, SEMITONE, 0) + alter


def ms_per_division(bpm: Column, divisions: Column) -> Column:
    return (F.lit(60000.0) / bpm) / F.greatest(divisions, F.lit(1))


def nominal_divisions(divisions: Column, beats: Column, beat_type: Column) -> Column:
    """Divisions of a full measure; integer division, a beat type of 0 counts as 4."""
    kind = F.when(beat_type == 0, 4).otherwise(beat_type)
    whole = divisions * beats * 4
    return ((whole - whole % kind) / kind).cast("long")


def column_space(duration: Column, divisions: Column) -> Column:
    ratio = F.greatest(duration, F.lit(1)).cast("double") / F.greatest(divisions, F.lit(1)).cast("double")
    return F.lit(30.0) * F.pow(ratio, F.lit(0.6))


def is_white(pitch: Column) -> Column:
    return F.pmod(pitch, F.lit(12)).isin(*WHITE)


def white_before(pitch: Column) -> Column:
    """White keys from pitch 0 up to, not including, ``pitch`` (0 or more)."""
    octaves = F.floor(pitch / 12)
    inside = sum((F.when(F.pmod(pitch, F.lit(12)) > w, 1).otherwise(0) for w in WHITE), F.lit(0))
    return (octaves * 7 + inside).cast("long")


def diatonic_step(pitch: Column) -> Column:
    """Steps of the white-key scale from C of octave -1; black keys count as the white key below."""
    inside = sum((F.when(F.pmod(pitch, F.lit(12)) >= w, 1).otherwise(0) for w in WHITE[1:]), F.lit(0))
    return ((F.floor(pitch / 12) - 1) * 7 + inside).cast("long")


def flags_by_ratio(duration_ms: Column, bpm: Column) -> Column:
    """2, 1 or 0 flags by the share of a quarter note; a quarter is 500 ms where there is no tempo."""
    quarter = F.when(bpm > 0, F.lit(60000.0) / bpm).otherwise(F.lit(500.0))
    ratio = duration_ms / quarter
    return F.when(ratio <= 0.32, 2).when(ratio <= 0.62, 1).otherwise(0)


def head_kind(note_type: Column, duration: Column, divisions: Column) -> Column:
    """whole, half or black, by the written type or else by duration."""
    return (
        F.when(note_type == "whole", "whole")
        .when(note_type == "half", "half")
        .when(note_type.isNotNull(), "black")
        .when(duration >= 4 * divisions, "whole")
        .when(duration >= 2 * divisions, "half")
        .otherwise("black")
    )


def auto_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Keyboard bounds that cover low..high, on octave borders, two octaves at least, within the 88 keys."""
    a = low - F.pmod(low, F.lit(12))
    b = high + F.pmod(12 - F.pmod(high, F.lit(12)), F.lit(12))
    # octaves still missing to a span of 24, as many as fit above, the rest below
    need = F.greatest(F.lit(0), F.ceil((24 - (b - a)) / 12))
    up = F.least(need, F.greatest(F.lit(0), F.floor((108 - b) / 12)))
    down = F.least(need - up, F.greatest(F.lit(0), F.floor((a - 21) / 12)))
    a, b = a - 12 * down, b + 12 * up
    a, b = F.greatest(a, F.lit(21)), F.least(b, F.lit(108))
    empty = low.isNull() | high.isNull()
    return F.when(empty, 60).otherwise(F.least(a, low)).cast("int"), F.when(empty, 84).otherwise(F.greatest(b, high)).cast("int")


# fixed values: number of keys and lowest key of the preset keyboards, and the bounds of a piano
PRESETS = {25: 48, 37: 48, 49: 36, 61: 36, 76: 28, 88: 21}
LOWEST, HIGHEST = 21, 108
# fixed values: flags of written note types
FLAGS = {"eighth": 1, "16th": 2, "32nd": 3, "64th": 4}
# fixed values: first code points of the music font's digits for meters and tuplets, and its letters of dynamics
METER_DIGITS, TUPLET_DIGITS = 0xE080, 0xE880
DYNAMICS = {"p": "\ue520", "m": "\ue521", "f": "\ue522", "r": "\ue523", "s": "\ue524", "z": "\ue525", "n": "\ue526"}
# fixed values: diatonic value of the note that a clef's sign names
CLEF_NOTE = {"F": 24, "C": 28}
#: A black key's width and height against a white key's.
BLACK = 0.62


def within(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def preset_range(keys: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds of a keyboard of ``keys`` keys slid over the pitches low..high; wider where they do not fit."""
    first, span = lookup(keys, PRESETS), keys - 1
    a = F.least(first, F.coalesce(low, first))
    b = a + span
    up = high > b
    a, b = F.when(up, high - span).otherwise(a), F.when(up, high).otherwise(b)
    a = F.least(a, F.coalesce(low, a))
    return tuple(within(x, F.lit(LOWEST), F.lit(HIGHEST)).cast("int") for x in (a, b))


def key_rect(pitch: Column, low: Column, white_width: Column) -> tuple[Column, Column]:
    """(left edge, width) of a key on a keyboard that begins with ``low``; a black key straddles its boundary."""
    edge = (white_before(pitch) - white_before(low)) * white_width
    wide = white_width * BLACK
    return F.when(is_white(pitch), edge).otherwise(edge - wide / 2), F.when(is_white(pitch), white_width).otherwise(wide)


def near_miss(expected: Column, low: Column, high: Column, avoid: Column, pick: Column, spread: int = 3) -> Column:
    """A pitch near ``expected`` that is in range and not avoided: number ``pick`` of those within ``spread`` semitones, below
    before above at each distance, else the nearest further off, else ``expected`` itself."""
    all_ = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(high - low, F.lit(spread))), lambda d: F.array(expected - d, expected + d)))
    fits = F.filter(all_, lambda p: p.between(low, high) & ~F.array_contains(avoid, p))
    close = F.filter(fits, lambda p: F.abs(p - expected) <= spread)
    chosen = F.try_element_at(close, (F.pmod(pick, F.greatest(F.size(close), F.lit(1))) + 1).cast("int"))
    far = F.try_element_at(F.filter(fits, lambda p: F.abs(p - expected) <= high - low), F.lit(1))
    return F.coalesce(chosen, far, expected)


def key_signature(fifths: Column, bass: Column) -> Column:
    """Staff steps of a key's accidentals in their order; seven at most, two steps lower on a bass staff."""
    steps = F.when(fifths > 0, F.array(*map(F.lit, SHARP_STEPS))).otherwise(F.array(*map(F.lit, FLAT_STEPS)))
    return F.transform(F.slice(steps, 1, F.least(F.abs(fifths), F.lit(7)).cast("int")), lambda s: s - F.when(bass, 2).otherwise(0))


def ledger_lines(y: Column, bottom: Column, space: float) -> Column:
    """Places of the lines that a note at ``y`` needs below and above a staff whose lowest line lies at ``bottom``."""
    below = F.floor((y + 0.5 - bottom) / space)
    above = F.floor((bottom - 4 * space - y + 0.5) / space)

    def lines(n: Column, start: Column, step: float) -> Column:
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: start + k * step)).otherwise(F.array().cast("array<double>"))

    return F.concat(lines(below, bottom, space), lines(above, bottom - 4 * space, -space))


def slur_control(ax: Column, ay: Column, bx: Column, by: Column, top: Column, space: float) -> tuple[Column, Column]:
    """Control point of a slur's curve, so that its middle clears the highest note below it."""
    clear = 1.4 * space + F.abs(bx - ax) * 0.05
    return (ax + bx) / 2, 2 * (top - clear) - 0.5 * (ay + by)


def number_glyphs(number: Column, first: int) -> Column:
    return F.translate(number.cast("string"), "0123456789", "".join(chr(first + d) for d in range(10)))


def dynamics_glyphs(token: Column) -> Column:
    """Letters of the music font; other letters are dropped."""
    return F.translate(F.regexp_replace(F.lower(token), f"[^{''.join(DYNAMICS)}]", ""), "".join(DYNAMICS), "".join(DYNAMICS.values()))


def flags_by_type(note_type: Column) -> Column:
    return lookup(note_type, FLAGS, 0)


def rest_kind(note_type: Column) -> Column:
    return F.when(note_type.isin("whole", "half", "eighth", "16th"), note_type).otherwise("quarter")


def note_y(step: Column, octave: Column, sign: Column, line: Column, bottom: Column, space: float) -> Column:
    """Place of a note head on the staff of a clef whose sign sits on ``line``."""
    lowest = lookup(sign, CLEF_NOTE, 32) - (line - 1) * 2
    return bottom - (octave * 7 + lookup(step, DIATONIC, 0) - lowest) * (space / 2)


def speed(x: Column) -> Column:
    return within(x, F.lit(0.25), F.lit(2.0))


def frame_counts(dt_ms: Column) -> Column:
    """Whether a frame's step is taken: longer than nothing and shorter than 100 ms."""
    return (dt_ms > 0) & (dt_ms < 100)


#: Seconds, frequencies and peaks of a metronome click, plain and accented, and the rate used without one.
CLICK_S, CLICK_HZ, CLICK_PEAK, CLICK_RATE = 0.035, (1000.0, 1500.0), (0.25, 0.40), 44_100.0


def click(accent: Column, rate: Column) -> Column:
    """A click's samples, a sine under a linear decay, as an array of doubles."""
    rate = F.when(rate > 0, rate.cast("double")).otherwise(CLICK_RATE)
    hertz, peak = (F.when(accent, F.lit(loud)).otherwise(F.lit(plain)) for plain, loud in (CLICK_HZ, CLICK_PEAK))
    n = F.greatest(F.round(F.lit(CLICK_S) * rate).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: peak * (n - k) / n * F.sin(F.lit(2 * math.pi) * hertz * k / rate))
