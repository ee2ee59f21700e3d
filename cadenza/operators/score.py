"""Score analytics: note positions, timing, geometry and grouping.

A notes table has (doc, measure_index, note_seq, staff, dur, pitch, is_rest, is_chord); note_seq is the order within a
measure. Folds stream through a group's sorted rows with a small state; scans over a document can be cut into ranges, so that
one document of any length is scanned in many tasks (``span``, see ``ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from .folds import ordered_fold
from .ranges import RANGE, by_number, scanned


def cursor_positions(events: DataFrame) -> DataFrame:
    """(doc, measure_index, note_seq, pos) of the notes among the events (doc, measure_index, note_seq, kind, dur).

    kind: note takes the cursor and moves it, chord takes the last note's onset, backup and forward move the cursor,
    which never falls below 0.
    """

    def move(state: list, seq: int, kind: str, dur: int | None) -> tuple:
        dur = dur or 0
        if kind == "note":
            state[1] = state[0]
        if kind in ("note", "forward"):
            state[0] += dur
        elif kind == "backup":
            state[0] = max(0, state[0] - dur)
        return kind in ("note", "chord"), state[1]

    moved = ordered_fold(events, ["doc", "measure_index"], "note_seq", ["kind", "dur"], lambda: [0, 0], move, "is_note boolean, pos long")
    return moved.where("is_note").select("doc", "measure_index", F.col("note_seq").cast("int").alias("note_seq"), "pos")


def measure_spans(notes: DataFrame, nominal: Column, span: Column | None = None, tasks: int | None = None) -> DataFrame:
    """(doc, measure_index, span, start_div): the longer of the nominal length and the last end, and its running sum.

    With ``span``, ranges of measures of one document are summed up apart, dealt out into ``tasks``.
    """
    spans = notes.groupBy("doc", "measure_index").agg(F.greatest(nominal, F.max(F.col("pos") + F.col("dur"))).alias("span"))
    if span is not None:
        return scanned(spans, ["doc"], ["measure_index"], span, sums={"start_div": F.col("span")}, inclusive=False, tasks=tasks)
    before = Window.partitionBy("doc").orderBy("measure_index").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("start_div", F.coalesce(F.sum("span").over(before), F.lit(0)))


def timed_notes(notes: DataFrame, spans: DataFrame, bpm: Column, divisions: Column) -> DataFrame:
    """Sounding notes with start_ms, duration_ms and their unrounded end_at; rests are left out."""
    ms = music.ms_per_division(bpm, divisions)
    at = (F.col("start_div") + F.col("pos")) * ms
    sounding = notes.where(~F.col("is_rest") & F.col("pitch").isNotNull())
    return sounding.join(spans, ["doc", "measure_index"]).select(
        "doc", "measure_index", "note_seq", "pitch", "staff",
        F.round(at).cast("long").alias("start_ms"),
        F.round(F.col("dur") * ms).cast("long").alias("duration_ms"),
        (at + F.col("dur") * ms).alias("end_at"),
    )


def placed_notes(notes: DataFrame, nominal: Column) -> DataFrame:
    """``notes`` with span and start_div of their measure, by windows over the document alone: no aggregate and no join.

    Notes that are dealt out by document already need no further exchange.
    """
    measure = Window.partitionBy("doc", "measure_index")
    earlier = Window.partitionBy("doc").orderBy("measure_index").rangeBetween(Window.unboundedPreceding, -1)
    span = F.greatest(nominal, F.max(F.col("pos") + F.col("dur")).over(measure))
    rows = notes.withColumns({"span": span, "_once": F.col("note_seq") == F.min("note_seq").over(measure)})
    return rows.withColumn("start_div", F.coalesce(F.sum(F.when(F.col("_once"), F.col("span"))).over(earlier), F.lit(0))).drop("_once")


def timed(placed: DataFrame, bpm: Column, divisions: Column) -> DataFrame:
    """``placed_notes`` with start_ms, duration_ms and their unrounded end_at, rests among them (end_at null)."""
    ms = music.ms_per_division(bpm, divisions)
    at = (F.col("start_div") + F.col("pos")) * ms
    sounds = ~F.col("is_rest") & F.col("pitch").isNotNull()
    return placed.withColumns({"start_ms": F.round(at).cast("long"), "duration_ms": F.round(F.col("dur") * ms).cast("long"), "end_at": F.when(sounds, at + F.col("dur") * ms)})


def min_widths(notes: DataFrame, divisions: Column) -> DataFrame:
    """(doc, measure_index, width): spacing of the shortest duration at each position, 20 of margin, 60 at least."""
    columns = notes.groupBy("doc", "measure_index", "pos").agg(F.min("dur").alias("d"))
    total = F.sum(music.column_space(F.col("d"), divisions))
    return columns.groupBy("doc", "measure_index").agg(F.greatest(F.lit(60.0), 20 + total).alias("width"))


def pack_systems(widths: DataFrame, available: float, most: int = 4, tasks: int | None = None) -> DataFrame:
    """(doc, system_index, measures, width): greedy packing of measures in order into lines; one pass over a document.

    ``tasks``: documents, and then systems, are dealt out into as many.
    """

    def put(state: list, measure: int, width: float) -> tuple:
        number, filled, n = state
        if n and n < most and filled + width <= available:
            state[:] = number, filled + width, n + 1
        else:
            state[:] = number + 1, width, 1
        return state[0], width

    return _systems(ordered_fold(widths, "doc", "measure_index", ["width"], lambda: [-1, 0.0, 0], put, "system_index int, width double", tasks), tasks)


def _systems(placed: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc, system_index, measures, width) from the system of each measure."""
    placed = placed if tasks is None else placed.repartition(tasks, "doc", "system_index")
    rows = placed.groupBy("doc", "system_index").agg(F.array_sort(F.collect_list(F.struct("measure_index", "width"))).alias("m"))
    return rows.select("doc", "system_index", F.transform("m.measure_index", lambda x: x.cast("int")).alias("measures"), F.aggregate("m.width", F.lit(0.0), lambda a, w: a + w).alias("width"))


def pack_in_ranges(widths: DataFrame, available: float, most: int = 4, rows: int = RANGE, tasks: int | None = None) -> DataFrame:
    """The same as ``pack_systems``, in ranges of measures, so that one document of any length is packed in many tasks.

    What happens before a range decides only which of its first ``most`` measures begins its first system. So each range is
    packed from all of these entries at once: for each, how many systems begin, and what the last one holds. A document's
    ranges are then followed from entry to entry, one row a range, and each measure takes its number from the entry that was met.
    Measures are numbered from 0 without large gaps. ``tasks``: ranges, documents and systems are dealt out into as many.
    """
    cut = widths.withColumn("_span", by_number(F.col("measure_index"), rows))

    def put(state: list, measure: int, width: float) -> tuple:
        seen, walkers = state
        for e, walker in enumerate(walkers):
            if e > seen:
                break
            number, filled, n = walker
            walker[:] = (number, filled + width, n + 1) if n and n < most and filled + width <= available else (number + 1, width, 1)
        state[0] += 1
        return width, seen, [w[0] for w in walkers], [w[1] for w in walkers], [w[2] for w in walkers]

    packed = ordered_fold(cut, ["doc", "_span"], "measure_index", ["width"], lambda: [0, [[0, 0.0, 0] for _ in range(most)]], put, "width double, at int, numbers array<int>, filled array<double>, n array<int>", tasks)
    heads = F.array_sort(F.collect_list(F.when(F.col("at") < most - 1, F.struct("at", "width"))))
    borders = packed.groupBy("doc", "_span").agg(F.transform(heads, lambda h: h["width"]).alias("heads"), F.max_by(F.struct(F.col("at") + 1, "numbers", "filled", "n"), "at").alias("last"))
    borders = borders.select("doc", "_span", "heads", F.col("last").getItem("col1").alias("rows"), "last.numbers", "last.filled", "last.n")

    def enter(state: list, span: int, heads: list, size: int, numbers: list, filled: list, n: list) -> tuple:
        before, held, count = state
        entry = 0
        while count and entry < len(heads) and count < most and held + heads[entry] <= available:
            held, count, entry = held + heads[entry], count + 1, entry + 1
        state[:] = (before, held, count) if entry >= size else (before + numbers[entry], filled[entry], n[entry])
        return entry, before

    entered = ordered_fold(borders, "doc", "_span", ["heads", "rows", "numbers", "filled", "n"], lambda: [0, 0.0, 0], enter, "entry int, before int", tasks)
    met = packed.join(entered, ["doc", "_span"])
    number = F.col("before") - 1 + F.coalesce(F.try_element_at("numbers", F.col("entry") + 1), F.lit(0))
    return _systems(met.select("doc", "measure_index", number.cast("int").alias("system_index"), "width"), tasks)


def justify(widths: DataFrame, systems: DataFrame, usable: float) -> DataFrame:
    """(doc, system_index, measure_index, x, width): measures stretched to the usable width of their line."""
    member = systems.select("doc", "system_index", F.posexplode("measures").alias("k", "measure_index"))
    line = Window.partitionBy("doc", "system_index")
    rows = member.join(widths, ["doc", "measure_index"]).withColumn("w", F.col("width") * (F.lit(usable) / F.sum("width").over(line)))
    before = F.sum("w").over(line.orderBy("measure_index").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("doc", "system_index", "measure_index", F.coalesce(before, F.lit(0.0)).alias("x"), F.col("w").alias("width"))


def running_clefs(measures: DataFrame, changes: DataFrame, span: Column | None = None, tasks: int | None = None) -> DataFrame:
    """(doc, staff, measure_index, sign, line): the last clef at or before each measure; G2 on staff 1, else F4.

    With ``span``, ranges of measures of one staff are scanned apart, dealt out into ``tasks``.
    """
    rows = measures.join(changes, ["doc", "staff", "measure_index"], "left")
    known = F.when(F.col("sign").isNotNull(), F.struct("sign", "line"))
    if span is not None:
        rows = scanned(rows, ["doc", "staff"], ["measure_index"], span, lasts={"_last": known}, tasks=tasks)
    else:
        rows = rows.withColumn("_last", F.last(known, ignorenulls=True).over(Window.partitionBy("doc", "staff").orderBy("measure_index").rowsBetween(Window.unboundedPreceding, 0)))
    default = F.struct(F.when(F.col("staff") == 1, "G").otherwise("F").alias("sign"), F.when(F.col("staff") == 1, 2).otherwise(4).alias("line"))
    return rows.withColumn("c", F.coalesce("_last", default)).select("doc", "staff", "measure_index", "c.sign", "c.line")


def end_mark_groups(rows: DataFrame, keys: list[str], order: list[str], is_end: Column, span: Column | None = None, tasks: int | None = None) -> DataFrame:
    """``rows`` with group_no: rows up to and with an end mark form a group; what is left at the end is one too.

    With ``span``, ranges of one key's rows are counted apart, dealt out into ``tasks``.
    """
    if span is not None:
        return scanned(rows, keys, order, span, sums={"group_no": is_end.cast("int")}, inclusive=False, tasks=tasks)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("group_no", F.coalesce(F.sum(is_end.cast("int")).over(before), F.lit(0)))


def tuplet_groups(notes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group_no, members): runs of notes with ``actual``, closed after that many or at a note without it.

    ``notes`` has the keys, note_seq and actual (null outside tuplets). Groups that do not fill up are kept as they are.
    """

    def step(state: list, seq: int, actual: int | None) -> tuple:
        number, size, n = state
        if actual is None:
            state[1:] = 0, 0
            return (None,)
        state[:] = (number, size, n + 1) if n and n < size else (number + 1, actual, 1)
        return (state[0],)

    numbered = ordered_fold(notes, keys, "note_seq", ["actual"], lambda: [-1, 0, 0], step, "group_no int").where("group_no is not null")
    return numbered.groupBy(*keys, "group_no").agg(F.array_sort(F.collect_list(F.col("note_seq").cast("int"))).alias("members"))


class _Lanes:
    """Last ends by lane, over a tree of minima: the lowest free lane is found and filled in O(log lanes)."""

    def __init__(self):
        self.used, self.width, self.least = 0, 1, [float("inf")] * 2

    def take(self, start: float, end: float) -> int:
        least, at = self.least, 1
        if least[1] <= start:  # some lane is free: go down towards the lowest
            while at < self.width:
                at = 2 * at if least[2 * at] <= start else 2 * at + 1
            lane = at - self.width
        else:
            lane = self.used
            if lane == self.width:
                leaves = least[self.width :] + [float("inf")] * self.width
                self.width *= 2
                self.least = least = [float("inf")] * self.width + leaves
                for i in range(self.width - 1, 0, -1):
                    least[i] = min(least[2 * i], least[2 * i + 1])
            self.used += 1
        at = self.width + lane
        least[at] = end
        while at > 1:
            at //= 2
            least[at] = min(least[2 * at], least[2 * at + 1])
        return lane


def text_lanes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, lane): first lane whose last end is at or before the text's start, else a new one; in order of seq.

    Texts may start in any order; a group's state is one number a lane.
    """
    return ordered_fold(texts, keys, "seq", ["x0", "x1"], lambda: [_Lanes()], lambda state, seq, x0, x1: (state[0].take(x0, x1),), "lane int").withColumn("seq", F.col("seq").cast("int"))


def pair_marks(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_seq, stop_seq): each stop with the last start before it that no later start replaced."""
    order = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.last(F.when(F.col("is_start") | F.col("is_stop"), F.struct("seq", F.col("is_start").alias("s"))), ignorenulls=True).over(order)
    return marks.withColumn("o", open_).where(F.col("is_stop") & F.col("o.s")).select(*keys, F.col("o.seq").alias("start_seq"), F.col("seq").alias("stop_seq"))


def nested_pairs(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_seq, stop_seq, top): each stop with the last open start, as on a stack; top is the least y between.

    ``marks`` has the keys, seq, is_start, is_stop and y. A stop without an open start is left out; a group is one system's
    notes of a staff and voice.
    """

    def step(state: list, seq: int, is_start: bool, is_stop: bool, y: float) -> tuple:
        out = None, None
        if is_stop and state:
            start, top = state.pop()
            out = start, min(top, y)
            if state:  # what lies inside lies inside the one around it
                state[-1][1] = min(state[-1][1], top, y)
        elif state:
            state[-1][1] = min(state[-1][1], y)
        if is_start:
            state.append([seq, y])
        return out

    rows = marks.select(*keys, F.col("seq").cast("long").alias("seq"), "is_start", "is_stop", F.col("y").cast("double").alias("y"))
    pairs = ordered_fold(rows, keys, "seq", ["is_start", "is_stop", "y"], list, step, "start_seq long, top double").where("start_seq is not null")
    return pairs.select(*keys, "start_seq", F.col("seq").alias("stop_seq"), "top")
