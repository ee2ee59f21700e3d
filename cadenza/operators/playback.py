"""Playback analytics: what sounds, starts or comes next, edges, beats and the playback state machine.

A timed-notes table has (doc, pitch, staff, start_ms, duration_ms); probes are (doc, t) in milliseconds. Which notes and
measures hold a time is asked over nested nodes of time; range joins meet on time buckets, so that all stay equi-joins.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from .intervals import met_on, stabbed
from .ranges import by_number, scanned

BUCKET_MS = 4000


def _bucket(t: Column, width: int = BUCKET_MS) -> Column:
    return F.floor(t / width)


def sounding_at(notes: DataFrame, probes: DataFrame, lag: float = 1.0, tasks: int | None = None) -> DataFrame:
    """Probe rows joined with each note that sounds at t: start <= t + lag and t < start + duration."""
    end = F.col("start_ms") + F.col("duration_ms")
    met = stabbed(notes.where("duration_ms > 0"), probes, ["doc"], F.col("start_ms") - lag, end, F.col("t"), tasks=tasks)
    return met.where((F.col("start_ms") <= F.col("t") + lag) & (F.col("t") < end))


def in_view(notes: DataFrame, probes: DataFrame, ahead: int, tasks: int | None = None) -> DataFrame:
    """Probe rows joined with each note that ends at or after t and starts no later than ``ahead`` milliseconds behind it."""
    end = F.col("start_ms") + F.col("duration_ms")
    met = stabbed(notes, probes, ["doc"], F.col("start_ms") - ahead, end + 1, F.col("t"), tasks=tasks)
    return met.where((F.col("start_ms") <= F.col("t") + ahead) & (end >= F.col("t")))


def onsets_at(notes: DataFrame, probes: DataFrame, tolerance: float = 1.0, tasks: int | None = None) -> DataFrame:
    """Probe rows joined with each note that starts within the tolerance of t."""
    near = probes.withColumn("_b", F.explode(F.array_distinct(F.array(_bucket(F.col("t") - tolerance), _bucket(F.col("t") + tolerance)))))
    met = met_on(near, notes.withColumn("_b", _bucket(F.col("start_ms"))), ["doc", "_b"], tasks)
    return met.where(F.abs(F.col("start_ms") - F.col("t")) <= tolerance).drop("_b")


def pitch_sets(met: DataFrame, probes: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Every probe with its sorted distinct pitches (empty where none). ``tasks``: probes are dealt out into as many."""
    if tasks is not None:
        met, probes = met.repartition(tasks, "doc", "t"), probes.repartition(tasks, "doc", "t")
    sets = met.groupBy("doc", "t").agg(F.sort_array(F.collect_set("pitch")).alias(name))
    return probes.join(sets, ["doc", "t"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))


def next_onset(notes: DataFrame, probes: DataFrame, tolerance: float = 1.0, span_ms: int | None = None, tasks: int | None = None) -> DataFrame:
    """Every probe with next_ms, the first start after t + tolerance (null where none): one sorted pass per document.

    With ``span_ms``, ranges of as many milliseconds are sorted apart. ``tasks``: documents or ranges are dealt out into as many.
    """
    marks = notes.select("doc", F.col("start_ms").cast("double").alias("at"), F.col("start_ms").alias("next_ms"), F.lit(None).cast("long").alias("t"))
    asks = probes.select("doc", (F.col("t") + tolerance).alias("at"), F.lit(None).cast("long").alias("next_ms"), F.col("t").cast("long"))
    rows = marks.unionByName(asks)
    # at equal places a note comes before the question, so it is not "after"
    if span_ms is not None:
        back = rows.select("doc", (-F.col("at")).alias("_back"), F.col("t").isNull().alias("_mark"), "t", F.col("next_ms").alias("_ms"))
        found = scanned(back, ["doc"], ["_back", "_mark"], by_number(F.col("_back"), span_ms), lasts={"next_ms": F.col("_ms")}, tasks=tasks)
        return found.where("t is not null").select("doc", "t", "next_ms")
    if tasks is not None:
        rows = rows.repartition(tasks, "doc")
    later = Window.partitionBy("doc").orderBy("at", F.col("t").asc_nulls_first()).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_ms", F.first("next_ms", ignorenulls=True).over(later)).where("t is not null").select("doc", "t", "next_ms")


def measure_at(starts: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc, t, measure_index, fraction) of the measure that holds t; ``starts`` has (doc, measure_index, start_ms, song_end)."""
    until = F.coalesce(F.lead("start_ms").over(Window.partitionBy("doc").orderBy("measure_index")), F.col("song_end"))
    spans = starts.withColumn("until", until).where("until > start_ms")
    met = stabbed(spans, probes, ["doc"], F.col("start_ms"), F.col("until"), F.col("t")).where("t >= start_ms and t < until")
    part = (F.col("t") - F.col("start_ms")) / (F.col("until") - F.col("start_ms"))
    return met.select("doc", "t", "measure_index", F.least(F.lit(1.0), F.greatest(F.lit(0.0), part)).alias("fraction"))


def edges(notes: DataFrame, spans: DataFrame, tasks: int | None = None, piece: int = BUCKET_MS) -> DataFrame:
    """(doc, from_ms, to_ms, starts, stops) of spans [from_ms, to_ms).

    starts: pitches with an onset in the span; stops: pitches sounding at from_ms that no note covers at to_ms. Notes reach
    ``piece`` milliseconds back, so one question for each piece of a span meets all notes that sound or start from its one end
    to its other: one join, after which spans are dealt out once. Give the length of the spans where it is known.
    """
    span = ["doc", "from_ms", "to_ms"]
    end = F.col("start_ms") + F.col("duration_ms")
    notes = notes.select("doc", F.col("pitch").cast("long").alias("pitch"), "start_ms", "duration_ms").where("start_ms is not null")
    asked = spans.groupBy(*span).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    pieces = F.sequence(F.floor(F.least("from_ms", "to_ms")), F.ceil(F.greatest("from_ms", "to_ms")), F.lit(piece).cast("long"))
    asked = asked.withColumn("_p", F.explode_outer(pieces))
    met = stabbed(notes, asked, ["doc"], F.col("start_ms") - piece, F.greatest(end, F.col("start_ms") + 1), F.col("_p"), tasks=tasks, every=True)
    flags = {
        "_starts": (F.col("start_ms") >= F.col("from_ms")) & (F.col("start_ms") < F.col("to_ms")),
        "_held": (F.col("start_ms") <= F.col("from_ms")) & (F.col("from_ms") < end),
        "_still": (F.col("start_ms") <= F.col("to_ms")) & (F.col("to_ms") < end),
    }
    met = met.withColumns(flags).where("start_ms is null or _starts or _held or _still").select(*span, "_times", "pitch", *flags)
    if tasks is not None:
        met = met.repartition(tasks, *span)
    pitches = met.groupBy(*span, "_times", "pitch").agg(*[F.max(f).alias(f) for f in flags])
    stops = F.when(F.col("_held") & F.coalesce(~F.col("_still"), F.lit(True)), F.col("pitch"))
    found = pitches.groupBy(*span, "_times").agg(F.sort_array(F.collect_set(F.when(F.col("_starts"), F.col("pitch")))).alias("starts"), F.sort_array(F.collect_set(stops)).alias("stops"))
    # a span that was asked several times comes as often
    return found.select(*span, "starts", "stops", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("col")


def beats(starts: DataFrame, beats_a_measure: int) -> DataFrame:
    """(doc, time_ms, accent) of every beat; ``starts`` has (doc, measure_index, start_ms, song_end)."""
    if beats_a_measure < 1:
        return starts.select("doc", F.lit(0.0).alias("time_ms"), F.lit(False).alias("accent")).limit(0)
    until = F.coalesce(F.lead("start_ms").over(Window.partitionBy("doc").orderBy("measure_index")), F.col("song_end"))
    rows = starts.withColumn("step", (until - F.col("start_ms")) / beats_a_measure).where("step > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(beats_a_measure - 1))))
    return rows.select("doc", (F.col("start_ms") + F.col("k") * F.col("step")).alias("time_ms"), (F.col("k") == 0).alias("accent"))


def steady_bars(scores: DataFrame) -> DataFrame:
    """(doc, at_ms): bar lines by the metre alone, from the end of the first measure to one measure behind the end.

    ``scores`` has (doc, bpm, beats, beat_type, song_end). A beat type of 0 counts as 4; without a positive measure there are none.
    """
    measure = (F.lit(60000.0) / F.col("bpm")) * F.col("beats") * 4 / F.when(F.col("beat_type") == 0, 4).otherwise(F.col("beat_type"))
    rows = scores.withColumn("measure", measure).where("bpm > 0 and measure > 0 and song_end + measure >= measure")
    return rows.select("doc", "measure", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("song_end") + F.col("measure")) / F.col("measure")))).alias("k")).select("doc", (F.col("k") * F.col("measure")).alias("at_ms"))


def _session(onsets: array, pitches: array, end: float) -> Callable[[bool, float, int], tuple[float, bool] | None]:
    """A session's inputs one by one -> (elapsed, blocked) for a tick, None for a press; see ``play``. Onsets are sorted."""
    now, latched, high = 0.0, set(), bisect_right(onsets, 1.0)
    due = set(pitches[bisect_left(onsets, -1.0) : high])

    def step(tick: bool, value: float, pitch: int) -> tuple[float, bool] | None:
        nonlocal now, latched, due, high
        if not tick:
            if pitch in due:
                latched.add(pitch)
            return None
        if due and not due <= latched:
            return now, True
        to = now + value
        if high < len(onsets):
            to = min(to, onsets[high])
        loop = end > 0 and to >= end
        to = 0.0 if loop else to
        if loop or due and to != now:
            latched = set()
        if to != now:
            now, high = to, bisect_right(onsets, to + 1.0)
            due = set(pitches[bisect_left(onsets, to - 1.0) : high])
        return now, False

    return step


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc, at, seq, tick, value, pitch) of whole sessions, each with its notes (at is set) before its inputs."""
    key, onsets, pitches, end, step = object(), array("d"), array("q"), 0.0, None
    for batch in batches:
        docs, ats, *rest = batch.columns
        noted = ats.is_valid().to_numpy(zero_copy_only=False).tolist()
        docs = docs.to_pylist() if docs.null_count else docs.to_numpy().tolist()
        out = []
        for doc, note, at, seq, tick, value, pitch in zip(docs, noted, *((c.fill_null(0) if c.null_count else c).to_numpy(zero_copy_only=False).tolist() for c in (ats, *rest))):
            if doc != key:
                key, onsets, pitches, end, step = doc, array("d"), array("q"), 0.0, None
            if note:
                onsets.append(at)
                pitches.append(pitch)
                end = max(end, at + value)
            elif onsets:
                step = step or _session(onsets, pitches, end)
                if (found := step(tick, value, pitch)) is not None:
                    out.append((doc, seq, *found))
        columns = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PLAYED.types)], schema=PLAYED)


PLAYED = pa.schema([("doc", pa.int64()), ("seq", pa.int64()), ("elapsed_ms", pa.float64()), ("blocked", pa.bool_())])


def play(notes: DataFrame, inputs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc, seq, elapsed_ms, blocked) after every tick of wait-mode playback.

    ``inputs``: (doc, seq, kind, value, pitch) in order of seq; kind is tick (value: milliseconds, speed applied) or press.
    The playhead stays while an onset's pitches are not all pressed, goes no further than the next onset, and starts
    again at the end. Notes without a time or pitch are left out. Sessions are sorted by Spark, which may spill, and stream
    through in Arrow batches: a task holds one session's onsets and pitches, 16 bytes a note, and one batch of rows.
    ``tasks``: sessions are dealt out into as many.
    """
    given = notes.where("start_ms is not null and pitch is not null")
    rows = given.select(F.col("doc").cast("long"), F.col("start_ms").cast("double").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("tick"), F.coalesce(F.col("duration_ms").cast("double"), F.lit(0.0)).alias("value"), F.col("pitch").cast("long"))
    asks = inputs.select(F.col("doc").cast("long"), F.lit(None).cast("double").alias("at"), F.col("seq").cast("long"), (~F.col("kind").eqNullSafe("press")).alias("tick"), F.col("value").cast("double"), F.coalesce(F.col("pitch").cast("long"), F.lit(-(1 << 62))).alias("pitch"))
    every = rows.unionByName(asks)
    dealt = every.repartition("doc") if tasks is None else every.repartition(tasks, "doc")
    return dealt.sortWithinPartitions("doc", F.col("at").asc_nulls_last(), "seq").mapInArrow(_play, "doc long, seq long, elapsed_ms double, blocked boolean")


def key_feedback(required: DataFrame, active: DataFrame, on: list[str] = ["doc", "pitch"]) -> DataFrame:  # noqa: B006
    """(on, state): correct, expectedRight, expectedLeft or pressed; keys in neither set are idle and left out."""
    r, a = required.withColumn("_r", F.lit(True)), active.withColumn("_a", F.lit(True))
    both = r.join(a, on, "full")
    state = F.when(F.col("_r") & F.col("_a"), "correct").when(F.col("_r") & (F.col("staff") == 1), "expectedRight").when(F.col("_r"), "expectedLeft").otherwise("pressed")
    return both.select(*on, state.alias("state"))


def steady_beats(spans: DataFrame, every: int) -> DataFrame:
    """(doc, time_ms, accent) of the beats of a tempo in [from_ms, to_ms), an accent on each ``every``-th from 0 on.

    ``spans`` has (doc, bpm, from_ms, to_ms). No beats without a tempo, in an empty span, or for fewer than one beat a measure.
    """
    step = F.lit(60000.0) / F.col("bpm")
    first, last = F.ceil(F.col("from_ms") / step), F.ceil(F.col("to_ms") / step) - 1
    rows = spans.where((F.col("bpm") > 0) & (F.col("to_ms") > F.col("from_ms")) & F.lit(every >= 1))
    rows = rows.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    return rows.select("doc", (F.col("k") * step).alias("time_ms"), (F.pmod(F.col("k"), F.lit(max(every, 1))) == 0).alias("accent"))


def hit_test(points: DataFrame, low: int, high: int, white_width: float, height: float) -> DataFrame:
    """``points`` (x, y) with the pitch of the key under them: black keys win in their upper band; no row where no key is.

    Keys meet points by the white-key cell, of which a key touches two at most; there are no more than 128 keys.
    """
    spark = points.sparkSession
    left, width = music.key_rect(F.col("pitch"), F.lit(low), F.lit(white_width))
    keys = spark.range(low, high + 1).select(F.col("id").alias("pitch")).select("pitch", music.is_white(F.col("pitch")).alias("white"), left.alias("left"), width.alias("width"))
    cells = F.array_distinct(F.array(F.floor(F.col("left") / white_width), F.floor((F.col("left") + F.col("width")) / white_width)))
    keys = keys.withColumn("cell", F.explode(cells))
    met = points.where(F.col("y").between(0, height) & (F.col("x") >= 0)).withColumn("cell", F.floor(F.col("x") / white_width)).join(F.broadcast(keys), "cell")
    met = met.where((F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("width")) & (F.col("white") | (F.col("y") < height * music.BLACK)))
    return met.groupBy("x", "y").agg(F.min_by("pitch", F.struct("white", "pitch")).alias("pitch"))


def next_lines(systems: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, measure_index, next_system): the system shown ahead from the middle of the present one on, where there is one.

    ``systems`` has (doc, system_index, measures), ``places`` (doc, measure_index, fraction).
    """
    member = systems.select("doc", "system_index", F.size("measures").alias("n"), F.posexplode("measures").alias("at", "measure_index"))
    rows = places.join(member, ["doc", "measure_index"]).where((F.col("at") + F.col("fraction")) / F.col("n") >= 0.5)
    following = systems.select("doc", (F.col("system_index") - 1).alias("system_index"), F.col("system_index").alias("next_system"))
    return rows.join(following, ["doc", "system_index"]).select("doc", "measure_index", "next_system")


def last_before(notes: DataFrame, probes: DataFrame, span_ms: int | None = None, tasks: int | None = None) -> DataFrame:
    """(doc, t, staff, pitch): each staff's last note at or before t, its first note where there is none.

    One sorted pass over the notes and probes of a (doc, staff); of notes at one time the later measure and place wins. With
    ``span_ms``, ranges of as many milliseconds are sorted apart.
    """
    asks = met_on(probes, notes.select("doc", "staff").distinct(), ["doc"])
    own = notes.select("doc", "staff", F.col("start_ms").alias("at"), F.lit(False).alias("ask"), "measure_index", "note_seq", "pitch")
    asks = asks.select("doc", "staff", F.col("t").alias("at"), F.lit(True).alias("ask"), F.lit(None).cast("int").alias("measure_index"), F.lit(None).cast("int").alias("note_seq"), F.lit(None).cast("long").alias("pitch"))
    if span_ms is not None:
        firsts = notes.groupBy("doc", "staff").agg(F.min_by("pitch", F.struct("start_ms", "measure_index", "note_seq")).alias("first"))
        rows = scanned(own.unionByName(asks), ["doc", "staff"], ["at", "ask", "measure_index", "note_seq"], by_number(F.col("at"), span_ms), lasts={"before": F.col("pitch")}, tasks=tasks)
        return rows.where("ask").join(firsts, ["doc", "staff"]).select("doc", F.col("at").alias("t"), "staff", F.coalesce("before", "first").alias("pitch"))
    order = Window.partitionBy("doc", "staff").orderBy("at", "ask", "measure_index", "note_seq")
    before = F.last("pitch", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("pitch", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = own.unionByName(asks)
    rows = (rows if tasks is None else rows.repartition(tasks, "doc", "staff")).withColumn("found", F.coalesce(before, first)).where("ask")
    return rows.select("doc", F.col("at").alias("t"), "staff", F.col("found").alias("pitch"))
