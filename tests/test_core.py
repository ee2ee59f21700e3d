"""Known cases of the core operators: scores, playback, queue, accounts, schedules and streams."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import accounts, events, playback, queue, ranges, schedule, score
from cadenza.sources import scores
from cadenza.streaming import notes as stream_notes

XML = b"""<?xml version="1.0"?><score-partwise><work><work-title>Song</work-title></work><part id="P1"><measure number="1">
<attributes><divisions>4</divisions><key><fifths>-3</fifths></key><time><beats>3</beats><beat-type>4</beat-type></time><staves>2</staves>
<clef number="1"><sign>G</sign><line>2</line></clef><clef number="2"><sign>F</sign><line>4</line></clef></attributes>
<direction><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>120</per-minute></metronome></direction-type></direction>
<direction><direction-type><bracket/></direction-type></direction>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>4</duration></note>
<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>4</duration></note>
<note><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>x</duration></note>
<backup><duration>99</duration></backup><forward><duration>2</duration></forward>
<note><rest/><duration>6</duration><staff>2</staff></note></measure></part>
<part id="P2"><measure number="1"><attributes><divisions>8</divisions></attributes><note><duration>1</duration></note></measure></part></score-partwise>"""


def test_score_source(spark):
    files = spark.createDataFrame([("a", XML), ("b", b"<html><p>x</p></html>"), ("c", b"<a><b></a>")], "doc string, content binary")
    rows = scores.parse_scores(files)
    found = {(r["doc"], r["kind"]) for r in rows.select("doc", "kind").collect()}
    assert ("c", "error") in found and not any(d == "b" for d, _ in found) and ("a", "bracket") not in found
    moves = rows.where("kind in ('note', 'chord', 'backup', 'forward')").select("doc", "measure_index", "note_seq", "kind", "dur")
    pos = [r["pos"] for r in score.cursor_positions(moves).orderBy("note_seq").collect()]
    assert pos == [0, 0, 4, 2]
    doc = scores.documents(rows).where("doc = 'a'").first()
    assert (doc["title"], doc["divisions"], doc["fifths"], doc["beats"], doc["staves"], doc["bpm"], doc["measures"]) == ("Song", 8, -3, 3, 2, 120, 1)


LAYOUTS = [
    ([60, 90, 50], 200.0, [[0, 1, 2]]),  # an exact fit
    ([60, 90, 51], 200.0, [[0, 1], [2]]),
    ([70, 0, 130, 0, 1], 200.0, [[0, 1, 2, 3], [4]]),  # measures without width
    ([300, 300], 200.0, [[0], [1]]),  # wider than a line
    ([40] * 11, 500.0, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]),
    ([150, 40, 40, 150, 40, 40, 150, 20], 200.0, [[0, 1], [2, 3], [4, 5], [6, 7]]),
    ([], 200.0, []),
]


@pytest.mark.parametrize(("widths", "available", "systems"), LAYOUTS)
def test_layout(spark, widths, available, systems):
    df = spark.createDataFrame([(1, i, float(w)) for i, w in enumerate(widths)], "doc long, measure_index int, width double")
    assert [r["measures"] for r in score.pack_systems(df, available).orderBy("system_index").collect()] == systems
    for rows in (1, 2, 3):  # ranges shorter than a line
        assert [r["measures"] for r in score.pack_in_ranges(df, available, rows=rows).orderBy("system_index").collect()] == systems


def test_gaps_and_long_scores_pack_alike(spark):
    rng = random.Random(6)
    rows = [(d, 3 * i + i // 7, float(rng.choice([0, 20, 60, 61, 100, 130, 500]))) for d in range(4) for i in range(rng.randrange(1, 900))]
    df = spark.createDataFrame(rows, "doc long, measure_index int, width double")
    for most in (1, 2, 4, 9):
        want = sorted((r["doc"], r["system_index"], tuple(r["measures"]), r["width"]) for r in score.pack_systems(df, 321.0, most).collect())
        got = score.pack_in_ranges(df, 321.0, most, rows=64)
        assert sorted((r["doc"], r["system_index"], tuple(r["measures"]), r["width"]) for r in got.collect()) == want


def test_lanes(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 3.0, 8.0), (1, 2, 5.0, 6.0), (1, 3, 5.5, 7.0)], "doc long, seq int, x0 double, x1 double")
    assert [r["lane"] for r in score.text_lanes(df, ["doc"]).orderBy("seq").collect()] == [0, 1, 0, 2]


def test_sounding_bounds(spark):
    note = spark.createDataFrame([(1, 60, 1, 1000, 500)], "doc long, pitch long, staff int, start_ms long, duration_ms long")
    probes = spark.createDataFrame([(1, t) for t in (998, 999, 1000, 1499, 1500)], "doc long, t long")
    assert sorted(r["t"] for r in playback.sounding_at(note, probes).collect()) == [999, 1000, 1499]
    assert sorted(r["t"] for r in playback.onsets_at(note, probes).collect()) == [999, 1000]


def test_edges_and_beats(spark):
    notes = spark.createDataFrame([(1, 45, 1, 120, 300), (1, 71, 1, 420, 90), (1, 45, 2, 700, 80)], "doc long, pitch long, staff int, start_ms long, duration_ms long")
    spans = spark.createDataFrame([(1, 100, 200), (1, 130, 130), (1, 130, 420), (1, 430, 720)], "doc long, from_ms long, to_ms long")
    out = {(r["from_ms"], r["to_ms"]): (r["starts"], r["stops"]) for r in playback.edges(notes, spans).collect()}
    assert out == {(100, 200): ([45], []), (130, 130): ([], []), (130, 420): ([], [45]), (430, 720): ([45], [71])}
    starts = spark.createDataFrame([(1, 0, 0, 4500.0), (1, 1, 900, 4500.0), (1, 2, 2700, 4500.0)], "doc long, measure_index int, start_ms long, song_end double")
    beats = playback.beats(starts, 3).orderBy("time_ms").collect()
    assert [b["time_ms"] for b in beats] == [0, 300, 600, 900, 1500, 2100, 2700, 3300, 3900] and [b["time_ms"] for b in beats if b["accent"]] == [0, 900, 2700]


def test_edges_of_any_spans(spark):
    """Spans of any length, empty, turned round, repeated or without a score, by pieces of any length, against plain loops."""
    rng = random.Random(5)
    notes = [(rng.randrange(2), rng.randrange(5), rng.randrange(-9000, 60000), rng.choice([0, 40, 3000, 90000])) for _ in range(120)]
    spans = [(rng.randrange(3), a, a + rng.choice([-7000, 0, 1, 500, 20000])) for a in (rng.randrange(-500, 60000) for _ in range(60))] + [(None, 5, 505)]
    spans += spans[:3] + spans[-1:]
    dealt = spark.createDataFrame(notes, "doc long, pitch long, start_ms long, duration_ms long"), spark.createDataFrame(spans, "doc long, from_ms long, to_ms long")

    def plain(doc, a, b):
        own = [(p, s, s + n) for d, p, s, n in notes if d == doc]
        held, still = ({p for p, s, e in own if s <= t < e} for t in (a, b))
        return sorted({p for p, s, _ in own if a <= s < b}), sorted(held - still)

    expected = sorted((str(x), *plain(*x)) for x in spans)
    for tasks, piece in ((None, 4000), (7, 500)):
        out = playback.edges(*dealt, tasks, piece)
        assert sorted((str((r["doc"], r["from_ms"], r["to_ms"])), r["starts"], r["stops"]) for r in out.collect()) == expected
    assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1  # notes are dealt out once


def test_nodes_are_compiled(spark):
    """The JVM compiles no method of 8,000 bytes or more: exploding nodes would be interpreted for every row."""
    notes = spark.range(9).select((F.col("id") * 1).alias("doc"), F.lit(1).alias("pitch"), (F.col("id") * 7).alias("start_ms"), F.col("id").alias("duration_ms"))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = playback.sounding_at(notes, spark.range(3).select(F.col("id").alias("doc"), F.col("id").alias("t")))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    codes = debug.codegenStringSeq(plan)
    assert codes.size() and all(codes.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(codes.size()))


def test_play(spark):
    notes = spark.createDataFrame([(1, 60, 0, 100), (1, 62, 100, 100)], "doc long, pitch long, start_ms long, duration_ms long")
    inputs = [(1, 1, "tick", 30.0, None), (1, 2, "press", None, 60), (1, 3, "tick", 30.0, None), (1, 4, "tick", 90.0, None), (1, 5, "tick", 30.0, None), (1, 6, "press", None, 62), (1, 7, "tick", 99.0, None), (1, 8, "tick", 9.0, None)]
    out = playback.play(notes, spark.createDataFrame(inputs, "doc long, seq long, kind string, value double, pitch long")).orderBy("seq").collect()
    assert [(r["seq"], r["elapsed_ms"], r["blocked"]) for r in out] == [(1, 0.0, True), (3, 30.0, False), (4, 100.0, False), (5, 100.0, True), (7, 199.0, False), (8, 0.0, False)]


def test_play_streams_sessions_and_equals_plain_rules(spark):
    rng, notes, inputs, expected = random.Random(5), [], [], {}
    for doc in range(40):
        own = [(doc, rng.randrange(60, 64), rng.randrange(8) * 50, rng.randrange(80)) for _ in range(rng.randrange(9))]
        asks = [(doc, k, "tick", rng.choice([0.0, 20.0, 50.0, 120.0]), None) if rng.random() < 0.4 else (doc, k, "press", None, rng.choice([60, 61, 62, 63, None])) for k in range(60)]
        notes, inputs = notes + own, inputs + asks
        now, latched, end = 0.0, set(), max([s + n for _, _, s, n in own], default=0)
        for _, k, kind, value, pitch in asks if own else []:
            due = {p for _, p, s, _ in own if now - 1 <= s <= now + 1}
            if kind == "press":
                latched |= {pitch} & due
                continue
            blocked = not due <= latched
            if not blocked:
                to = min([now + value, *(s for _, _, s, _ in own if s > now + 1)])
                to, loop = (0.0, True) if end > 0 and to >= end else (to, False)
                latched = set() if loop or due and to != now else latched
                now = to
            expected[doc, k] = now, blocked
    rng.shuffle(inputs)
    frames = spark.createDataFrame(notes, "doc long, pitch long, start_ms long, duration_ms long"), spark.createDataFrame(inputs, "doc long, seq long, kind string, value double, pitch long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = playback.play(*frames, tasks=5)
        got = {(r["doc"], r["seq"]): (r["elapsed_ms"], r["blocked"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected
    # no frame of a whole session, and tasks are the caller's
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() == 5


def test_decode(spark):
    raw = [(1, 1, 0x90, 0x3C, 0x64), (1, 2, 0x95, 0x40, 0x50), (1, 3, 0x80, 0x3C, 0x40), (1, 4, 0x90, 0x40, 0), (1, 5, 0xB0, 7, 0x7F)]
    df = events.decode(spark.createDataFrame(raw, "stream long, seq long, status int, data1 int, data2 int"))
    assert [(r["kind"], r["pitch"], r["velocity"]) for r in df.orderBy("seq").collect()] == [("on", 60, 100), ("on", 64, 80), ("off", 60, 0), ("off", 64, 0), (None, 7, 0)]
    assert sorted(r["seq"] for r in events.released(df).collect()) == [3, 4]


MSGS = "id long, channel string, created_at timestamp, attempt_at timestamp, attempts int, backoff_s long, after_id long, commit_s int"


def test_ordered_queue_drains_after_a_poison_job(spark):
    at = lambda s: datetime(2026, 1, 1, 0, 0, s, tzinfo=UTC)
    now = F.lit("2026-01-01 00:00:30").cast("timestamp")
    msgs = spark.createDataFrame([(1, "c", at(0), at(1), 1, 1, -1, None), (2, "c", at(0), at(1), 3, 1, 1, None)], MSGS)
    payloads = spark.createDataFrame([(1, "bad", "{}"), (2, "good", "{}")], "id long, name string, payload string")
    dead = spark.createDataFrame([], "id long, channel string, name string, payload string, attempts int, dead_lettered_at timestamp")
    claimed, after = queue.poll(msgs, payloads, now, 5)
    assert [r["id"] for r in claimed.collect()] == [1]
    assert queue.poll(after, payloads, now, 5)[0].count() == 0
    msgs, payloads, dead = queue.sweep(after, payloads, dead, now)
    assert [r["id"] for r in dead.collect()] == [1] and queue.sweep(msgs, payloads, dead, now)[2].count() == 1
    assert [(r["id"], r["backoff_s"]) for r in queue.poll(msgs, payloads, now, 5)[0].collect()] == [(2, 1)]


def test_limits(spark):
    hits = spark.createDataFrame([(1, datetime(2026, 1, 1, 0, 0, s, tzinfo=UTC)) for s in (0, 1, 2, 3, 20, 59)] + [(1, datetime(2026, 1, 1, 0, 1, 0, tzinfo=UTC))], "key long, ts timestamp")
    assert [r["allowed"] for r in accounts.rate_limited(hits, 3, 60).orderBy("second").collect()] == [1, 1, 1, 0, 0, 0, 1]
    tries = spark.createDataFrame([(1, i, s, ok) for i, (s, ok) in enumerate([(0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True), (63, True)])], "key long, seq long, second long, success boolean")
    assert [r["outcome"] for r in accounts.lockouts(tries, 3, 60).orderBy("seq").collect()] == ["failed", "failed", "ok", "failed", "failed", "failed", "locked", "ok"]
    calls = [("create", 0), ("rotate", 0), ("rotate", 1), ("rotate", 9), ("rotate", 0), ("rotate", 2)]
    out = accounts.rotations(spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(calls)], "family long, seq long, kind string, token long"))
    assert [r["outcome"] for r in out.orderBy("seq").collect()] == ["created", "rotated", "rotated", "invalid", "reuse detected", "session revoked"]


def test_previous_over_ranges(spark):
    rows = [("a", 1), ("a", 2), ("a", 25), ("b", 3), ("b", 40), ("a", 26), ("a", 60), (None, 5), (None, 6), ("b", None)]
    out = ranges.with_previous(spark.createDataFrame(rows, "k string, x long"), "k", "x", F.floor(F.col("x") / 10), "before")
    assert out.columns == ["k", "x", "before"]
    found = {(r["k"], r["x"]): r["before"] for r in out.collect()}
    assert len(found) == 10 and found == {("a", 1): None, ("a", 2): 1, ("a", 25): 2, ("a", 26): 25, ("a", 60): 26, ("b", 3): None, ("b", 40): 3, (None, 5): None, (None, 6): None, ("b", None): None}


def test_sessions(spark):
    calls = [
        (1, 10, 1, 0, "create", None), (1, 10, 2, 5, "rotate", 0), (1, 20, 3, 8, "create", None), (1, 10, 4, 9, "rotate", 0), (1, 20, 5, 12, "rotate", 0),
        (1, None, 6, 15, "revoke_all", None), (1, 20, 7, 16, "rotate", 1), (1, 30, 8, 40, "create", None), (1, 30, 9, 47, "rotate", 0), (1, None, 10, 51, "revoke_all", None), (1, 30, 11, 52, "rotate", 1), (1, 30, 12, 53, "rotate", 0),
    ]
    out = accounts.sessions(spark.createDataFrame(calls, "user long, family long, seq long, second long, kind string, token long"), 10)
    found = [(r["family"], r["seq"], r["outcome"]) for r in out.orderBy("family", "seq").collect()]
    assert found == [
        (10, 1, "created"), (10, 2, "rotated"), (10, 4, "reuse detected"), (10, 6, "revoked"), (20, 3, "created"), (20, 5, "rotated"), (20, 6, "revoked"), (20, 7, "session revoked"),
        (30, 8, "created"), (30, 9, "rotated"), (30, 11, "rotated"), (30, 12, "invalid"),
    ]


def test_fold_crosses_batches(spark):
    """More rows of one key than an Arrow batch holds, in any order of arrival, against a plain loop."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(3000).selectExpr("id % 2 as key", "id as seq", "id * 7 as second", "id % 13 = 0 as success").orderBy(F.rand(3))
        got = {(r["key"], r["seq"]): r["outcome"] for r in accounts.lockouts(rows, 3, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in (0, 1):
        until, fails = 0, 0
        for seq in range(key, 3000, 2):
            fails = 0 if seq * 7 >= until else fails
            if fails >= 3:
                want[key, seq] = "locked"
            elif seq % 13 == 0:
                want[key, seq], fails, until = "ok", 0, 0
            else:
                want[key, seq], until, fails = "failed", until if fails else seq * 7 + 100, fails + 1
    assert got == want


def unix(*parts: int) -> int:
    return int(datetime(*parts, tzinfo=UTC).timestamp())


def test_cron():
    assert schedule.occurrences("45 6 * * *", "UTC", unix(2025, 9, 3), unix(2025, 9, 5, 6, 45)) == [unix(2025, 9, d, 6, 45) for d in (3, 4, 5)]
    assert schedule.occurrences("10 22 * * *", "Asia/Tokyo", unix(2025, 2, 17), unix(2025, 2, 18)) == [unix(2025, 2, 17, 13, 10)]
    assert schedule.occurrences("0 0 * * * *", "UTC", unix(2026, 1, 1), unix(2026, 1, 1, 3)) == [unix(2026, 1, 1, h) for h in (1, 2, 3)]
    assert schedule.occurrences("0 3 * * *", "UTC", 10, 10) == []
    assert schedule.occurrences("*/20 1-2 * jan Mon", "UTC", unix(2026, 1, 5), unix(2026, 1, 5, 1, 40)) == [unix(2026, 1, 5, 1, m) for m in (0, 20, 40)]
    # the clock skips 02:30 on 8 March and passes 01:30 twice on 1 November
    assert schedule.occurrences("30 2 * * *", "America/New_York", unix(2026, 3, 8), unix(2026, 3, 9)) == []
    assert schedule.occurrences("30 1 * * *", "America/New_York", unix(2026, 11, 1), unix(2026, 11, 2)) == [unix(2026, 11, 1, 5, 30)]


def test_streams(spark, tmp_path):
    held = spark.createDataFrame([(1, 1, "on", 60), (1, 2, "on", 64), (1, 3, "off", 60), (1, 4, "on", 67)], "stream long, seq long, kind string, pitch int")
    held.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(held.schema).parquet(str(tmp_path / "in"))
    query = stream_notes.held_notes(source).writeStream.outputMode("update").format("memory").queryName("held").trigger(availableNow=True).start()
    query.awaitTermination(30)
    assert [tuple(r["held"]) for r in spark.table("held").collect()][-1] == (64, 67)


def test_durations_beyond_nanoseconds_of_a_long(spark):
    rows = spark.createDataFrame([("3600M",), ("60000 weeks",), ("1999999999 ns",), ("99999999999999999999 y",), ("5 parsecs",)], "x string")
    assert [r[0] for r in rows.select(text.duration_seconds(F.col("x"))).collect()] == [3600 * 2630016, 60000 * 604800, 1, None, None]


def test_due_of_many_times_and_of_changing_clocks(spark):
    now = unix(2026, 3, 10)
    rows = [("a", "* * * * *", "UTC", True, "catch_up", now - 86400 * 9), ("b", "30 2 * * *", "America/New_York", True, "catch_up", unix(2026, 3, 6)), ("c", "* * * * *", "UTC", True, "skip", now - 600), ("d", "* * * * *", "Nowhere", True, "skip", 0), ("e", "* * * * *", "UTC", True, "skip", None)]
    df = schedule.due(spark.createDataFrame(rows, "name string, cron string, zone string, enabled boolean, policy string, last_at long"), now)
    found = {r["name"]: sorted(r["at"]) for r in df.groupBy("name").agg(F.collect_list("due_at").alias("at")).collect()}
    assert found == {"a": list(range(now - 86400 * 9 + 60, now - 86400 * 9 + 60 * 10_000 + 1, 60)), "b": [unix(2026, 3, 6, 7, 30), unix(2026, 3, 7, 7, 30), unix(2026, 3, 9, 6, 30)], "c": [now]}
    assert "Exchange" in df._jdf.queryExecution().executedPlan().toString()  # a small table's schedules are dealt out


ODD = b"""<score-partwise><work><work-title> </work-title></work><part><measure><attributes><divisions>4</divisions><clef number="x"><sign>F</sign></clef></attributes>
<note><pitch><octave>x</octave></pitch><duration> 7 </duration><duration>8</duration><type/><dot/><dot/><tie type="start"/><tie type="stop"/></note>
<note><rest/><notations><slur type="start"/></notations><lyric><text>la</text></lyric><time-modification><actual-notes>3</actual-notes></time-modification></note>
<note><duration>1<attributes><divisions>9</divisions></attributes></duration><staff>b</staff></note><note/><note><grace/><chord/></note>
<direction><direction-type><words> a </words></direction-type></direction></measure><forward><duration>2</duration></forward></part>
<part><measure><attributes><divisions>5</divisions></attributes><note><duration>1</duration></note></measure></part></score-partwise>"""


@pytest.mark.parametrize("content", [XML, ODD, b"<a><b></a>", b"", b"<html/>"])
def test_trees_and_streams_make_the_same_rows(content, monkeypatch):
    got = list(scores.parse("a", content))
    some = list(scores.parse("a", content, frozenset(["clef", "divisions"])))
    notes = list(scores.parse("a", content, frozenset(["note"])))
    monkeypatch.setattr(scores, "SMALL", -1)
    whole = list(scores.parse("a", content))
    assert [dict(sorted(r.items())) for r in got] == [dict(sorted(r.items())) for r in whole]
    assert some == [r for r in whole if r["kind"] in ("clef", "divisions", "error")] and notes == [r for r in whole if r["kind"] in ("note", "error")]


def test_rows_of_files_by_kind_and_column(spark):
    files = spark.createDataFrame([("a", XML), ("c", b"<a><b></a>")], "doc string, content binary")
    rows = scores.parse_scores(files, ("backup",), ["doc", "kind", "dur"])
    assert sorted(map(tuple, rows.collect())) == [("a", "backup", 99), ("c", "error", None)]
