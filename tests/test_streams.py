"""Streams against their batch forms: expiring state, the scheduler, sliding quantiles; and score files through the reader."""

from __future__ import annotations

import random
import tracemalloc
from datetime import UTC, datetime, timedelta
from itertools import chain

import pytest
from pyspark.sql import functions as F

from cadenza.operators import accounts, intervals, playback, ranges, telemetry
from cadenza.sources import reader, scores
from cadenza.streaming import scheduler, store

START = datetime(2026, 3, 1, tzinfo=UTC)


@pytest.fixture
def stream(spark, tmp_path):
    """Rows, a file of them for each micro-batch, as a stream that is run to its end into a table."""
    store.with_provider(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    made = iter(range(100))

    def run(batches: list, schema: str, transform, mode: str = "append", late: str = "10 seconds"):
        name = f"out{next(made)}"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i:03d}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}").withWatermark("ts", late)
        query = transform(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return spark.table(name), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    yield run
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for name in store.PROVIDER:
        spark.conf.unset(name)


def at(second: int) -> datetime:
    return START + timedelta(seconds=second)


def test_limit_expires(spark, stream):
    rng, batches, seq = random.Random(2), [], 0
    for batch in range(4):
        rows = []
        for second in sorted(rng.randrange(batch * 100, batch * 100 + 90) for _ in range(60)):
            rows.append((rng.randrange(12), seq, at(second)))
            seq += 1
        batches.append(rows)
    batches += [[(99, seq, at(5000))], [(99, seq + 1, at(6000))]]
    schema = "key long, seq long, ts timestamp"
    table, held = stream(batches, schema, lambda s: store.rate_limit(s, 3, 60))
    got = {(r["key"], r["seq"]): r["allowed"] for r in table.collect()}
    calls = spark.createDataFrame([r for b in batches for r in b], schema).select("key", "seq", F.unix_timestamp("ts").alias("second"), F.lit("incr").alias("op"), F.lit(None).cast("string").alias("value"), F.lit(60).alias("ttl_s"))
    assert got == {(r["key"], r["seq"]): int(r["found"]) <= 3 for r in accounts.keyed_values(calls).collect()}
    assert max(held) >= 10 and held[-1] <= 3  # all but the last key are gone


def test_lockout_expires(spark, stream):
    rng, batches, seq = random.Random(21), [], 0
    for batch in range(3):
        rows = []
        for second in sorted(rng.sample(range(batch * 100, batch * 100 + 90), 60)):
            rows.append((rng.randrange(5), seq, at(second), rng.random() < 0.2))
            seq += 1
        batches.append(rows)
    batches += [[(99, seq, at(5000), True)], [(99, seq + 1, at(6000), True)]]
    schema = "key long, seq long, ts timestamp, success boolean"
    table, held = stream(batches, schema, lambda s: store.lockouts(s, 3, 50))
    tries = spark.createDataFrame([r for b in batches for r in b], schema).select("key", "seq", F.unix_timestamp("ts").alias("second"), "success")
    want = {(r["key"], r["seq"]): r["outcome"] for r in accounts.lockouts(tries, 3, 50).collect()}
    assert {(r["key"], r["seq"]): r["outcome"] for r in table.collect()} == want and set(want.values()) == {"ok", "failed", "locked"}
    assert max(held) > 0 and held[-1] == 0


def test_values_expire(spark, stream):
    rng, batches, seq = random.Random(4), [], 0
    for batch in range(3):
        rows = []
        for second in sorted(rng.randrange(batch * 100, batch * 100 + 90) for _ in range(50)):
            key = rng.randrange(6)
            op = rng.choice(["set", "get", "get", "del"]) if key % 2 else rng.choice(["incr", "incr", "get", "del"])
            rows.append((key, seq, at(second), op, f"v{seq}" if op == "set" else None, 40))
            seq += 1
        batches.append(rows)
    batches += [[(50, seq, at(9000), "get", None, 40)], [(50, seq + 1, at(9500), "get", None, 40)]]
    schema = "key long, seq long, ts timestamp, op string, value string, ttl_s int"
    table, held = stream(batches, schema, store.keyed_values)
    calls = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("second", F.unix_timestamp("ts"))
    want = {(r["key"], r["seq"]): r["found"] for r in accounts.keyed_values(calls).collect()}
    assert {(r["key"], r["seq"]): r["found"] for r in table.collect()} == want and any(want.values())
    assert max(held) > 0 and held[-1] == 0


def test_state_needs_the_right_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        store.rate_limit(spark.createDataFrame([], "key long, seq long, ts timestamp"), 1, 1)


def test_sliding_quantiles_on_a_stream(spark, stream):
    rng = random.Random(7)
    batches = [[(at(rng.randrange(b * 300, b * 300 + 280)), rng.choice(["a", "b"]), rng.random() * 3) for _ in range(150)] for b in range(4)]
    batches.append([(at(20_000), "a", 0.1)])
    batches.append([(at(40_000), "a", 0.1)])
    schema = "ts timestamp, method string, secs double"
    table, _ = stream(batches, schema, lambda s: telemetry.sliding_quantiles(s, ["method"], 0.95))
    whole = telemetry.sliding_quantiles(spark.createDataFrame([r for b in batches for r in b], schema), ["method"], 0.95).collect()
    want = {tuple(r) for r in whole if r["start"] < datetime(2026, 3, 1, 1)}
    assert {tuple(r) for r in table.collect() if r["start"] < datetime(2026, 3, 1, 1)} == want and len(want) > 30


def test_scheduler_puts_out_a_job_once(spark, tmp_path):
    begun = int(datetime(2026, 5, 4, 7, 20, tzinfo=UTC).timestamp())
    schedules = spark.createDataFrame(
        [("hourly", "5 * * * *", "UTC", True, "skip", begun), ("often", "*/10 * * * *", "UTC", True, "catch_up", begun), ("off", "* * * * *", "UTC", False, "catch_up", begun), ("new", "0 * * * *", "UTC", True, "catch_up", None)],
        "name string, cron string, zone string, enabled boolean, policy string, last_at long",
    )
    folder = str(tmp_path / "scheduler")

    def ticks(*minutes: int):
        return spark.createDataFrame([(begun + 60 * m,) for m in minutes], "now long")

    def jobs():
        return sorted((r["name"], (r["due_at"] - begun) // 60) for r in scheduler.ledger(spark, folder).collect())

    assert scheduler.apply_batch(ticks(25), 0, schedules, folder) == 2
    first = [("often", 10), ("often", 20)]
    assert jobs() == first
    for _ in range(2):  # a batch that is run again replaces itself
        assert scheduler.apply_batch(ticks(55, 50), 1, schedules, folder) == 5
        assert jobs() == sorted([*first, ("hourly", 45), ("new", 40), ("often", 30), ("often", 40), ("often", 50)])
    # an earlier batch is run again behind a later one, and a tick comes late
    assert scheduler.apply_batch(ticks(25), 0, schedules, folder) == 2
    assert scheduler.apply_batch(ticks(30), 2, schedules, folder) == 0
    assert scheduler.apply_batch(ticks(), 3, schedules, folder) == 0
    assert len(jobs()) == 7


def test_scheduler_restarts(spark, tmp_path):
    begun = int(datetime(2026, 5, 4, 7, 0, tzinfo=UTC).timestamp())
    schedules = spark.createDataFrame([("a", "*/15 * * * *", "UTC", True, "catch_up", begun)], "name string, cron string, zone string, enabled boolean, policy string, last_at long")
    folder, source = str(tmp_path / "scheduler"), str(tmp_path / "ticks")
    for i, minute in enumerate((20, 50)):
        spark.createDataFrame([(begun + 60 * minute,)], "now long").coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema("now long").option("recursiveFileLookup", "true").parquet(source)
        assert scheduler.run(stream, schedules, folder, availableNow=True).awaitTermination(60)
    assert sorted((r["due_at"] - begun) // 60 for r in scheduler.ledger(spark, folder).collect()) == [15, 30, 45]


# --- ranges and dyadic covers


def test_scans_equal_the_plain_window(spark):
    from pyspark.sql import Window

    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i, rng.choice([None, 1, 2, 5]), rng.choice([None, None, "x", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x long, seq long, n long, mark string")
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("x", "seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.where("k is not null").withColumns({"total": F.coalesce(F.sum("n").over(w), F.lit(0)), "last": F.last("mark", ignorenulls=True).over(w)})
        got = ranges.scanned(df, ["k"], ["x", "seq"], ranges.by_number(F.col("x"), 4), sums={"total": F.col("n")}, lasts={"last": F.col("mark")}, inclusive=inclusive)
        assert sorted(map(tuple, got.where("k is not null").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert got.where("k is null and total is null and last is null").count() == df.where("k is null").count()


def test_one_long_key_is_scanned_in_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("doc"), F.col("id").alias("at"), (F.col("id") % 7).alias("n"))
    out = ranges.scanned(rows, ["doc"], ["at"], ranges.by_number(F.col("at")), sums={"total": F.col("n")})
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 100_000
    assert out.where("at = 199999").first()["total"] == sum(i % 7 for i in range(200_000))


def test_rows_without_a_key_do_not_meet(spark):
    rows = spark.range(1000).select(F.lit(None).cast("string").alias("chain"), F.col("id"))
    plan = ranges.with_previous(rows, "chain", "id", F.lit(0), "before")
    assert plan.where("before is not null").count() == 0 and plan.count() == 1000


@pytest.mark.parametrize("levels", [2, 5, 16])
def test_dyadic_cover(spark, levels):
    """Every grain of an interval lies in one node of its cover, no other does; rows grow with the logarithm of the length."""
    rng = random.Random(levels)
    spans = [(a, a + n) for a, n in ((rng.randrange(-300, 300), rng.randrange(0, 200)) for _ in range(120))]
    df = spark.createDataFrame(spans, "a long, b long").withColumn("c", intervals.cover(F.col("a"), F.col("b"), levels))
    for r in df.collect():
        grains = [g for level, node in r["c"] for g in range(node << level, (node + 1) << level)]
        assert sorted(grains) == list(range(r["a"], r["b"]))
    long = spark.createDataFrame([(1, 10**9)], "a long, b long").select(F.size(intervals.cover(F.col("a"), F.col("b"), 40)).alias("n")).first()["n"]
    assert long <= 60


def test_notes_of_any_length(spark):
    rng = random.Random(5)
    notes = [(1, rng.randrange(128), 1, rng.randrange(0, 100_000), rng.choice([0, 1, 700, 4000, 90_000, 10_000_000])) for _ in range(150)]
    probes = [(1, t) for t in sorted({rng.randrange(-10, 300_000) for _ in range(60)} | {n[3] for n in notes[:40]} | {n[3] + n[4] for n in notes[:40]})]
    frames = spark.createDataFrame(notes, "doc long, pitch long, staff int, start_ms long, duration_ms long"), spark.createDataFrame(probes, "doc long, t long")
    got = sorted((r["t"], r["pitch"], r["start_ms"], r["duration_ms"]) for r in playback.sounding_at(*frames).collect())
    assert got == sorted((t, p, s, d) for _, t in probes for _, p, _, s, d in notes if d > 0 and s <= t + 1 and t < s + d)


# --- score files


def score_xml(measures: int, broken: bool = False) -> bytes:
    note = "<note><pitch><step>D</step><octave>5</octave></pitch><duration>2</duration><lyric><text>la</text></lyric></note>"
    body = "".join(f"<measure number='{i}'>{note * 6}<backup><duration>12</duration></backup>{note}</measure>" for i in range(measures))
    return f"<score-partwise><work><work-title>T{measures}</work-title></work><part id='P1'>{body}</part>{'<oops></part>' if broken else ''}</score-partwise>".encode()


def test_score_files_through_the_reader(spark, tmp_path):
    folder = tmp_path / "scores"
    (folder / "more").mkdir(parents=True)
    (folder / "a.xml").write_bytes(score_xml(3))
    (folder / "more" / "b.xml").write_bytes(score_xml(2))
    (folder / "c.xml").write_bytes(score_xml(4, broken=True))
    (folder / "_hidden").write_bytes(b"nothing")
    rows = reader.read(spark, str(folder))
    assert rows.rdd.getNumPartitions() == 3
    counts = {(r["doc"].rsplit("/", 1)[-1], r["kind"]): r["count"] for r in rows.groupBy("doc", "kind").count().collect()}
    assert counts["a.xml", "note"] == 21 and counts["b.xml", "measure"] == 2 and counts["c.xml", "error"] == 1 and counts["c.xml", "note"] == 28
    last = rows.where("doc like '%c.xml'").orderBy(F.desc("measure_index"), F.desc("note_seq")).first()
    assert last["kind"] == "error" and last["error"]
    assert {r["kind"] for r in reader.whole(rows).where("doc like '%c.xml'").collect()} == {"error"}
    # the same rows as the binary reader's
    plain = scores.read_scores(spark, str(folder)).unionByName(scores.read_scores(spark, str(folder / "more"))).where("kind <> 'error'").drop("doc")
    assert sorted(map(str, plain.collect())) == sorted(map(str, reader.whole(rows).where("kind <> 'error'").drop("doc").collect()))
    titles = {r["title"]: r["measures"] for r in scores.documents(reader.whole(rows)).collect()}
    assert titles == {"T3": 3, "T2": 2}


def test_reading_takes_no_more_memory_for_longer_files():
    def peak(measures: int) -> int:
        class Slow:
            """A file that is made while it is read."""

            def __init__(self):
                self.parts = chain([score_xml(0).replace(b"</part></score-partwise>", b"")], (score_xml(1).split(b"<part id='P1'>")[1].split(b"</part>")[0] for _ in range(measures)), [b"</part></score-partwise>"])

            def read(self, _=-1):
                return next(self.parts, b"")

        tracemalloc.start()
        n = sum(1 for _ in scores.streamed("x", Slow()))
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == measures * 9 + 1
        return found

    assert peak(3000) < 1.5 * peak(100) + 200_000


def test_views_of_any_length(spark):
    rng = random.Random(15)
    notes = [(1, rng.randrange(128), 1, rng.randrange(0, 60_000), rng.choice([0, 1, 900, 50_000, 4_000_000])) for _ in range(120)]
    probes = [(1, t) for t in sorted({rng.randrange(0, 200_000) for _ in range(40)} | {n[3] for n in notes[:20]} | {n[3] + n[4] for n in notes[:20]})]
    frames = spark.createDataFrame(notes, "doc long, pitch long, staff int, start_ms long, duration_ms long"), spark.createDataFrame(probes, "doc long, t long")
    got = sorted((r["t"], r["pitch"], r["start_ms"], r["duration_ms"]) for r in playback.in_view(*frames, 3000).collect())
    assert got == sorted((t, p, s, d) for _, t in probes for _, p, _, s, d in notes if s + d >= t and s <= t + 3000)
    nexts = {r["t"]: r["next_ms"] for r in playback.next_onset(*frames, span_ms=1000).collect()}
    assert nexts == {t: min((n[3] for n in notes if n[3] > t + 1), default=None) for _, t in probes}


def test_nodes_of_sixteen(spark):
    """Every grain of an interval lies in one of its nodes, no other does, and its path meets that node alone."""
    rng = random.Random(16)
    spans = [(a, a + n) for a, n in ((rng.randrange(-5000, 5000), rng.choice([0, 1, 2, 15, 16, 17, 18, 40, 300, 9000])) for _ in range(60))]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", intervals.nodes(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        sizes = [16 ** (n % 4) for n in r["c"]]
        assert sorted(g for n, w in zip(r["c"], sizes) for g in range(n // 4 * w, n // 4 * w + w)) == list(range(r["a"], r["b"]))
    assert max(len(r["c"]) for r in rows) <= 93
    grains = spark.createDataFrame([(g,) for g in (-70000, -1, 0, 5, 70000)], "g long").select("g", intervals.path(F.col("g")).alias("p")).collect()
    assert all(r["p"] == [r["g"] // 16**k * 4 + k for k in range(4)] for r in grains)


def test_questions_do_not_go_through_the_driver(spark):
    """Probes are small by Spark's estimate and many once they are taken apart: no join of notes and times broadcasts them."""
    notes = spark.range(10).selectExpr("id doc", "60L pitch", "1 staff", "id * 100 start_ms", "50L duration_ms", "0 measure_index", "1 note_seq")
    probes = spark.range(10).selectExpr("id doc", "explode(sequence(0L, 60000L, 7500L)) t")
    for met in (playback.in_view(notes, probes, 4000), playback.sounding_at(notes, probes), playback.onsets_at(notes, probes), playback.last_before(notes, probes)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_spans_near_a_log_are_counted_without_pairs(spark):
    rng = random.Random(8)
    rows = [(t, i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(0, 60_000) if rng.random() < 0.9 else 7201 * rng.randrange(8) + 3600 * rng.randrange(3))) for t in (1, 2) for i in range(150)]
    rows += [(t, 1000 + i, at) for t, i, at in rows[::3]]  # several in a second
    df = spark.createDataFrame(rows, "trace int, event_id long, ts timestamp_ntz")
    logs, spans = df.where("event_id % 2 = 0"), df.where("event_id % 3 = 0")
    got = telemetry.counted_near(logs, spans)
    pairs = telemetry.correlate(logs, spans, 1).groupBy("l.trace", F.col("l.event_id").alias("log")).agg(F.count("*"), F.min("s.event_id"), F.max("s.event_id"))
    assert sorted(map(tuple, got.select("trace", "event_id", "n", "first", "last").collect())) == sorted(map(tuple, pairs.collect()))
    assert "s.event_id" not in got._jdf.queryExecution().toString() and telemetry.counted_near(logs, spans.where("false")).isEmpty()


def test_ranges_are_dealt_out_by_the_caller(spark):
    rows = spark.range(300).selectExpr("id % 3 doc", "id at", "if(id % 7 = 0, id, null) mark")
    for tasks in (None, 5):
        out = ranges.scanned(rows, ["doc"], ["at"], ranges.by_number(F.col("at"), 16), sums={"n": F.lit(1)}, lasts={"last": F.col("mark")}, tasks=tasks)
        assert {(r["doc"], r["at"]): (r["n"], r["last"]) for r in out.collect()} == {(i % 3, i): (i // 3 + 1, max((k for k in range(i % 3, i + 1, 3) if k % 7 == 0), default=None)) for i in range(300)}
    notes = spark.range(10).selectExpr("id doc", "60L pitch", "1 staff", "id * 100 start_ms", "50L duration_ms", "0 measure_index", "1 note_seq")
    probes = spark.range(10).selectExpr("id doc", "explode(sequence(0L, 60000L, 7500L)) t")
    for met in (playback.next_onset(notes, probes, span_ms=1000, tasks=5), playback.last_before(notes, probes, 1000, 5)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert any("_span" in line and ", 5), REPARTITION_BY_NUM" in line for line in plan.splitlines())
