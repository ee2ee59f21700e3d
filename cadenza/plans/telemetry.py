"""Queries over telemetry and raw note events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import telemetry as tm
from . import adapters as ad
from .registry import registry

QUERIES, SQL, query = registry()
CALLS = "WITH calls AS (SELECT event_id, ts, event_type AS method, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END status, value / 1000 secs, user_id FROM events)"
BUCKET = "CASE " + " ".join(f"WHEN secs <= {b} THEN {i}" for i, b in enumerate(tm.BOUNDS)) + f" ELSE {len(tm.BOUNDS)} END"
M = ad.MIDI_SQL
DECODED = ", dec AS (SELECT stream, seq, CASE WHEN status & 240 = 144 AND data2 > 0 THEN 'on' WHEN status & 240 IN (128, 144) THEN 'off' END kind, data1 pitch, CASE WHEN status & 240 = 144 THEN data2 ELSE 0 END velocity FROM midi)"


def calls(spark, d):
    kind = F.col("event_type")
    return ad.table(spark, d, "events").select("event_id", "ts", kind.alias("method"), F.when(kind == "error", "error").otherwise("ok").alias("status"), (F.col("value") / 1000).alias("secs"), "user_id")


@query(CALLS + f" SELECT method, status, {BUCKET} AS bucket, count(*) n FROM calls GROUP BY ALL")
def q331_histogram(spark, d):
    return tm.histogram(calls(spark, d))


@query(CALLS + " SELECT method, status, date_trunc('minute', ts) AS start, count(*) / 60.0::DOUBLE per_second FROM calls GROUP BY ALL")
def q332_rates(spark, d):
    return tm.rates(calls(spark, d))


_QS = ", ".join(f"sum(CASE WHEN bucket = {i} THEN n ELSE 0 END) c{i}" for i in range(len(tm.BOUNDS) + 1))
_SUM = [" + ".join([f"c{j}" for j in range(i)]) or "0" for i in range(len(tm.BOUNDS) + 2)]
_PICK = " ".join(f"WHEN {_SUM[i + 1]} >= r THEN {tm.BOUNDS[i - 1] if i else 0.0}::DOUBLE + ({b}::DOUBLE - {tm.BOUNDS[i - 1] if i else 0.0}::DOUBLE) * (r - ({_SUM[i]})) / greatest(c{i}, 1)" for i, b in enumerate(tm.BOUNDS))


@query(CALLS + f", h AS (SELECT method, {BUCKET} AS bucket, count(*) n FROM calls GROUP BY ALL), c AS (SELECT method, {_QS} FROM h GROUP BY method), w AS (SELECT *, 0.95::DOUBLE * ({_SUM[-1]}) r FROM c) SELECT method, round(CASE {_PICK} ELSE {tm.BOUNDS[-1]}::DOUBLE END, 6) quantile FROM w")
def q332_p95(spark, d):
    hist = tm.histogram(calls(spark, d)).groupBy("method", "bucket").agg(F.sum("n").alias("n"))
    return tm.bucket_quantile(hist, ["method"], 0.95).withColumn("quantile", F.round("quantile", 6))


@query(CALLS + " SELECT method AS name, max_by(secs, struct_pack(a := ts, b := secs)) AS value FROM calls GROUP BY method")
def q333_last_values(spark, d):
    return tm.last_values(calls(spark, d).select(F.col("method").alias("name"), "ts", F.col("secs").alias("value")))


@query(CALLS + " SELECT l.event_id log_id, s.event_id span_id FROM calls l JOIN calls s ON l.user_id = s.user_id AND l.status = 'error' AND s.method = 'click' AND abs(CAST(epoch(date_trunc('second', l.ts)) AS BIGINT) - CAST(epoch(date_trunc('second', s.ts)) AS BIGINT)) <= 172800")
def q316_correlated(spark, d):
    rows = calls(spark, d).withColumnRenamed("user_id", "trace")
    return tm.correlate(rows.where("status = 'error'"), rows.where("method = 'click'"), 48).select(F.col("l.event_id").alias("log_id"), F.col("s.event_id").alias("span_id"))


@query(M + DECODED + " SELECT stream, seq, kind, pitch, velocity FROM dec")
def q467_decoded(spark, d):
    return ev.decode(ad.midi(spark, d))


@query(M + DECODED + " SELECT stream, array_to_string(list_sort(list(pitch)), ',') held FROM (SELECT stream, pitch, max_by(kind, seq) last FROM dec WHERE kind IS NOT NULL GROUP BY ALL) WHERE last = 'on' GROUP BY stream")
def q501_held_notes(spark, d):
    return ev.held(ev.decode(ad.midi(spark, d))).select("stream", F.array_join("held", ",").alias("held"))


@query(M + DECODED + ", p AS (SELECT *, lag(kind) OVER (PARTITION BY stream, pitch ORDER BY seq) prev FROM dec WHERE kind IS NOT NULL) SELECT stream, seq, pitch FROM p WHERE kind = 'off' AND prev = 'on'")
def q502_released(spark, d):
    return ev.released(ev.decode(ad.midi(spark, d)))


@query(M + DECODED + " SELECT stream, seq, CASE WHEN velocity = 0 THEN 100 ELSE least(velocity, 127) END velocity FROM dec WHERE kind = 'on'")
def q468_synth_velocity(spark, d):
    return ev.decode(ad.midi(spark, d)).where("kind = 'on'").select("stream", "seq", ev.synth_velocity(F.col("velocity")).alias("velocity"))


@query(M + DECODED + ", fl AS (SELECT stream, pitch, max_by(kind, seq) FILTER (seq % 2 = 0) a, max_by(kind, seq) b FROM dec WHERE kind IS NOT NULL GROUP BY ALL) SELECT stream, count(*) FILTER (b = 'on' AND a IS DISTINCT FROM 'on') added, count(*) FILTER (a = 'on' AND b <> 'on') removed FROM fl GROUP BY stream HAVING count(*) FILTER ((b = 'on') IS DISTINCT FROM (coalesce(a, '') = 'on')) > 0")
def q364_changes(spark, d):
    rows = ev.decode(ad.midi(spark, d))
    return ev.set_changes(ev.held(rows.where("seq % 2 = 0")), ev.held(rows))
