"""Queries over ranges of long keys, sliding windows, lifetimes, ids and payloads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import accounts as ac
from ..operators import playback as pb
from ..operators import queue as qo
from ..operators import ranges as rg
from ..operators import schedule as sd
from ..operators import score as sc
from ..operators import telemetry as tm
from . import adapters as ad
from . import queue as qq
from . import schedule as sq
from . import score as sp
from . import telemetry as tq
from .registry import registry

QUERIES, SQL, query = registry()


def order_key():
    return F.col("o_orderkey")


# --- one key in many tasks

@query(sp.SQL["q341_measure_starts"])
def q341_measure_starts_by_ranges(spark, d):
    """Measure starts of every score, eight measures a range."""
    s = sc.measure_spans(ad.notes(spark, d, dealt=False), F.lit(ad.DIVISIONS * ad.BEATS * 4 // ad.BEAT_TYPE), rg.by_number(F.col("measure_index"), 8), ad.tasks(spark, d))
    return s.select("doc", "measure_index", F.col("span").cast("long").alias("span"), F.col("start_div").cast("long").alias("start_div"))


ONE = "WITH n AS (SELECT l_orderkey measure, CAST(sum(l_quantity) AS BIGINT) span, max(l_partkey % 9) = 0 final FROM lineitem GROUP BY l_orderkey)"


def one_score(spark, d):
    """All orders as the measures of one single score."""
    lines = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("measure"))
    return lines.agg(F.sum("l_quantity").cast("long").alias("span"), (F.max(F.col("l_partkey") % 9) == 0).alias("final")).withColumn("doc", F.lit(1))


@query(ONE + " SELECT measure, span, CAST(coalesce(sum(span) OVER (ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) start_div FROM n")
def q341_starts_of_one_score(spark, d):
    """One score as long as the table: no task sees more of it than one range."""
    s = one_score(spark, d)
    return rg.scanned(s, ["doc"], ["measure"], rg.by_number(F.col("measure")), sums={"start_div": F.col("span")}, inclusive=False, tasks=ad.tasks(spark, d)).select("measure", "span", "start_div")


@query(ONE + ", g AS (SELECT *, coalesce(sum(CASE WHEN final THEN 1 ELSE 0 END) OVER (ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) g FROM n) SELECT CAST(g AS BIGINT) group_no, count(*) n, min(measure) first, max(measure) last FROM g GROUP BY g")
def q344_groups_of_one_score(spark, d):
    rows = sc.end_mark_groups(one_score(spark, d), ["doc"], ["measure"], F.col("final"), rg.by_number(F.col("measure")), ad.tasks(spark, d))
    return rows.groupBy(F.col("group_no").cast("long").alias("group_no")).agg(F.count(F.lit(1)).alias("n"), F.min("measure").alias("first"), F.max("measure").alias("last"))


@query(sp.SQL["q344_beam_groups"])
def q344_beam_groups_by_ranges(spark, d):
    rows = sc.end_mark_groups(sp.flagged(spark, d), ["doc", "staff"], ["start_ms", "measure_index", "note_seq"], F.col("flags") == 0, rg.by_number(F.col("start_ms"), 60_000), ad.tasks(spark, d))
    return rows.groupBy("doc", "staff", "group_no").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))


@query(sp.SQL["q206_running_clef"])
def q206_running_clef_by_ranges(spark, d):
    measures, changes = sp.clef_changes(spark, d)
    return sc.running_clefs(measures, changes, rg.by_number(F.col("measure_index"), 8), ad.tasks(spark, d))


@query(sp.SQL["q203_systems"])
def q203_systems_by_ranges(spark, d):
    return sc.pack_in_ranges(sp.dense_widths(spark, d), 1000.0, rows=8, tasks=ad.tasks(spark, d)).select("doc", "system_index", sp.joined("measures").alias("measures"))


LONG = "wd AS (SELECT o_custkey % 8 doc, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1 measure_index, CAST(60 + o_orderkey % 397 AS DOUBLE) width FROM orders)"


@query(f"WITH RECURSIVE {LONG}, " + sp.SYSTEMS[sp.SYSTEMS.index("sys AS") :].replace("cnt >= 4", "cnt >= 9") + " SELECT doc, system_index, count(*) n, min(measure_index) first, max(measure_index) last, sum(w) width FROM sys GROUP BY ALL")
def q203_systems_of_long_scores(spark, d):
    """Eight scores of an eighth of all orders each, up to nine measures a line, 256 measures a range."""
    o = ad.table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("doc"), order_key().alias("key"), (60 + order_key() % 397).cast("double").alias("width"))
    # the number of a measure by ranges of keys, so that no score is sorted in one task
    o = rg.scanned(o, ["doc"], ["key"], rg.by_number(F.col("key")), sums={"measure_index": F.lit(1)}, inclusive=False, tasks=ad.tasks(spark, d))
    out = sc.pack_in_ranges(o.select("doc", "measure_index", "width"), 1000.0, 9, 256)
    return out.select("doc", "system_index", F.size("measures").cast("long").alias("n"), F.array_min("measures").cast("long").alias("first"), F.array_max("measures").cast("long").alias("last"), "width")


MINUTE = 60_000


@query(sp.SQL["q304_next_onset_over_whole_scores"])
def q304_next_onset_by_ranges(spark, d):
    return pb.next_onset(ad.timed(spark, d), ad.probes_to_the_end(spark, d), span_ms=MINUTE, tasks=ad.tasks(spark, d))


@query(sp.SQL["q343_last_before_playhead_over_whole_scores"])
def q343_last_before_playhead_by_ranges(spark, d):
    return pb.last_before(ad.timed(spark, d), ad.probes_to_the_end(spark, d), MINUTE, ad.tasks(spark, d))


# --- telemetry

@query(
    tq.CALLS + f", w AS (SELECT method, date_trunc('minute', ts) - to_minutes(j) AS start, {tq.BUCKET} AS bucket FROM calls, range(0, 5) r(j)), h AS (SELECT method, start, bucket, count(*) n FROM w GROUP BY ALL),"
    f" c AS (SELECT method, start, sum(n) n, {tq._QS} FROM h GROUP BY method, start), q AS (SELECT *, 0.95::DOUBLE * ({tq._SUM[-1]}) r FROM c)"
    f" SELECT method, start, CAST(n AS BIGINT) n, round(n / 300.0::DOUBLE, 6) per_second, round(CASE {tq._PICK} ELSE {tm.BOUNDS[-1]}::DOUBLE END, 6) quantile FROM q"
)
def q332_sliding_p95(spark, d):
    """Per method and minute: rate and 0.95 quantile over five minutes."""
    out = tm.sliding_quantiles(tq.calls(spark, d), ["method"], 0.95)
    return out.withColumns({"per_second": F.round("per_second", 6), "quantile": F.round("quantile", 6)})


@query(tq.CALLS + " SELECT l.event_id log_id, s.event_id span_id FROM calls l JOIN calls s ON l.user_id = s.user_id AND l.status = 'error' AND s.method = 'click' AND abs(CAST(epoch(date_trunc('second', l.ts)) AS BIGINT) - CAST(epoch(date_trunc('second', s.ts)) AS BIGINT)) <= 3600")
def q316_correlated_within_the_hour(spark, d):
    rows = tq.calls(spark, d).withColumnRenamed("user_id", "trace")
    return tm.correlate(rows.where("status = 'error'"), rows.where("method = 'click'"), 1).select(F.col("l.event_id").alias("log_id"), F.col("s.event_id").alias("span_id"))


@query(tq.CALLS + " SELECT l.event_id log_id, count(*) n, min(s.event_id) first, max(s.event_id) last FROM calls l JOIN calls s ON l.status = 'error' AND s.method = 'click' AND abs(CAST(epoch(date_trunc('second', l.ts)) AS BIGINT) - CAST(epoch(date_trunc('second', s.ts)) AS BIGINT)) <= 3600 GROUP BY l.event_id")
def q316_one_trace(spark, d):
    """All events as one trace: what happens within an hour of each error."""
    rows = tq.calls(spark, d).withColumn("trace", F.lit(1))
    met = tm.counted_near(rows.where("status = 'error'"), rows.where("method = 'click'"), 1)
    return met.select(F.col("event_id").alias("log_id"), "n", "first", "last")


# --- values with lifetimes, ids and payloads

@query(
    "WITH c AS (SELECT user_id AS key, event_id seq, CAST(epoch(date_trunc('second', ts)) AS BIGINT) sec, CASE event_type WHEN 'click' THEN 'set' WHEN 'error' THEN 'del' ELSE 'get' END op, props FROM events),"
    " l AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN struct_pack(o := op, v := props, s := sec) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) x FROM c)"
    " SELECT key, seq, CASE WHEN op = 'get' AND x.o = 'set' AND sec < x.s + 43200 THEN x.v END found FROM l"
)
def q117_keyed_values(spark, d):
    """Events as calls of a store: clicks set, errors delete, the others ask; values live for twelve hours."""
    kind = F.col("event_type")
    op = F.when(kind == "click", "set").when(kind == "error", "del").otherwise("get")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    calls = ad.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), second.alias("second"), op.alias("op"), F.col("props").alias("value"), F.lit(43200).alias("ttl_s"))
    return ac.keyed_values(calls)


@query(
    "WITH cr AS (SELECT 'user' || c_custkey || '@mail.test' email, md5(c_name) password_hash, c_custkey % 3 <> 0 email_verified FROM customer),"
    " asked AS (SELECT o_orderkey, 'user' || (o_custkey + o_orderkey % 3) || '@mail.test' email FROM orders) SELECT o_orderkey, email, password_hash, email_verified FROM asked LEFT JOIN cr USING (email)"
)
def q313_credentials_by_email(spark, d):
    def mail(key):
        return F.concat(F.lit("user"), key.cast("string"), F.lit("@mail.test"))

    k = F.col("c_custkey")
    known = ad.table(spark, d, "customer").select(mail(k).alias("email"), F.md5(F.col("c_name").cast("binary")).alias("password_hash"), (k % 3 != 0).alias("email_verified"))
    asked = ad.table(spark, d, "orders").select("o_orderkey", mail(F.col("o_custkey") + order_key() % 3).alias("email"))
    return ac.credentials_by_email(asked, known)


def _uuid_sql(head: str, version: str, h: str) -> str:
    return f"concat_ws('-', substr({head}, 1, 8), substr({head}, 9, 4), '{version}' || substr({h}, 14, 3), translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3), substr({h}, 21, 12))"


@query(
    "WITH h AS (SELECT o_orderkey, md5('ids:' || o_orderkey) h, lpad(lower(to_hex(CAST(epoch_ms(o_orderdate) AS BIGINT))), 12, '0') t FROM orders)"
    f" SELECT o_orderkey, {_uuid_sql('h', '4', 'h')} v4, {_uuid_sql('t', '7', 'h')} v7, CASE WHEN o_orderkey % 5 = 0 THEN '{tx.NIL_UUID}' ELSE {_uuid_sql('h', '4', 'h')} END or_nil FROM h"
)
def q485_made_uuids(spark, d):
    key = order_key().cast("string")
    v4, ms = tx.uuid_v4("ids", key), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return ad.table(spark, d, "orders").select("o_orderkey", v4.alias("v4"), tx.uuid_v7("ids", key, ms).alias("v7"), F.when(order_key() % 5 == 0, tx.NIL_UUID).otherwise(v4).alias("or_nil"))


@query(
    "WITH jb AS (SELECT o_orderkey k, CASE o_orderkey % 3 WHEN 0 THEN 'verification_email' WHEN 1 THEN 'orphan_reap' ELSE 'unheard_of' END AS name, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 100 END delay FROM orders),"
    " sp(name, channel, attempts, base_s) AS (VALUES ('verification_email', 'auth.email', 5, 10), ('orphan_reap', 'user.reap', 3, 30)), h AS (SELECT *, md5('enqueue:' || k) h FROM jb JOIN sp USING (name))"
    f" SELECT {_uuid_sql('h', '4', 'h')} id, channel, channel_args, attempts, backoff_s, attempt_at, commit_s FROM (SELECT *, '' channel_args, base_s backoff_s, timestamp '1998-06-01 00:00:00' + to_seconds(coalesce(delay, 0)) attempt_at, CAST(NULL AS INT) commit_s FROM h)"
)
def q402_enqueued_with_ids(spark, d):
    name = F.when(order_key() % 3 == 0, "verification_email").when(order_key() % 3 == 1, "orphan_reap").otherwise("unheard_of")
    jobs = ad.table(spark, d, "orders").select(order_key().alias("key"), name.alias("name"), F.lit("{}").alias("payload"), F.when(order_key() % 4 == 0, order_key() % 100).alias("delay_s"))
    return qo.enqueued(jobs, qo.job_specs(spark), "enqueue", qq.now()).select("id", "channel", "channel_args", "attempts", "backoff_s", "attempt_at", "commit_s")


TEXTS = "CASE event_id % 17 WHEN 0 THEN left(props, len(props) - 1) WHEN 1 THEN '[1]' WHEN 2 THEN '{\"k\":\"x\"}' WHEN 3 THEN NULL ELSE props END"


@query(
    f"WITH p AS (SELECT event_type kind, {TEXTS} t FROM events), v AS (SELECT *, t IS NOT NULL AND NOT (json_valid(t) AND coalesce(json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT', false)) bad, CASE WHEN json_valid(t) THEN json_extract_string(t, '$.k') END k FROM p)"
    " SELECT kind, count(*) n, count(*) FILTER (bad) bad, CAST(sum(TRY_CAST(k AS BIGINT)) FILTER (NOT bad) AS BIGINT) total, count(*) FILTER (t IS NOT NULL AND NOT bad AND TRY_CAST(k AS BIGINT) IS NULL) other FROM v GROUP BY kind"
)
def q483_decoded_payloads(spark, d):
    """Payload texts by kind: how many cannot be read, and what the typed field of the others adds up to."""
    rest = F.col("event_id") % 17
    text = F.when(rest == 0, F.expr("left(props, length(props) - 1)")).when(rest == 1, "[1]").when(rest == 2, '{"k":"x"}').when(rest == 3, None).otherwise(F.col("props"))
    rows = qo.decoded(ad.table(spark, d, "events").select(F.col("event_type").alias("kind"), text.alias("payload")), {"k": "long"})
    other = F.col("payload").isNotNull() & ~F.col("bad") & F.col("k").isNull()
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.sum(F.when(~F.col("bad"), F.col("k"))).alias("total"), F.count_if(other).alias("other"))


@query(
    "WITH s AS (SELECT o_custkey c, list_sort(list(DISTINCT substr(o_orderpriority, 1, 1))) a, list_sort(list(DISTINCT substr(o_orderpriority, 1, 1)) FILTER (o_orderkey % 2 = 0)) e FROM orders GROUP BY o_custkey), x AS (SELECT c, a, coalesce(e, []) e FROM s)"
    " SELECT c, array_to_string(list_sort(list_distinct(list_append(a, '9'))), ',') added, array_to_string(list_filter(a, lambda v: v <> '1'), ',') removed, array_to_string(list_filter(a, lambda v: NOT list_contains(e, v)), ',') difference, len(list_filter(['1', '2'], lambda v: NOT list_contains(a, v))) = 0 has_all FROM x"
)
def q361_set_operations(spark, d):
    first = F.substring("o_orderpriority", 1, 1)
    s = ad.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.collect_set(first).alias("a"), F.collect_set(F.when(order_key() % 2 == 0, first)).alias("e"))
    a, e = F.col("a"), F.col("e")
    lists = {"added": tx.with_item(a, F.lit("9")), "removed": tx.without_item(a, F.lit("1")), "difference": tx.without_all(a, e)}
    return s.select("c", *[sp.joined(x).alias(n) for n, x in lists.items()], tx.contains_all(a, F.array(F.lit("1"), F.lit("2"))).alias("has_all"))


# --- scores

BARS = "b AS (SELECT c_custkey doc, 40 + c_custkey % 100 bpm, 1 + c_custkey % 7 beats, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END beat_type, CAST(abs(c_acctbal) * 10 AS DOUBLE) song_end FROM customer), m AS (SELECT *, (60000.0::DOUBLE / bpm) * beats * 4 / CASE WHEN beat_type = 0 THEN 4 ELSE beat_type END measure FROM b)"


@query(f"WITH {BARS} SELECT doc, round(k * measure, 4) at_ms FROM (SELECT doc, measure, unnest(range(1, CAST(floor((song_end + measure) / measure) AS BIGINT) + 1)) k FROM m)")
def q349_steady_bar_lines(spark, d):
    k = F.col("c_custkey")
    unit = F.when(k % 4 == 0, 0).when(k % 4 == 1, 2).when(k % 4 == 2, 4).otherwise(8)
    rows = ad.table(spark, d, "customer").select(k.alias("doc"), (40 + k % 100).alias("bpm"), (1 + k % 7).alias("beats"), unit.alias("beat_type"), (F.abs("c_acctbal") * 10).cast("double").alias("song_end"))
    return pb.steady_bars(rows).withColumn("at_ms", F.round("at_ms", 4))


@query(
    sp.T.replace(ad.PROBES_SQL, ad.PROBES_TO_THE_END_SQL)
    + ", rq AS (SELECT p.doc, t, pitch, min(staff) staff FROM probes p JOIN timed n ON n.doc = p.doc AND start_ms <= t + 1 AND t < start_ms + duration_ms GROUP BY ALL), ac AS (SELECT DISTINCT p.doc, t, pitch FROM (SELECT user_id doc, 21 + event_id % 88 pitch FROM events WHERE event_type IN ('click', 'view')) x JOIN probes p USING (doc))"
    " SELECT coalesce(rq.doc, ac.doc) doc, coalesce(rq.t, ac.t) t, coalesce(rq.pitch, ac.pitch) pitch, CASE WHEN rq.doc IS NOT NULL AND ac.doc IS NOT NULL THEN 'correct' WHEN rq.doc IS NOT NULL AND staff = 1 THEN 'expectedRight' WHEN rq.doc IS NOT NULL THEN 'expectedLeft' ELSE 'pressed' END state FROM rq FULL JOIN ac ON rq.doc = ac.doc AND rq.t = ac.t AND rq.pitch = ac.pitch"
)
def q213_key_feedback_over_whole_scores(spark, d):
    """Feedback of every key at nine times from a score's start to its end; the pressed keys are the same each time."""
    p = ad.probes_to_the_end(spark, d)
    required = pb.sounding_at(ad.timed(spark, d), p).groupBy("doc", "t", "pitch").agg(F.min("staff").alias("staff"))
    active = ad.midi(spark, d).where("(status & 240) = 144").select(F.col("stream").alias("doc"), F.col("data1").cast("long").alias("pitch")).distinct().join(p, "doc")
    return pb.key_feedback(required, active, ["doc", "t", "pitch"])


# --- schedules in a zone

ZONED = f"""WITH sc AS (SELECT s_suppkey k, {sq.NOW} - 86400 * (20 + s_suppkey % 90) last_at FROM supplier),
dy AS (SELECT k, last_at, timestamp '1998-01-01 00:00:00' + to_days(CAST(j AS INT)) AS day FROM sc, range(0, 160) r(j)),
tm AS (SELECT k, last_at, day + to_hours(CAST(h AS INT)) + to_minutes(CAST(m * 20 + k % 20 AS INT)) AS wall FROM dy, (VALUES (4), (5), (6)) x(h), range(0, 3) y(m) WHERE dayofweek(day) BETWEEN 1 AND 5 AND month(day) IN (1, 2, 3, 4, 5)),
ab AS (SELECT k, last_at, CAST(epoch(timezone('Europe/Berlin', wall)) AS BIGINT) due_at FROM tm)"""


@query(ZONED + f" SELECT 's' || k AS name, count(*) n, min(due_at) first, max(due_at) last FROM ab WHERE due_at > last_at AND due_at <= {sq.NOW} GROUP BY k")
def q450_due_in_a_zone(spark, d):
    """Ranges, steps and names in a zone whose clock changes in the time asked for; the hours lie behind the change."""
    k = F.col("s_suppkey")
    s = ad.table(spark, d, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("name"), F.format_string("%d/20 4-6 * jan-MAY mon-fri", (k % 20).cast("int")).alias("cron"), F.lit("Europe/Berlin").alias("zone"),
        F.lit(True).alias("enabled"), F.lit("catch_up").alias("policy"), (F.lit(sq.NOW) - 86400 * (20 + k % 90)).alias("last_at"),
    )
    return sd.due(s, sq.NOW).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("due_at").alias("first"), F.max("due_at").alias("last"))


# --- rivals, repeats and texts beyond ASCII

@query("WITH up AS (SELECT c_custkey id, 'A' d, 'free' || (c_custkey // 3) h FROM customer UNION ALL SELECT c_custkey, 'B', 'free' || (c_custkey // 3) FROM customer WHERE c_custkey % 5 = 0) SELECT id, CASE WHEN d = 'B' THEN 'conflict' WHEN id = min(id) OVER (PARTITION BY h) THEN 'updated' ELSE 'already_exists' END outcome FROM up")
def q413_rival_updates(spark, d):
    """Three accounts at a time ask for one free handle, some of them twice in the batch."""
    k = F.col("c_custkey")
    handle = F.concat(F.lit("free"), F.floor(k / 3).cast("string"))
    asked = ad.table(spark, d, "customer").select(k.alias("id"), F.explode(F.when(k % 5 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))).alias("display_name"), handle.alias("handle"), handle.alias("handle_key"), (1 + k % 3).alias("expected"))
    return ac.optimistic_update(ad.users(spark, d), asked)[1]


@query(ad.QUEUE_SQL + ", up AS (SELECT id, max(s) s, max(p) p, CAST(sum(e) AS INT) e FROM (SELECT id, 300 s, '[]' p, 1 e FROM msgs WHERE id % 7 = 0 UNION ALL SELECT id, 900, '[1]', 2 FROM msgs WHERE id % 14 = 0 UNION ALL SELECT id, 60, NULL, 0 FROM msgs WHERE id % 21 = 0) GROUP BY id) SELECT m.id, CASE WHEN up.id IS NULL THEN attempt_at ELSE greatest(attempt_at, timestamp '1998-06-01 00:00:00' + to_seconds(s)) END attempt_at, attempts + coalesce(e, 0) attempts, coalesce(CASE WHEN pl.id IS NOT NULL THEN up.p END, payload) payload FROM msgs m LEFT JOIN up ON up.id = m.id LEFT JOIN payloads pl ON pl.id = m.id")
def q410_repeated_checkpoints(spark, d):
    m = ad.messages(spark, d)
    one, two, three = (m.where(f"id % {k} = 0").select("id", F.lit(s).alias("seconds"), F.lit(p).cast("string").alias("new_payload"), F.lit(e).alias("extra")) for k, s, p, e in ((7, 300, "[]", 1), (14, 900, "[1]", 2), (21, 60, None, 0)))
    after, own = qo.checkpoint(m, ad.payloads(spark, d), one.union(two).union(three), qq.now())
    return after.join(own, "id", "left").select("id", "attempt_at", "attempts", "payload")


HANDLES = ("Zoë{}", "Zoë{}", "ÉLAN{}", "名{}", "naïve-{}", "Straße{}", "a b{}", "ναι{}", "٣{}")


@query(
    "WITH h AS (SELECT c_custkey, replace(CASE c_custkey % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(HANDLES)) + " END, '{}', CAST(c_custkey AS VARCHAR)) h FROM customer)"
    " SELECT c_custkey, lower(nfc_normalize(h)) handle_key, length(h) BETWEEN 1 AND 15 AND regexp_full_match(h, '[\\p{L}\\p{N}]+') valid FROM h"
)
def q430_handles_beyond_ascii(spark, d):
    k = F.col("c_custkey")
    shape = F.element_at(F.array(*map(F.lit, HANDLES)), (1 + k % len(HANDLES)).cast("int"))
    handle = F.replace(shape, F.lit("{}"), k.cast("string"))
    return ad.table(spark, d, "customer").select("c_custkey", ac.fold_handle(handle).alias("handle_key"), ac.valid_handle(handle).alias("valid"))


DURATIONS = ("{} weeks", "{}ms", "{}000 millis", "1y {}d", "{} hours 5 min", "{} fortnights", "{}", "{}M")


@query(
    "WITH k AS (SELECT s_suppkey, s_suppkey % 8 v FROM supplier) SELECT s_suppkey, CAST(CASE v WHEN 0 THEN s_suppkey * 604800 WHEN 1 THEN s_suppkey // 1000 WHEN 2 THEN s_suppkey WHEN 3 THEN 31557600 + s_suppkey * 86400 WHEN 4 THEN s_suppkey * 3600 + 300 WHEN 7 THEN s_suppkey * 2630016 END AS BIGINT) AS seconds FROM k"
)
def q457_durations_of_all_units(spark, d):
    k = F.col("s_suppkey")
    text = F.replace(F.element_at(F.array(*map(F.lit, DURATIONS)), (1 + k % len(DURATIONS)).cast("int")), F.lit("{}"), k.cast("string"))
    return ad.table(spark, d, "supplier").select("s_suppkey", tx.duration_seconds(text).alias("seconds"))


# --- channels and workers

@query(ad.QUEUE_SQL + f", act AS (SELECT DISTINCT channel FROM msgs WHERE {qq.READY}) SELECT channel FROM act ORDER BY md5('poll 7:' || channel), channel LIMIT 3")
def q353_channels_by_seed(spark, d):
    return qo.channels_in_turn(qo.active_channels(ad.messages(spark, d), qq.now()), "poll 7", 3)


@query("SELECT id, CAST(n // 16 AS BIGINT) round, CAST(n % 16 AS INT) slot FROM (SELECT o_orderkey id, row_number() OVER (ORDER BY o_orderkey) - 1 n FROM orders)")
def q511_worker_rounds(spark, d):
    """All orders as claimed jobs of a worker that is told to run twenty at once."""
    return qo.worker_rounds(ad.table(spark, d, "orders").select(order_key().alias("id")), 20)
