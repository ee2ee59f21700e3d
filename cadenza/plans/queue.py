"""Queries over the job queue, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import queue as q
from . import adapters as ad
from .registry import registry

QUERIES, SQL, query = registry()
Q = ad.QUEUE_SQL
AT = "TIMESTAMP '1998-06-01 00:00:00'"
READY = f"attempt_at <= {AT} AND (after_id IS NULL OR after_id = -1)"
CHOSEN = (
    f", act AS (SELECT DISTINCT channel FROM msgs WHERE {READY} ORDER BY channel LIMIT 64), rk AS (SELECT m.*, row_number() OVER (PARTITION BY channel ORDER BY attempt_at, id) r FROM msgs m WHERE {READY} AND channel IN (SELECT channel FROM act)),"
    " chosen AS (SELECT * FROM rk WHERE r <= 64 ORDER BY channel, r LIMIT 64)"
)


def now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


def dead_letters(spark, d):
    """Messages dead long since: those exhausted whose key is a multiple of 13."""
    rows = ad.messages(spark, d).where(q.is_exhausted() & (F.col("id") % 13 == 0)).join(ad.payloads(spark, d), "id")
    return rows.select("id", "channel", "name", "payload", "attempts", F.lit("1998-05-01 00:00:00").cast("timestamp_ntz").alias("dead_lettered_at"))


DEAD = ", dead AS (SELECT id, channel, name, payload, attempts, TIMESTAMP '1998-05-01 00:00:00' dead_lettered_at FROM msgs JOIN payloads USING (id) WHERE attempt_at IS NULL AND attempts <= 0 AND id % 13 = 0)"


@query(Q + f" SELECT id, channel, attempts, created_at, attempt_at FROM msgs WHERE commit_s IS NULL AND {READY}")
def q420_pending(spark, d):
    return q.pending(ad.messages(spark, d), now())


@query(Q + f" SELECT id, channel, attempts, created_at, attempt_at FROM msgs WHERE attempt_at > {AT} AND attempts > 0")
def q421_inflight(spark, d):
    return q.inflight(ad.messages(spark, d), now())


@query(Q + DEAD + " SELECT m.id, channel, name job_name, attempts, CAST(NULL AS TIMESTAMP) dead_lettered_at FROM msgs m LEFT JOIN payloads p ON p.id = m.id WHERE attempt_at IS NULL AND attempts <= 0 UNION ALL SELECT id, channel, name, attempts, dead_lettered_at FROM dead")
def q422_failed(spark, d):
    return q.failed(ad.messages(spark, d), ad.payloads(spark, d), dead_letters(spark, d))


@query(Q + f" SELECT channel, count(*) depth, CAST(epoch({AT} - min(created_at)) AS BIGINT) oldest_s FROM msgs WHERE attempt_at IS NOT NULL GROUP BY channel")
def q423_channel_depth(spark, d):
    return q.channel_depth(ad.messages(spark, d), now())


@query(Q + DEAD + " SELECT count(*) n, count(*) > 0 firing FROM dead")
def q424_dead_letter_alert(spark, d):
    return dead_letters(spark, d).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("firing"))


@query(Q + f" SELECT DISTINCT channel FROM msgs WHERE {READY}")
def q329_active_channels(spark, d):
    return q.active_channels(ad.messages(spark, d), now())


@query(Q + f" SELECT CAST(epoch(min(attempt_at) - {AT}) AS BIGINT) wait_s FROM msgs WHERE (after_id IS NULL OR after_id = -1) AND channel IN ('orders.3-MEDIUM', 'orders.5-LOW')")
def q328_next_wait(spark, d):
    return q.next_wait(ad.messages(spark, d), now(), ["orders.3-MEDIUM", "orders.5-LOW"])


@query(Q + f" SELECT channel, id, attempt_at FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY attempt_at, id) r FROM msgs WHERE {READY}) WHERE r <= 5")
def q309_first_of_each_channel(spark, d):
    rank = F.row_number().over(Window.partitionBy("channel").orderBy("attempt_at", "id"))
    return ad.messages(spark, d).where(q.ready(now())).withColumn("r", rank).where("r <= 5").select("channel", "id", "attempt_at")


@query(Q + CHOSEN + " SELECT c.id, commit_s IS NULL is_committed, name, payload, backoff_s FROM chosen c LEFT JOIN payloads p ON p.id = c.id")
def q405_poll_claimed(spark, d):
    return q.poll(ad.messages(spark, d), ad.payloads(spark, d), now(), 64)[0]


@query(
    Q
    + CHOSEN
    + f" SELECT id, CASE WHEN id IN (SELECT id FROM chosen) THEN CASE WHEN attempts <> 1 THEN {AT} + to_seconds(backoff_s) END ELSE attempt_at END attempt_at, CAST(attempts - CASE WHEN id IN (SELECT id FROM chosen) THEN 1 ELSE 0 END AS INT) attempts, backoff_s * CASE WHEN id IN (SELECT id FROM chosen) THEN 2 ELSE 1 END backoff_s FROM msgs"
)
def q405_poll_messages(spark, d):
    return q.poll(ad.messages(spark, d), ad.payloads(spark, d), now(), 64)[1].select("id", "attempt_at", "attempts", "backoff_s")


@query(Q + " SELECT m.id, name FROM msgs m LEFT JOIN payloads p ON p.id = m.id WHERE commit_s IS NOT NULL")
def q307_message_payload(spark, d):
    return ad.messages(spark, d).where("commit_s is not null").join(ad.payloads(spark, d), "id", "left").select("id", "name")


@query(Q + " SELECT m.id, p.name FROM msgs m LEFT JOIN payloads p ON p.id = m.id")
def q307_payload_of_every_message(spark, d):
    return ad.messages(spark, d).join(ad.payloads(spark, d), "id", "left").select("id", "name")


@query(Q + " SELECT channel, max_by(id, struct_pack(a := created_at, b := id)) tail_id FROM msgs m WHERE after_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM msgs k WHERE k.after_id = m.id) GROUP BY channel")
def q311_chain_tails(spark, d):
    return q.tails(ad.messages(spark, d))


NEW = ", nw AS (SELECT 10000000 + c_custkey id, 'orders.' || CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE 'new' END channel, 2 retries, 3 backoff_s, c_custkey % 50 delay_s, CASE WHEN c_custkey % 4 = 0 THEN 30 END commit_s, c_custkey % 3 <> 1 ordered FROM customer)"


def new_messages(spark, d):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "1-URGENT").when(k % 3 == 1, "5-LOW").otherwise("new")
    return ad.table(spark, d, "customer").select(
        (10_000_000 + k).alias("id"), F.concat(F.lit("orders."), kind).alias("channel"), F.col("c_mktsegment").alias("name"), F.lit("{}").alias("payload"), F.lit(2).alias("retries"),
        F.lit(3).cast("long").alias("backoff_s"), (k % 50).alias("delay_s"), F.when(k % 4 == 0, 30).alias("commit_s"), (k % 3 != 1).alias("ordered"),
    )


@query(
    Q
    + NEW
    + f", tl AS (SELECT channel, max_by(id, struct_pack(a := created_at, b := id)) tail_id FROM msgs m WHERE after_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM msgs k WHERE k.after_id = m.id) GROUP BY channel) SELECT id, n.channel, {AT} + to_seconds(delay_s + coalesce(commit_s, 0)) attempt_at, 3 attempts, CASE WHEN ordered THEN coalesce(lag(id) OVER (PARTITION BY n.channel, ordered ORDER BY id), tail_id, -1) END after_id FROM nw n LEFT JOIN tl ON tl.channel = n.channel"
)
def q403_insert(spark, d):
    out = q.insert(ad.messages(spark, d), ad.payloads(spark, d), new_messages(spark, d), now(), ad.id_range(F.col("id")))[0]
    return out.where("id >= 10000000").select("id", "channel", "attempt_at", "attempts", "after_id")


@query(Q + " SELECT id, CASE WHEN commit_s IS NOT NULL AND id % 2 = 0 THEN attempt_at - to_seconds(commit_s) ELSE attempt_at END attempt_at, CASE WHEN id % 2 <> 0 THEN commit_s END commit_s FROM msgs")
def q406_commit(spark, d):
    m = ad.messages(spark, d)
    return q.commit(m, m.where("id % 2 = 0").select("id")).select("id", "attempt_at", "commit_s")


@query(Q + " SELECT id, CASE WHEN after_id % 3 = 0 THEN -1 ELSE after_id END after_id FROM msgs WHERE id % 3 <> 0")
def q404_delete_unblocks(spark, d):
    m = ad.messages(spark, d)
    return q.delete(m, ad.payloads(spark, d), m.where("id % 3 = 0").select("id"))[0].select("id", "after_id")


@query(Q + " SELECT count(*) messages, (SELECT count(*) FROM payloads WHERE id IN (SELECT id FROM msgs WHERE channel <> 'orders.5-LOW')) payloads FROM msgs WHERE channel <> 'orders.5-LOW'")
def q408_clear(spark, d):
    m, p = q.clear(ad.messages(spark, d), ad.payloads(spark, d), ["orders.5-LOW"])
    return m.agg(F.count(F.lit(1)).alias("messages")).join(p.agg(F.count(F.lit(1)).alias("payloads")))


@query(
    Q
    + f" SELECT id, CASE WHEN id % 5 < 3 AND attempt_at < {AT} + to_seconds(120) THEN {AT} + to_seconds(120) ELSE attempt_at END attempt_at, CAST(CASE WHEN id % 5 < 3 AND attempt_at < {AT} + to_seconds(120) THEN commit_s + CAST(epoch({AT} + to_seconds(120)) - epoch(attempt_at) AS BIGINT) ELSE commit_s END AS BIGINT) commit_s FROM msgs"
)
def q409_keep_alive(spark, d):
    m = ad.messages(spark, d)
    return q.keep_alive(m, m.where("id % 5 < 3").select("id"), F.lit(120), now()).select("id", "attempt_at", F.col("commit_s").cast("long").alias("commit_s"))


@query(
    Q
    + f" SELECT m.id, CASE WHEN m.id % 7 = 0 THEN greatest(attempt_at, {AT} + to_seconds(300)) ELSE attempt_at END attempt_at, CAST(attempts + CASE WHEN m.id % 14 = 0 THEN 2 ELSE 0 END AS INT) attempts, CASE WHEN m.id % 21 = 0 AND payload IS NOT NULL THEN '[]' ELSE payload END payload FROM msgs m LEFT JOIN payloads p ON p.id = m.id"
)
def q410_checkpoint(spark, d):
    m = ad.messages(spark, d)
    updates = m.where("id % 7 = 0").select("id", F.lit(300).alias("seconds"), F.when(F.col("id") % 21 == 0, "[]").alias("new_payload"), F.when(F.col("id") % 14 == 0, 2).alias("extra"))
    after, own = q.checkpoint(m, ad.payloads(spark, d), updates, now())
    return after.join(own, "id", "left").select("id", "attempt_at", "attempts", "payload")


@query(Q + DEAD + f" SELECT id, channel, name, dead_lettered_at FROM dead UNION ALL SELECT m.id, channel, name, {AT} FROM msgs m JOIN payloads p ON p.id = m.id WHERE attempt_at IS NULL AND attempts <= 0 AND m.id NOT IN (SELECT id FROM dead)")
def q411_sweep_dead_letters(spark, d):
    return q.sweep(ad.messages(spark, d), ad.payloads(spark, d), dead_letters(spark, d), now())[2].select("id", "channel", "name", "dead_lettered_at")


@query(Q + ", gone AS (SELECT id FROM msgs JOIN payloads USING (id) WHERE attempt_at IS NULL AND attempts <= 0) SELECT id, CASE WHEN after_id IN (SELECT id FROM gone) THEN -1 ELSE after_id END after_id FROM msgs WHERE id NOT IN (SELECT id FROM gone)")
def q308_sweep_messages(spark, d):
    return q.sweep(ad.messages(spark, d), ad.payloads(spark, d), dead_letters(spark, d), now())[0].select("id", "after_id")


@query(Q + " SELECT id, channel, dead_lettered_at FROM (SELECT id, channel, name, created_at dead_lettered_at FROM msgs JOIN payloads USING (id) WHERE attempt_at IS NULL AND attempts <= 0) ORDER BY dead_lettered_at DESC NULLS FIRST, id LIMIT 50")
def q354_recent_dead_letters(spark, d):
    rows = ad.messages(spark, d).where(q.is_exhausted()).join(ad.payloads(spark, d), "id")
    return rows.select("id", "channel", F.col("created_at").alias("dead_lettered_at")).orderBy(F.col("dead_lettered_at").desc_nulls_first(), "id").limit(50)


@query(Q + " SELECT channel, id newest FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY created_at DESC, id DESC) r FROM msgs) WHERE r = 1")
def q352_newest_of_each_channel(spark, d):
    return ad.messages(spark, d).groupBy("channel").agg(F.max_by("id", F.struct("created_at", "id")).alias("newest"))


@query("SELECT k attempt, CAST(CASE WHEN k <= 1 THEN 0 ELSE least(60, pow(2, least(k - 2, 60))) END AS DOUBLE) wait_s, greatest(k, 1) most_attempts, greatest(k, 1) - 1 retries, k >= 5 exhausted FROM range(0, 1001) t(k)")
def q455_backoff(spark, d):
    k = F.col("id")
    return spark.range(1001).select(
        k.alias("attempt"), q.backoff_seconds(k, F.lit(1), F.lit(60)).alias("wait_s"), F.greatest(k, F.lit(1)).alias("most_attempts"), (F.greatest(k, F.lit(1)) - 1).alias("retries"), (k >= 5).alias("exhausted")
    )
