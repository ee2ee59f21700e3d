"""The job queue as pure table transitions: every function takes tables and ``now`` and returns new tables.

A messages table has (id, channel, created_at, attempt_at, attempts, backoff_s, after_id, commit_s). ``after_id`` is null
for unordered messages, NIL at the head of an ordered chain, else the id of the message before. ``attempt_at`` is null for
messages that never run again. Payloads have (id, name, payload).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import uuid_v4
from .ranges import by_number, scanned, with_previous

NIL = -1


def later(now: Column, seconds: Column) -> Column:
    """``now`` and some seconds; works for zoned and unzoned time."""
    return now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def blocked(after: Column) -> Column:
    """Whether a message waits for one before it: null and NIL do not."""
    return after.isNotNull() & (after != NIL)


def ready(now: Column) -> Column:
    return (F.col("attempt_at") <= now) & ~blocked(F.col("after_id"))


def pending(msgs: DataFrame, now: Column) -> DataFrame:
    return msgs.where(F.col("commit_s").isNull() & ready(now)).select("id", "channel", "attempts", "created_at", "attempt_at")


def inflight(msgs: DataFrame, now: Column) -> DataFrame:
    return msgs.where((F.col("attempt_at") > now) & (F.col("attempts") > 0)).select("id", "channel", "attempts", "created_at", "attempt_at")


def is_exhausted() -> Column:
    return F.col("attempt_at").isNull() & (F.col("attempts") <= 0)


def failed(msgs: DataFrame, payloads: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, channel, job_name, attempts, dead_lettered_at): exhausted messages and the dead-letter store."""
    live = msgs.where(is_exhausted()).join(payloads, "id", "left")
    live = live.select("id", "channel", F.col("name").alias("job_name"), "attempts", F.lit(None).cast(dead.schema["dead_lettered_at"].dataType).alias("dead_lettered_at"))
    return live.unionByName(dead.select("id", "channel", F.col("name").alias("job_name"), "attempts", "dead_lettered_at"))


def channel_depth(msgs: DataFrame, now: Column) -> DataFrame:
    """(channel, depth, oldest_s) of messages that may still run."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.min("created_at").cast("timestamp"))
    return msgs.where("attempt_at is not null").groupBy("channel").agg(F.count(F.lit(1)).alias("depth"), age.alias("oldest_s"))


def active_channels(msgs: DataFrame, now: Column, channels: list[str] | None = None) -> DataFrame:
    rows = msgs.where(ready(now))
    if channels is not None:
        rows = rows.where(F.col("channel").isin(channels))
    return rows.select("channel").distinct()


def choose(msgs: DataFrame, now: Column, batch: int, channels: list[str] | None = None) -> DataFrame:
    """At most ``batch`` ready messages of each of ``batch`` channels, and ``batch`` altogether, the earliest first.

    Channels are taken in order of their name, where a queue server would take random ones. The partial limit per channel
    is a ranked top-n, which Spark applies before and after the exchange.
    """
    names = active_channels(msgs, now, channels).orderBy("channel").limit(batch)
    rows = msgs.where(ready(now)).join(names, "channel", "left_semi")
    rank = F.row_number().over(Window.partitionBy("channel").orderBy("attempt_at", "id"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= batch).orderBy("channel", "_rank").limit(batch).drop("_rank")


def poll(msgs: DataFrame, payloads: DataFrame, now: Column, batch: int, channels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(claimed, messages after): claimed has (id, is_committed, name, payload, backoff_s) with the backoff before doubling."""
    chosen = choose(msgs, now, batch, channels)
    claimed = chosen.join(payloads, "id", "left").select("id", F.col("commit_s").isNull().alias("is_committed"), "name", "payload", "backoff_s")
    hit = F.col("_claimed").isNotNull()
    after = msgs.join(chosen.select("id", F.lit(True).alias("_claimed")), "id", "left").withColumns(
        {
            "attempt_at": F.when(hit & (F.col("attempts") == 1), None).when(hit, later(now, F.col("backoff_s"))).otherwise(F.col("attempt_at")),
            "attempts": F.when(hit, F.col("attempts") - 1).otherwise(F.col("attempts")),
            "backoff_s": F.when(hit, F.col("backoff_s") * 2).otherwise(F.col("backoff_s")),
        }
    )
    return claimed, after.select(*msgs.columns)


def next_wait(msgs: DataFrame, now: Column, channels: list[str] | None = None) -> DataFrame:
    """(wait_s): seconds to the earliest attempt, for a poll that found nothing."""
    rows = msgs.where(~blocked(F.col("after_id")))
    if channels is not None:
        rows = rows.where(F.col("channel").isin(channels))
    return rows.agg((F.unix_timestamp(F.min("attempt_at").cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))).alias("wait_s"))


def tails(msgs: DataFrame) -> DataFrame:
    """(channel, tail_id): the newest message of each ordered chain that no other points at."""
    chain = msgs.where("after_id is not null")
    pointed = msgs.where("after_id is not null").select(F.col("after_id").alias("id"))
    return chain.join(pointed, "id", "left_anti").groupBy("channel").agg(F.max_by("id", F.struct("created_at", "id")).alias("tail_id"))


def insert(msgs: DataFrame, payloads: DataFrame, new: DataFrame, now: Column, span: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Append ``new`` (id, channel, name, payload, retries, backoff_s, delay_s, commit_s, ordered).

    An ordered message follows the one before it in the batch (by id), the first one the tail of its channel, or NIL.
    ``span`` cuts batches of one channel into ranges of ids, which must not fall as ids rise: by default thousands of numbers.
    """
    new = new.withColumn("_chain", F.when(F.col("ordered"), F.col("channel")))
    before = F.col("_before")
    rows = with_previous(new, "_chain", "id", by_number(F.col("id")) if span is None else span, "_before").join(tails(msgs), "channel", "left").select(
        "id", "channel",
        now.alias("created_at"),
        later(now, F.col("delay_s") + F.coalesce("commit_s", F.lit(0))).alias("attempt_at"),
        (F.col("retries") + 1).alias("attempts"),
        "backoff_s",
        F.when(F.col("ordered"), F.coalesce(before, "tail_id", F.lit(NIL))).alias("after_id"),
        "commit_s",
    )
    return msgs.unionByName(rows.select(*[F.col(c).cast(msgs.schema[c].dataType) for c in msgs.columns])), payloads.unionByName(new.select(*payloads.columns))


def commit(msgs: DataFrame, ids: DataFrame) -> DataFrame:
    hit = F.col("_hit").isNotNull() & F.col("commit_s").isNotNull()
    return _marked(msgs, ids).withColumn("attempt_at", F.when(hit, later(F.col("attempt_at"), -F.col("commit_s"))).otherwise(F.col("attempt_at"))).withColumn("commit_s", F.when(~hit, F.col("commit_s"))).select(*msgs.columns)


def delete(msgs: DataFrame, payloads: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the messages ``ids``; what waited for one of them becomes the head of its chain."""
    left = msgs.join(ids, "id", "left_anti")
    gone = ids.select(F.col("id").alias("after_id"), F.lit(True).alias("_gone")).distinct()
    left = left.join(gone, "after_id", "left").withColumn("after_id", F.when(F.col("_gone"), F.lit(NIL)).otherwise(F.col("after_id")))
    return left.select(*msgs.columns), payloads.join(ids, "id", "left_anti")


def clear(msgs: DataFrame, payloads: DataFrame, channels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the messages of some channels, or of all."""
    gone = msgs if channels is None else msgs.where(F.col("channel").isin(channels))
    return delete(msgs, payloads, gone.select("id"))


def _marked(msgs: DataFrame, ids: DataFrame) -> DataFrame:
    return msgs.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")


def keep_alive(msgs: DataFrame, ids: DataFrame, seconds: Column, now: Column) -> DataFrame:
    """Move earlier attempts to ``now`` and ``seconds``; an open commit interval grows by as much."""
    until = later(now, seconds)
    hit = F.col("_hit").isNotNull() & (F.col("attempt_at") < until)
    moved = F.unix_timestamp(until.cast("timestamp")) - F.unix_timestamp(F.col("attempt_at").cast("timestamp"))
    rows = _marked(msgs, ids).withColumn("commit_s", F.when(hit, F.col("commit_s") + moved).otherwise(F.col("commit_s")))
    return rows.withColumn("attempt_at", F.when(hit, until).otherwise(F.col("attempt_at"))).select(*msgs.columns)


def checkpoint(msgs: DataFrame, payloads: DataFrame, updates: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Apply ``updates`` (id, seconds, new_payload, extra): later attempt, more attempts, payload where one is given.

    Several updates of one id count together: the longest delay, all extra attempts, the greatest payload text.
    """
    updates = updates.groupBy("id").agg(F.max("seconds").alias("seconds"), F.max("new_payload").alias("new_payload"), F.sum("extra").cast("int").alias("extra"))
    rows = msgs.join(updates.select("id", "seconds", "extra", F.lit(True).alias("_hit")), "id", "left")
    rows = rows.withColumn("attempt_at", F.when(F.col("_hit"), F.greatest("attempt_at", later(now, F.col("seconds")))).otherwise(F.col("attempt_at")))
    rows = rows.withColumn("attempts", F.col("attempts") + F.coalesce("extra", F.lit(0)))
    own = payloads.join(updates.select("id", "new_payload"), "id", "left").withColumn("payload", F.coalesce("new_payload", "payload"))
    return rows.select(*msgs.columns), own.select(*payloads.columns)


def sweep(msgs: DataFrame, payloads: DataFrame, dead: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exhausted messages with a payload go to the dead letters, once each: (messages, payloads, dead letters) after."""
    spent = msgs.where(is_exhausted()).join(payloads, "id").select("id", "channel", "name", "payload", "attempts", now.cast(dead.schema["dead_lettered_at"].dataType).alias("dead_lettered_at"))
    fresh = spent.join(dead.select("id"), "id", "left_anti")
    after, own = delete(msgs, payloads, spent.select("id"))
    return after, own, dead.unionByName(fresh.select(*dead.columns))


def backoff_seconds(attempt: Column, base: Column, most: Column) -> Column:
    """0 before the second attempt, then doubling from ``base``, ``most`` at most."""
    grown = base * F.pow(F.lit(2.0), F.least(F.greatest(attempt - 2, F.lit(0)), F.lit(200)))
    return F.when(attempt <= 1, F.lit(0.0)).otherwise(F.least(F.greatest(most, base).cast("double"), grown))


#: Known kinds of jobs: channel, whether ordered, attempts, first and longest wait in seconds.
JOB_SPECS = (("verification_email", "auth.email", False, 5, 10, 3600), ("orphan_reap", "user.reap", False, 3, 30, 600))


def job_specs(spark) -> DataFrame:
    return spark.createDataFrame(list(JOB_SPECS), "name string, channel string, ordered boolean, attempts int, base_s long, most_s long")


def planned(jobs: DataFrame, specs: DataFrame) -> DataFrame:
    """``jobs`` (id, name, payload) of known kinds as the rows that ``insert`` takes, with the defaults of their kind."""
    rows = jobs.join(F.broadcast(specs), "name")  # a handful of kinds
    return rows.select("id", "channel", "name", "payload", F.greatest(F.col("attempts") - 1, F.lit(0)).alias("retries"), F.col("base_s").alias("backoff_s"), F.lit(0).alias("delay_s"), F.lit(None).cast("int").alias("commit_s"), "ordered")


def retry_policy(attempts: Column, base: Column, most: Column) -> dict[str, Column]:
    """A policy's numbers within their bounds: one attempt at least, the longest wait no shorter than the first."""
    tries = F.greatest(attempts, F.lit(1))
    return {"attempts": tries, "retries": tries - 1, "most": F.greatest(most, base)}


def swept_count(msgs: DataFrame, payloads: DataFrame, dead: DataFrame) -> DataFrame:
    """(moved): how many messages a sweep adds to the dead letters."""
    spent = msgs.where(is_exhausted()).join(payloads.select("id"), "id", "left_semi")
    return spent.join(dead.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("moved"))


def run_once(claimed: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work, done after): claimed jobs, once each, that the ledger ``done`` (id) lacks; a job claimed again is not run again."""
    work = claimed.dropDuplicates(["id"]).join(done.select("id"), "id", "left_anti")
    return work, done.select("id").union(work.select("id"))


def enqueued(jobs: DataFrame, specs: DataFrame, seed: str, now: Column) -> DataFrame:
    """Message rows of ``jobs`` (key, name, payload, delay_s) of known kinds, with an id of their own, ready at once or after their delay.

    ``key`` tells jobs apart; equal seed and key give the equal id, so a task that runs again adds no second message. Jobs of one
    enqueue call do not wait for each other.
    """
    rows = jobs.join(F.broadcast(specs), "name")  # a handful of kinds
    return rows.select(
        uuid_v4(seed, F.col("key").cast("string")).alias("id"), "channel", F.lit("").alias("channel_args"), now.alias("created_at"),
        later(now, F.coalesce("delay_s", F.lit(0))).alias("attempt_at"),
        F.greatest(F.col("attempts"), F.lit(1)).alias("attempts"), F.col("base_s").alias("backoff_s"),
        F.lit(None).cast("int").alias("commit_s"), "name", "payload",
    )


def decoded(payloads: DataFrame, fields: dict[str, str], text: str = "payload") -> DataFrame:
    """``payloads`` with ``bad``, whether the text is no JSON object, and a typed column for each of ``fields`` (name: type).

    A field that is absent or of another type is null and does not make a row bad; a null text is not bad. Texts are parsed once.
    """
    parsed = payloads.withColumn("_v", F.try_parse_json(text))
    is_object = F.schema_of_variant("_v").startswith("OBJECT<")
    bad = F.col(text).isNotNull() & ~F.coalesce(is_object, F.lit(False))
    return parsed.withColumns({"bad": bad, **{n: F.try_variant_get("_v", f"$.{n}", t) for n, t in fields.items()}}).drop("_v")


def channels_in_turn(channels: DataFrame, seed: str, most: int) -> DataFrame:
    """The first ``most`` channels in an order that the seed shuffles: another seed for each poll, the same at every run of it."""
    return channels.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "channel").cast("binary")), "channel").limit(most)


#: Least and greatest number of jobs that a worker runs at once.
CONCURRENCY = (1, 16)


def worker_rounds(claimed: DataFrame, concurrency: int) -> DataFrame:
    """(id, round, slot) of claimed jobs (id) in order of ids: a worker starts a round of at most ``concurrency`` jobs at a time.

    The number is taken within its bounds. Jobs are numbered range by range, so that no task sorts all of them.
    """
    width = max(CONCURRENCY[0], min(CONCURRENCY[1], concurrency))
    rows = claimed.select("id", F.lit(0).alias("_all"))
    numbered = scanned(rows, ["_all"], ["id"], by_number(F.col("id")), sums={"_n": F.lit(1)}, inclusive=False)
    return numbered.select("id", F.floor(F.col("_n") / width).alias("round"), (F.col("_n") % width).cast("int").alias("slot"))
