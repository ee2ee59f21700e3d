"""Queries over schedules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import schedule as sd
from . import adapters as ad
from .registry import registry

QUERIES, SQL, query = registry()
NOW = 896_659_200  # 1998-06-01 00:00 UTC


def schedules(spark, d):
    """Suppliers as daily schedules in UTC at an hour of their key."""
    k = F.col("s_suppkey")
    return ad.table(spark, d, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("name"),
        F.format_string("%d %d * * *", (k % 60).cast("int"), (k % 24).cast("int")).alias("cron"),
        F.lit("UTC").alias("zone"),
        (k % 7 != 0).alias("enabled"),
        F.when(k % 2 == 0, "catch_up").otherwise("skip").alias("policy"),
        F.when(k % 11 != 0, F.lit(NOW) - 86400 * (k % 5) - 3600).alias("last_at"),
    )


S = f"""WITH sc AS (SELECT s_suppkey k, 's' || s_suppkey AS name, CASE WHEN s_suppkey % 11 <> 0 THEN {NOW} - 86400 * (s_suppkey % 5) - 3600 END last_at FROM supplier WHERE s_suppkey % 7 <> 0),
dy AS (SELECT k, name, CAST({NOW} - 86400 * j + (k % 24) * 3600 + (k % 60) * 60 AS BIGINT) AS due_at, last_at FROM sc, range(0, 8) r(j)),
du AS (SELECT k, name, due_at FROM dy WHERE due_at > last_at AND due_at <= {NOW}),
en AS (SELECT k, name, due_at FROM du WHERE k % 2 = 0 UNION ALL SELECT k, name, max(due_at) FROM du WHERE k % 2 <> 0 GROUP BY ALL)"""


@query(S + " SELECT name, due_at FROM en")
def q450_due(spark, d):
    return sd.due(schedules(spark, d), NOW)


@query(S + " SELECT name, due_at, name || ':' || due_at dedup_key FROM en WHERE due_at % 7 <> 0")
def q509_tick(spark, d):
    s = schedules(spark, d)
    ledger = sd.due(s, NOW).where("due_at % 7 = 0").select(sd.dedup_key(F.col("name"), F.col("due_at")).alias("dedup_key"))
    return sd.tick(s, ledger, NOW)[0]


@query("SELECT s_suppkey, '0 ' || (s_suppkey % 60) || ' ' || (s_suppkey % 24) || ' * * *' cron FROM supplier")
def q437_six_fields(spark, d):
    k = F.col("s_suppkey")
    return ad.table(spark, d, "supplier").select("s_suppkey", sd.six_fields(F.format_string(" %d  %d * * *", (k % 60).cast("int"), (k % 24).cast("int"))).alias("cron")).withColumn("cron", F.regexp_replace("cron", " +", " "))
