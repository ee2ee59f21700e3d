"""Deterministic views that give the relational test tables the shape of scores, messages, accounts and telemetry.

Each Spark view has its SQL twin as common table expressions, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import score
from ..operators.ranges import with_previous


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that one task sorts by document, order or place.
LINES = 400_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks lines are dealt out: no task grows with the table, whatever the session's number is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // LINES))


DIVISIONS, BEATS, BEAT_TYPE = 4, 4, 4


def bpm():
    return F.lit(60) + F.col("doc") % 120


def note_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as measures of a customer's score, their lines as notes, without positions."""
    n = tasks(spark, sf_dir)
    orders, lines = table(spark, sf_dir, "orders").repartition(n, "o_custkey"), table(spark, sf_dir, "lineitem").repartition(n, "l_orderkey")
    measures = orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("doc"),
        (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).alias("measure_index"),
    )
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.row_number().over(order).alias("note_seq"))
    return lines.join(measures.hint("merge"), lines["l_orderkey"] == measures["o_orderkey"]).select(
        "doc", "measure_index", "note_seq",
        (1 + F.col("l_suppkey") % 2).cast("int").alias("staff"),
        F.col("l_quantity").cast("int").alias("dur"),
        (21 + F.col("l_partkey") % 88).alias("pitch"),
        ((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 7 == 0)).alias("is_rest"),
        ((F.col("l_returnflag") == "A") & (F.col("note_seq") > 1)).alias("is_chord"),
    )


def notes(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``note_events`` with positions by windows: without backups no cursor falls below 0, so sums are exact.

    ``dealt``: rows are dealt out by document, so that windows over documents need no further exchange; else by measure.
    """
    before = Window.partitionBy("doc", "measure_index").orderBy("note_seq").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("doc", "measure_index").orderBy("note_seq").rowsBetween(Window.unboundedPreceding, 0)
    moves = F.when(~F.col("is_chord"), F.col("dur"))
    cursor = F.coalesce(F.sum(moves).over(before), F.lit(0))
    back = F.when(F.col("is_chord"), F.last(moves, ignorenulls=True).over(until)).otherwise(0)
    events = note_events(spark, sf_dir)
    events = events.repartition(tasks(spark, sf_dir), *(["doc"] if dealt else ["doc", "measure_index"]))
    return events.withColumn("pos", (cursor - back).cast("long"))


NOTES_SQL = """WITH mm AS (SELECT o_orderkey, o_custkey doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 measure_index FROM orders),
ll AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) note_seq FROM lineitem),
n0 AS (SELECT doc, measure_index, note_seq, CAST(1 + l_suppkey % 2 AS INT) staff, CAST(l_quantity AS INT) dur, 21 + l_partkey % 88 pitch,
  (l_linestatus = 'F' AND l_partkey % 7 = 0) is_rest, (l_returnflag = 'A' AND note_seq > 1) is_chord FROM ll JOIN mm ON l_orderkey = o_orderkey),
n1 AS (SELECT *, coalesce(sum(CASE WHEN NOT is_chord THEN dur END) OVER (PARTITION BY doc, measure_index ORDER BY note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) cur,
  last_value(CASE WHEN NOT is_chord THEN dur END IGNORE NULLS) OVER (PARTITION BY doc, measure_index ORDER BY note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) lastd FROM n0),
a_notes AS (SELECT doc, measure_index, note_seq, staff, dur, pitch, is_rest, is_chord, CAST(cur - CASE WHEN is_chord THEN lastd ELSE 0 END AS BIGINT) pos FROM n1)"""


def spans(n: DataFrame) -> DataFrame:
    return score.measure_spans(n, F.lit(DIVISIONS * BEATS * 4 // BEAT_TYPE))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.timed(score.placed_notes(notes(spark, sf_dir), F.lit(DIVISIONS * BEATS * 4 // BEAT_TYPE)), bpm(), F.lit(DIVISIONS))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).where("end_at is not null").select("doc", "measure_index", "note_seq", "pitch", "staff", "start_ms", "duration_ms", "end_at")


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, measure_index, start_ms, song_end): measure starts of the documents that have sounding notes."""
    end = F.max("end_at").over(Window.partitionBy("doc"))
    rows = _placed(spark, sf_dir).withColumn("song_end", end).where("song_end is not null")
    at = F.round(F.first("start_div") * ((F.lit(60000.0) / bpm()) / F.lit(DIVISIONS))).cast("long")
    return rows.groupBy("doc", "measure_index").agg(at.alias("start_ms"), F.first("song_end").alias("song_end"))


PROBES_SQL = "probes AS (SELECT DISTINCT doc, CAST(k * 7500 AS BIGINT) t FROM timed, range(0, 9) r(k))"
PROBES_TO_THE_END_SQL = "probes AS (SELECT DISTINCT doc, CAST(floor(song_end * k / 8) AS BIGINT) t FROM ends, range(0, 9) r(k))"
TIMED_SQL = (
    NOTES_SQL
    + """,
sp AS (SELECT doc, measure_index, greatest(16, max(pos + dur)) span FROM a_notes GROUP BY ALL),
ms AS (SELECT *, CAST(coalesce(sum(span) OVER (PARTITION BY doc ORDER BY measure_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) start_div FROM sp),
timed AS (SELECT doc, measure_index, note_seq, pitch, staff, CAST(round((start_div + pos) * ((60000.0::DOUBLE / (60 + doc % 120)) / 4)) AS BIGINT) start_ms,
  CAST(round(dur * ((60000.0::DOUBLE / (60 + doc % 120)) / 4)) AS BIGINT) duration_ms,
  (start_div + pos) * ((60000.0::DOUBLE / (60 + doc % 120)) / 4) + dur * ((60000.0::DOUBLE / (60 + doc % 120)) / 4) end_at
  FROM a_notes JOIN ms USING (doc, measure_index) WHERE NOT is_rest),
ends AS (SELECT doc, max(end_at) song_end FROM timed GROUP BY doc),
starts AS (SELECT doc, measure_index, CAST(round(start_div * ((60000.0::DOUBLE / (60 + doc % 120)) / 4)) AS BIGINT) start_ms, song_end FROM ms JOIN ends USING (doc)),
"""
    + PROBES_SQL
)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine questions per document with a sounding note, every 7.5 seconds; needs neither positions nor times."""
    n = tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").where("not (l_linestatus = 'F' and l_partkey % 7 = 0)").select("l_orderkey").repartition(n, "l_orderkey")
    docs = table(spark, sf_dir, "orders").repartition(n, "o_orderkey").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("doc")).distinct()
    return docs.withColumn("t", F.explode(F.expr("sequence(0L, 60000L, 7500L)")))


def probes_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine questions per document with a sounding note, from its start to its end."""
    ends = timed(spark, sf_dir).groupBy("doc").agg(F.max("end_at").alias("song_end"))
    return ends.select("doc", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.floor(F.col("song_end") * k / 8))).alias("t")).distinct()


NOW = "timestamp'1998-06-01 00:00:00'"


def id_range(key):
    """Ranges of ids that one task can sort."""
    return F.floor(key / 4096)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queue messages; two priorities are ordered channels. Ids are strings, 'nil' marks a chain's head."""
    o = table(spark, sf_dir, "orders")
    ordered = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    o = with_previous(o.withColumn("chain", F.when(ordered, F.col("o_orderpriority"))), "chain", "o_orderkey", id_range(F.col("o_orderkey")), "before")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("orders."), "o_orderpriority").alias("channel"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "O", F.col("o_orderdate")).when(status == "P", F.expr(f"{NOW} + interval 1 hour")).cast("timestamp_ntz").alias("attempt_at"),
        F.when(status == "O", 5).when(status == "P", 3).otherwise(0).alias("attempts"),
        (1 + F.col("o_orderkey") % 4).alias("backoff_s"),
        F.when(ordered, F.coalesce("before", F.lit(-1))).alias("after_id"),
        F.when(F.col("o_orderkey") % 11 == 0, 60).alias("commit_s"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.where("o_orderkey % 97 <> 0").join(c, o["o_custkey"] == c["c_custkey"])
    return rows.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("name"), F.to_json(F.struct(F.col("o_custkey").alias("customer"))).alias("payload"))


QUEUE_SQL = """WITH msgs AS (SELECT o_orderkey id, 'orders.' || o_orderpriority channel, o_orderdate created_at,
  CAST(CASE o_orderstatus WHEN 'O' THEN o_orderdate WHEN 'P' THEN timestamp '1998-06-01 01:00:00' END AS TIMESTAMP) attempt_at,
  CASE o_orderstatus WHEN 'O' THEN 5 WHEN 'P' THEN 3 ELSE 0 END attempts, 1 + o_orderkey % 4 backoff_s,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN coalesce(lag(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey), -1) END after_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 60 END commit_s FROM orders),
payloads AS (SELECT o_orderkey id, c_mktsegment name, '{"customer":' || o_custkey || '}' payload FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 97 <> 0)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts; some without a handle, some whose handle equals the previous customer's."""
    k = F.col("c_custkey")
    handle = F.when(k % 5 == 0, None).when(k % 10 == 3, F.concat(F.lit("Cust"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("Cust"), k.cast("string")))
    created = F.date_add(F.lit("1995-01-01").cast("date"), k.cast("int")).cast("timestamp_ntz")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("display_name"), handle.alias("handle"), F.lower(handle).alias("handle_key"), created.alias("created_at"), (1 + k % 3).alias("version"), "c_nationkey")


USERS_SQL = """WITH users AS (SELECT c_custkey id, c_name display_name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 10 = 3 THEN 'Cust' || (c_custkey - 1) ELSE 'Cust' || c_custkey END handle,
  lower(CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 10 = 3 THEN 'Cust' || (c_custkey - 1) ELSE 'Cust' || c_custkey END) handle_key,
  CAST(DATE '1995-01-01' + CAST(c_custkey AS INT) AS TIMESTAMP) created_at, 1 + c_custkey % 3 version, c_nationkey FROM customer)"""


def midi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw MIDI messages of a user's stream."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "view"), 0x90).when(kind == "purchase", 0x80).otherwise(0xB0) + F.col("user_id") % 16
    return e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), "ts", status.cast("int").alias("status"), (21 + F.col("event_id") % 88).cast("int").alias("data1"), (F.floor("value") % 128).cast("int").alias("data2"))


MIDI_SQL = """WITH midi AS (SELECT user_id stream, event_id seq, ts,
  CAST(CASE WHEN event_type IN ('click', 'view') THEN 144 WHEN event_type = 'purchase' THEN 128 ELSE 176 END + user_id % 16 AS INT) status,
  CAST(21 + event_id % 88 AS INT) data1, CAST(CAST(floor(value) AS BIGINT) % 128 AS INT) data2 FROM events)"""
