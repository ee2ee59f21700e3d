"""The scheduler as a stream: every micro-batch of ticks is one evaluation of all schedules, written once.

What a batch decides lies under its batch id: ``jobs/batch=7`` holds the occurrences that batch 7 put out, ``cursors/batch=7``
how far it looked. A batch reads only what earlier batches left. So a batch that fails half-way, or is run again after a restart,
finds the same ledger and the same cursor as before, replaces its own folder and puts out no second job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import schedule as sd

JOBS = "name string, due_at long, dedup_key string, batch long"
CURSOR = "now long, batch long"


def _earlier(spark: SparkSession, folder: str, part: str, schema: str, batch_id: int | None) -> DataFrame:
    """The rows that batches before ``batch_id`` left, or all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{folder}/{part}")
    return rows if batch_id is None else rows.where(F.col("batch") < batch_id)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(name, due_at, dedup_key, batch) of every job that was put out."""
    return _earlier(spark, folder, "jobs", JOBS, None)


def apply_batch(ticks: DataFrame, batch_id: int, schedules: DataFrame, folder: str) -> int:
    """Evaluate ``schedules`` at the latest of ``ticks`` (now): the jobs that no earlier batch put out. Returns how many.

    A schedule looks back to the last tick of an earlier batch, or to its own ``last_at``, whichever is later. An empty batch of
    ticks, or one whose ticks are not later than an earlier batch's, puts out nothing.
    """
    spark = ticks.sparkSession
    now = ticks.agg(F.max("now")).first()[0]
    if now is None:
        return 0
    before = _earlier(spark, folder, "cursors", CURSOR, batch_id).agg(F.max("now")).first()[0]
    seen = schedules if before is None else schedules.withColumn("last_at", F.greatest("last_at", F.lit(before)))
    since = seen.agg(F.min("last_at")).first()[0]  # older jobs cannot come up again
    known = _earlier(spark, folder, "jobs", JOBS, batch_id).where(F.col("due_at") > F.lit(since)).select("dedup_key")
    fresh = sd.tick(seen, known, int(now))[0]
    fresh.select("name", "due_at", "dedup_key").write.mode("overwrite").parquet(f"{folder}/jobs/batch={batch_id}")
    # the cursor comes last: without it, the batch has not been
    spark.range(1).select(F.lit(int(now)).alias("now")).write.mode("overwrite").parquet(f"{folder}/cursors/batch={batch_id}")
    return spark.read.parquet(f"{folder}/jobs/batch={batch_id}").count()


def run(ticks: DataFrame, schedules: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start the scheduler over a stream of ticks (now, in unix seconds); ``trigger`` is that of a stream's writer."""
    write = ticks.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, schedules, folder))
    return write.option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()
