"""Static sources: the score catalog and the demo score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("beginner", "intermediate", "advanced")
_ENTRIES = (("ode", "beginner"), ("twinkle", "beginner"), ("minuet", "intermediate"), ("arabesque", "intermediate"), ("prelude", "advanced"))


def entries(spark: SparkSession) -> DataFrame:
    """(id, level, level_ord): the catalog as a small dimension."""
    return spark.createDataFrame([(i, level, LEVELS.index(level)) for i, level in _ENTRIES], "id string, level string, level_ord int")


def by_level(catalog: DataFrame) -> DataFrame:
    """(level, level_ord, n, ids) in order of level; levels without entries are absent."""
    return catalog.groupBy("level", "level_ord").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).orderBy("level_ord")


def demo_notes(spark: SparkSession, measures: int = 4, beats: int = 4, bpm: int = 80) -> DataFrame:
    """(measure_index, pitch, start_ms, duration_ms): quarter notes that sound for nine tenths of a beat."""
    beat = 60000 // bpm
    n = spark.range(measures * beats).withColumn("measure_index", F.floor(F.col("id") / beats))
    return n.select("measure_index", (60 + F.col("id") % 12).alias("pitch"), (F.col("id") * beat).alias("start_ms"), F.lit(beat * 9 // 10).cast("long").alias("duration_ms"))
