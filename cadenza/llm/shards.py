"""Sharding by longest processing time: groups that stay together go, largest first, to the least loaded shard.

The heap runs over a bounded number of parcels. A group of equal texts that is large against a shard is a parcel of its
own (there are at most ``shards * FINE`` such groups, whatever the input); all smaller groups are dealt into
``shards * FINE`` parcels by their key. So the driver sees no more than ``2 * shards * FINE`` sizes at any input, every
group stays whole, and the shards differ by no more than about one parcel, a part in FINE of a shard, unless one group
alone is larger than a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FINE = 512
ROWS_A_SLOT_RANGE = 20_000


def longest_first(sizes: list[tuple[int, str]], shards: int) -> list[tuple[str, int]]:
    """(key, shard) of each (size, key): largest first, ties by key, to the least loaded shard, ties to the lowest."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out.append((key, shard))
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_by_bytes(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``bytes``.

    Size is the UTF-8 bytes of the text plus 1. A null text counts as the empty one, in its group as well. Rows with
    equal ids are all placed; ids may be null. Slots number the rows of a shard from 0 without gaps. An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        df.select(
            F.col(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("_group"),
        )
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least = max(1, total // (shards * FINE))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    small = F.concat(F.lit("p"), F.pmod(F.conv(F.substring("_group", 1, 8), 16, 10).cast("long"), F.lit(shards * FINE)).cast("string"))
    large = groups.where(F.col("_bytes") >= least).select("_group", F.lit(True).alias("_large"))
    parcel = F.when(F.col("_large"), F.col("_group")).otherwise(small)
    # at most shards * FINE large groups by their definition, so this side may be broadcast
    dealt = rows.join(F.broadcast(large), "_group", "left").withColumn("_parcel", parcel)
    parcels = dealt.groupBy("_parcel").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n")).collect()
    placed = dict(longest_first([(r["_bytes"], r["_parcel"]) for r in parcels], shards))
    # a parcel's rows are numbered in ranges of about ROWS_A_SLOT_RANGE rows, so that no large group meets in one task
    plan = spark.createDataFrame(
        [(r["_parcel"], placed[r["_parcel"]], 1 + r["_n"] // ROWS_A_SLOT_RANGE) for r in parcels],
        "_parcel string, shard int, _ranges long",
    )
    dealt = dealt.join(F.broadcast(plan), "_parcel").withColumn("_range", F.pmod(F.xxhash64(id_col), F.col("_ranges")))
    ranges = dealt.groupBy("shard", "_parcel", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_parcel", "_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_parcel", "_range", F.coalesce(before, F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_parcel", "_range").orderBy(F.col(id_col).asc_nulls_first(), "_group")) - 1
    return (
        dealt.withColumn("_inside", inside)
        .join(ranges, ["_parcel", "_range"])
        .select(
            id_col,
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_first") + F.col("_inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
