"""Connected components of a table of links, by minimum labels and pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c) for every end of a link: c is the smallest id reachable. Null ends are dropped; loops and repeats are harmless."""
    pairs = links.select(F.col(a).alias("v"), F.col(b).alias("w")).where("v is not null and w is not null")
    edges = stored(pairs.union(pairs.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct())
    labels = stored(edges.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c")))
    while True:
        seen = edges.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("c").alias("near"))
        nearer = labels.join(seen, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = nearer.join(labels.select(F.col("v").alias("c"), F.col("c").alias("far")), "c")
        moved = stored(jump.select("v", "old", F.least("c", "far").alias("c")))
        release(labels)
        labels = moved.select("v", "c")
        labels._stored_path = moved._stored_path
        if moved.where("c <> old").isEmpty():
            release(edges)
            return labels
