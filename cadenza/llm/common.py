"""Shared helpers of the corpus operators: table access, Arrow mapping, persistence in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SLICE = 512
_RESIDENT: dict = {}


def resident(key: tuple, build: Callable):
    """What ``build`` made for ``key``: a Python worker holds one such object at a time, so stages do not add up in memory."""
    if key not in _RESIDENT:
        vacate()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def vacate() -> None:
    """Forget the object an earlier stage left in this Python worker; tasks with large tables of their own begin with it."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()


def map_arrow(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., list]], schema: str, rows: int = SLICE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Map batches of ``columns`` to the columns of ``schema``, behind the columns ``keep``, which pass as they are.

    ``make`` runs once per task and returns the function applied to each slice of ``rows`` rows; it takes one Python
    list per input column and returns one list per output column. Slices keep memory bounded: nothing is kept between
    them but what ``make`` holds.
    """
    new = df.sparkSession.createDataFrame([], schema).schema
    out = StructType([*[df.schema[c] for c in keep], *new.fields])
    n, arrow = len(columns), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for part in (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)):
            passed = [part.column(n + i) for i in range(len(keep))]
            made = fn(*[part.column(i).to_pylist() for i in range(n)])
            made = [pa.array(c, type=f.type) for c, f in zip(made, list(arrow)[len(keep) :])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip([*passed, *made], arrow)], schema=arrow)

    return df.select(*map(quoted, columns), *map(quoted, keep)).mapInArrow(run, out)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, **own: Column) -> DataFrame:
    """``df`` as one column ``_row`` beside the columns ``own``, so that no name of a table clashes with an operator's."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row"), *[c.alias(k) for k, c in own.items()])


def restored(rows: DataFrame, df: DataFrame, new: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """The columns of ``df`` out of ``rows``; those of ``new`` replace columns of their name or come last."""
    own = {c.lower(): c for c in new}
    old = [new[own[c.lower()]].alias(c) if c.lower() in own else F.col("_row").getField(c).alias(c) for c in df.columns]
    have = {c.lower() for c in df.columns}
    return rows.select(*old, *[v.alias(c) for c, v in new.items() if c.lower() not in have])


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares, as the session names it; an own one only in a single local process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("corpus operators need a folder that all executors share: set spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


#: Lets Spark delete the shuffle files of a query as soon as its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` as a table dealt out and sorted by ``keys`` and read it back: joins on them need no exchange.

    The table lies in the shared folder; the warehouse only knows its name.
    """
    spark = df.sparkSession
    name, path = f"corpus_{uuid.uuid4().hex}", f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.bucketBy(parts, *keys).sortBy(*keys).options(compression="zstd", path=path).format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.table(name)
    out._stored_path, out._stored_name = path, name
    return out


def release(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        if name := getattr(df, "_stored_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class WordHash(dict):
    """bytes -> 64-bit hash, remembered up to a bound; the bound changes speed only."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h
