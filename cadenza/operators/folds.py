"""Folds over each key's rows in order, with a small state carried from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, key: str | list[str], order: str | list[str], values: list[str], start: Callable[[], list], step: Callable[..., tuple], schema: str, tasks: int | None = None) -> DataFrame:
    """(key columns, order columns, columns of ``schema``): one row for each of ``rows``.

    ``step`` takes the key's state, which it may change, the row's order and its ``values``, and returns the new columns.
    Rows are dealt out by key, sorted by Spark, which may spill, and stream through in Arrow batches: a task holds one
    batch and one key's state, however many rows a key has. Repeats of one (key, order) come in no fixed order.
    ``tasks``: keys are dealt out into as many.
    """
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    kept = [*keys, *orders]
    new = rows.sparkSession.createDataFrame([], schema).schema
    out = StructType([*[rows.schema[c] for c in kept], *new.fields])
    arrow, n = to_arrow_schema(out), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), []
        for batch in batches:
            columns, made = [c.to_pylist() for c in batch.columns], []
            for k, row in zip(zip(*columns[:n]), zip(*columns[n:])):
                if k != at:
                    at, state = k, start()
                made.append(step(state, *row))
            found = [pa.array(c, type=f.type) for c, f in zip(zip(*made), list(arrow)[len(kept) :])] if made else [pa.nulls(0, f.type) for f in list(arrow)[len(kept) :]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))], *found], schema=arrow)

    dealt = rows.select(*kept, *values)
    dealt = dealt.repartition(*keys) if tasks is None else dealt.repartition(tasks, *keys)
    return dealt.sortWithinPartitions(*kept).mapInArrow(run, out)
