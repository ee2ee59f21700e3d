"""Order over whole keys without one task for each key: rows are cut into ranges, and the ranges' borders are carried over.

A range is a (key, span), where ``span`` is a column that does not fall as the order rises, such as the order divided by some
thousands. A range is sorted in one task and leaves one row of carried values; only these rows are sorted by key as a whole. So a
key of any number of rows, even the whole table, is scanned in as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range holds where orders are dense numbers.
RANGE = 4096


def by_number(order: Column, rows: int = RANGE) -> Column:
    """The range of a number."""
    return F.floor(order / rows)


def scanned(rows: DataFrame, keys: list[str], order: list[str], span: Column, sums: dict[str, Column] = {}, lasts: dict[str, Column] = {}, inclusive: bool = True, tasks: int | None = None) -> DataFrame:  # noqa: B006
    """``rows`` with running sums and last known values of their key, in the given order, new columns by name.

    A sum counts nulls as nothing and starts from 0; a last value is the latest that is not null, null before the first. With
    ``inclusive`` the row itself counts. Both are what one window over the key would give, for exact types; sums of doubles are
    added up range by range. Rows with a null key are of no key: their new columns are null, and they do not meet. ``tasks``: ranges,
    and the borders of keys, are dealt out into as many.
    """
    given = [F.col(k).isNotNull() for k in keys]
    keyed = given[0]
    for x in given[1:]:
        keyed = keyed & x
    cut = rows.where(keyed).withColumns({"_span": span, **{f"_x_{n}": x for n, x in (sums | lasts).items()}})
    on = [*keys, "_span"]
    if tasks is not None:
        cut = cut.repartition(tasks, *on)
    totals = cut.groupBy(*on).agg(
        *[F.sum(f"_x_{n}").alias(f"_c_{n}") for n in sums],
        *[F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), F.struct(*order))).alias(f"_c_{n}") for n in lasts],
    )
    if tasks is not None:
        totals = totals.repartition(tasks, *keys)
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*on, *[F.sum(f"_c_{n}").over(earlier).alias(f"_b_{n}") for n in sums], *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in lasts])
    near = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumns({**{f"_n_{n}": F.sum(f"_x_{n}").over(near) for n in sums}, **{f"_n_{n}": F.last(f"_x_{n}", ignorenulls=True).over(near) for n in lasts}})
    zero = F.lit(0)
    met = local.join(carried, on).withColumns({**{n: F.coalesce(f"_b_{n}", zero) + F.coalesce(f"_n_{n}", zero) for n in sums}, **{n: F.coalesce(f"_n_{n}", f"_b_{n}") for n in lasts}})
    out = met.select(*rows.columns, *sums, *lasts)
    if not any(rows.schema[k].nullable for k in keys):
        return out
    return out.unionByName(rows.where(~keyed), allowMissingColumns=True)


def with_previous(rows: DataFrame, key: str, order: str, span: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the ``order`` of the row before it among those of its key, null for the first.

    Rows without a key or an order have no row before them; they are not sorted and do not meet.
    """
    met = F.col(key).isNotNull() & F.col(order).isNotNull()
    near = F.lag(order).over(Window.partitionBy(key, "_span").orderBy(order))
    cut = rows.where(met).withColumn("_span", span)
    lasts = cut.groupBy(F.col(key).alias("_key"), F.col("_span").alias("_at")).agg(F.max(order).alias("_last"))
    lasts = lasts.withColumn("_border", F.lag("_last").over(Window.partitionBy("_key").orderBy("_at"))).drop("_last")
    found = cut.withColumn("_near", near).join(lasts, (F.col(key) == F.col("_key")) & (F.col("_span") == F.col("_at")), "left")
    found = found.withColumn(name, F.coalesce("_near", "_border")).select(*rows.columns, name)
    return found.unionByName(rows.where(~met), allowMissingColumns=True)
