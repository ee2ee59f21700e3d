"""Which intervals hold a point, as an equi-join over nested nodes of time.

Time is cut into grains, and grains into nodes: node n of level k holds the grains from n * 16**k on, 16**k of them. An interval
is the disjoint union of nodes, at most 30 a level, or its grains where there are no more than 16, so its rows grow with the
logarithm of its length; a point lies in one node of each of the four levels. The two meet in exactly one node. On the highest
level an interval takes one row for each node: with a grain of four seconds, for each 4.6 hours.
``cover`` is the dyadic form, with the fewest rows for intervals of any length and more levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds of a grain, levels of dyadic nodes, and levels of nodes of 16.
GRAIN, LEVELS, HIGHEST = 4096, 10, 3


def cover(first: Column, end: Column, levels: int = LEVELS) -> Column:
    """The nodes (level, node) of the grains from ``first`` on and before ``end``; none where there are no grains."""
    first, end = first.cast("long"), end.cast("long")
    deepest = F.least(F.lit(levels - 1), F.ceil(F.log2(F.greatest(end - first, F.lit(1)))).cast("int"))

    def level(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -first, k), F.call_function("shiftright", end, k)
        own = low < high
        left = F.when(own & (low % 2 != 0), F.struct(k.alias("level"), low.alias("node")))
        right = F.when(own & (high % 2 != 0), F.struct(k.alias("level"), (high - 1).alias("node")))
        return F.array(left, right)

    top = F.lit(levels)
    low, high = -F.call_function("shiftright", -first, top), F.call_function("shiftright", end, top)
    nodes = F.transform(F.sequence(low, F.greatest(high - 1, low)), lambda n: F.struct(top.alias("level"), n.alias("node")))
    above = F.when(low < high, nodes).otherwise(F.filter(nodes, lambda _: F.lit(False)))
    return F.concat(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), deepest), level)), lambda x: x.isNotNull()), above)


def _shifted(x: Column, bits: int, up: bool = False) -> Column:
    """x / 2**bits, rounded down or up."""
    return -F.call_function("shiftright", -x, F.lit(bits)) if up else F.call_function("shiftright", x, F.lit(bits))


def _run(low: Column, end: Column, level: int) -> Column:
    """The nodes of a level from ``low`` on and before ``end``, as numbers whose remainder is the level."""
    step = F.lit(HIGHEST + 1).cast("long")
    return F.when(low < end, F.sequence(low * step + level, F.greatest(low, end - 1) * step + level, step)).otherwise(F.array().cast("array<bigint>"))


def nodes(first: Column, end: Column) -> Column:
    """The nodes of 16 of the grains (longs) from ``first`` on and before ``end``: one sequence where there are few grains.

    The form for many grains stands in a lambda: as generated code it is too long for the JVM to compile, and rows that do not
    take it would pay for it.
    """
    pair = F.array(F.struct(first.alias("first"), end.alias("end")))
    many = F.flatten(F.transform(pair, lambda x: _runs(x["first"], x["end"])))
    return F.when(end - first <= 16, _run(first, end, 0)).otherwise(many)


def _runs(first: Column, end: Column) -> Column:
    """The nodes of grains on every level, at most 30 a level below the highest."""
    runs = []
    for k in range(HIGHEST):
        low, high = _shifted(first, 4 * k, True), _shifted(end, 4 * k)
        left, right = _shifted(first, 4 * k + 4, True) * 16, _shifted(end, 4 * k + 4) * 16
        runs += [_run(low, F.when(left < right, left).otherwise(high), k), _run(F.when(left < right, right).otherwise(high), high, k)]
    return F.concat(*runs, _run(_shifted(first, 4 * HIGHEST, True), _shifted(end, 4 * HIGHEST), HIGHEST))


def path(grain: Column) -> Column:
    """The nodes that hold a grain, one of each level."""
    return F.array(*[_shifted(grain.cast("long"), 4 * k) * (HIGHEST + 1) + k for k in range(HIGHEST + 1)])


def met_on(left: DataFrame, right: DataFrame, on: list[str], tasks: int | None = None, how: str = "inner") -> DataFrame:
    """A join over a shuffle: Spark's estimate does not see what an explosion makes and would send it through the driver.

    With ``tasks`` both sides are dealt out into as many.
    """
    if tasks is not None:
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    return left.join(right.hint("merge"), on, how)


def stabbed(intervals: DataFrame, points: DataFrame, on: list[str], first: Column, end: Column, at: Column, grain: int = GRAIN, tasks: int | None = None, every: bool = False) -> DataFrame:
    """``points`` joined with each row of ``intervals`` of equal ``on`` whose grains hold that of ``at``, each pair once.

    An interval takes every grain that [first, end) touches: callers compare exact times of the pairs that come back. With
    ``every``, each point also comes by itself, with nulls for an interval.
    """
    grains = {"_f": F.floor(first / grain).cast("long"), "_e": F.ceil(end / grain).cast("long")}
    covered = intervals.withColumns(grains).withColumn("_n", F.explode(nodes(F.col("_f"), F.col("_e")))).drop("_f", "_e")
    held = path(F.floor(at / grain))
    if not every:
        return met_on(points.withColumn("_n", F.explode(held)), covered, [*on, "_n"], tasks).drop("_n")
    asked = points.withColumn("_n", F.explode(F.concat(held, F.array(F.lit(None).cast("long")))))
    met = met_on(asked, covered.withColumn("_met", F.lit(True)), [*on, "_n"], tasks, "left")
    return met.where("_n is null or _met").drop("_n", "_met")
