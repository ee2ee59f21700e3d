"""Cron schedules: due occurrences in a zone, missed-run policy and a deduplicated scheduler tick.

A schedule has (name, cron, zone, enabled, policy, last_at): five or six fields (with seconds first), ``last_at`` in unix
seconds. A seventh field is the year. Days of the week count from 1 for Sunday to 7. Occurrences lie in (last_at, now]. A wall time that a clock change skips has no occurrence; one that it repeats
occurs once, at its first pass.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000
# fixed values: names of months and days in cron expressions
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()


def six_fields(cron: Column) -> Column:
    """A cron expression of five fields gets seconds of 0 in front."""
    bare = F.trim(cron)
    return F.when(F.size(F.split(bare, r"\s+")) == 5, F.concat(F.lit("0 "), bare)).otherwise(bare)


def _field(text: str, low: int, high: int, names: list[str] = [], first: int = 0) -> set[int]:  # noqa: B006
    def number(x: str) -> int:
        return names.index(x.lower()[:3]) + first if x.isalpha() else int(x)

    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        else:
            a, _, b = span.partition("-")
            a = number(a)
            b = number(b) if b else (high if step else a)
        if not low <= a <= b <= high:
            raise ValueError(f"bad cron field {text!r}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


class _Cron:
    """What a cron expression allows: years (None for all), months, days, days of the week, and the seconds of a day in order."""

    def __init__(self, cron: str):
        parts = cron.split()
        if len(parts) == 5:
            parts = ["0", *parts]
        if len(parts) not in (6, 7):
            raise ValueError(f"bad cron expression {cron!r}")
        self.year = _field(parts[6], 1970, 2100) if len(parts) == 7 else None
        second, minute, hour = (np.array(sorted(_field(x, 0, top))) for x, top in zip(parts, (59, 59, 23)))
        self.seconds = (hour[:, None, None] * 3600 + minute[:, None] * 60 + second).ravel()
        self.day, self.month = _field(parts[3], 1, 31), _field(parts[4], 1, 12, MONTHS, 1)
        self.weekday = {d - 1 for d in _field(parts[5], 1, 7, DAYS, 1)}

    def holds(self, x: date) -> bool:
        return (self.year is None or x.year in self.year) and x.month in self.month and x.day in self.day and (x.isoweekday() % 7) in self.weekday


_cron = lru_cache(1024)(_Cron)


@lru_cache(65_536)
def _offset(zone: str, day: int) -> int | None:
    """Seconds that a zone's clock is ahead on a day (its proleptic number); None where they change, at a full hour or between."""
    at, tz = datetime.fromordinal(day), ZoneInfo(zone)
    found = {(at + timedelta(hours=h)).replace(tzinfo=tz, fold=f).utcoffset() for h in range(25) for f in (0, 1)}
    offset = found.pop()
    return None if found or offset is None or offset.microseconds else int(offset.total_seconds())


def _changing(zone: str, day: int, seconds: np.ndarray) -> np.ndarray:
    """Unix seconds of a day on which the clock changes: skipped wall times have none, repeated ones their first pass."""
    tz, times = ZoneInfo(zone), []
    for s in seconds.tolist():
        wall = (datetime.fromordinal(day) + timedelta(seconds=s)).replace(tzinfo=tz)
        unix = int(wall.timestamp())
        if datetime.fromtimestamp(unix, UTC).astimezone(tz).replace(tzinfo=None) == wall.replace(tzinfo=None):
            times.append(unix)
    return np.array(sorted(times), "int64")


EPOCH = date(1970, 1, 1).toordinal()


def occurrence_times(cron: str, zone: str, after: int, now: int, most: int = MOST) -> np.ndarray:
    """Unix seconds t with after < t <= now, in order, the first ``most`` of them.

    Days on which the clock keeps its offset are sums of arrays; only the others go through the zone time by time.
    """
    c = _cron(cron)
    if after >= now:
        return np.zeros(0, "int64")
    tz, out, n = ZoneInfo(zone), [], 0
    first = datetime.fromtimestamp(after, tz).date().toordinal() - 1
    last = datetime.fromtimestamp(now, tz).date().toordinal() + 1
    for day in range(first, last + 1):
        if n >= most:
            break
        if c.holds(date.fromordinal(day)):
            offset = _offset(zone, day)
            times = _changing(zone, day, c.seconds) if offset is None else c.seconds + ((day - EPOCH) * 86400 - offset)
            if len(times) and (times[0] <= after or times[-1] > now):
                times = times[(times > after) & (times <= now)]
            out.append(times)
            n += len(times)
    return np.concatenate(out)[:most] if out else np.zeros(0, "int64")


def occurrences(cron: str, zone: str, after: int, now: int, most: int = MOST) -> list[int]:
    """``occurrence_times`` as a list."""
    return occurrence_times(cron, zone, after, now, most).tolist()


#: Occurrences that go out of a task at once.
BATCH = 250_000


def due(schedules: DataFrame, now: int) -> DataFrame:
    """(name, due_at) of every due occurrence under each schedule's policy: catch_up keeps all, skip the latest.

    Disabled schedules have none; without ``last_at`` nothing is made up for. A schedule with a bad expression or zone has
    none either: ``rejected`` names those. Schedules are few bytes and much work, so they are dealt out before; each comes back as
    one list of at most 10,000 times, which Spark takes apart.
    """
    arrow = pa.schema([("name", pa.string()), ("times", pa.list_(pa.int64()))])

    def batch(names: list[str], found: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, found)]).astype("int32")
        times = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), times], schema=arrow)

    def run(batches):
        for given in batches:
            names, found, n = [], [], 0
            for name, cron, zone, enabled, policy, last_at in zip(*[c.to_pylist() for c in given.columns]):
                if not enabled or last_at is None:
                    continue
                try:
                    times = occurrence_times(cron, zone, int(last_at), now)
                except (ValueError, ZoneInfoNotFoundError):
                    continue
                names.append(name)
                found.append(times if policy == "catch_up" else times[-1:])
                n += len(found[-1])
                if n >= BATCH:
                    yield batch(names, found)
                    names, found, n = [], [], 0
            if names:
                yield batch(names, found)

    n = int(schedules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = schedules.select(F.col("name"), six_fields(F.col("cron")).alias("cron"), "zone", "enabled", "policy", "last_at")
    return rows.repartition(n, "name").mapInArrow(run, "name string, times array<long>").select("name", F.explode("times").alias("due_at"))


def rejected(schedules: DataFrame) -> DataFrame:
    """(name, error) of the schedules whose expression or zone cannot be read."""

    def run(frames):
        for pdf in frames:
            rows = []
            for x in pdf.itertuples():
                try:
                    occurrences(x.cron, x.zone, 0, 0)
                    ZoneInfo(x.zone)
                except (ValueError, AttributeError, TypeError, ZoneInfoNotFoundError) as error:
                    rows.append((x.name, str(error)))
            yield pd.DataFrame(rows, columns=["name", "error"]).astype("str")

    return schedules.select("name", six_fields(F.col("cron")).alias("cron"), "zone").mapInPandas(run, "name string, error string")


def dedup_key(name: Column, at: Column) -> Column:
    return F.concat_ws(":", name, at.cast("string"))


def tick(schedules: DataFrame, ledger: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, ledger after, schedules after): due occurrences that the ledger lacks, once each; every cursor moves to now."""
    rows = due(schedules, now).withColumn("dedup_key", dedup_key(F.col("name"), F.col("due_at"))).dropDuplicates(["dedup_key"])
    fresh = rows.join(ledger, "dedup_key", "left_anti")
    return fresh.select("name", "due_at", "dedup_key"), ledger.unionByName(fresh.select("dedup_key")), schedules.withColumn("last_at", F.lit(now).cast("long"))
