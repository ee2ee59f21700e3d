"""Text, names, durations and codes as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: nanoseconds of each unit of a written duration, and the unit's names; a month is a twelfth of 365.25 days
UNITS = {
    ("ns", "nsec", "nanos"): 1, ("us", "usec", "micros"): 10**3, ("ms", "msec", "millis"): 10**6, ("s", "sec", "secs", "second", "seconds"): 10**9,
    ("m", "min", "mins", "minute", "minutes"): 60 * 10**9, ("h", "hr", "hrs", "hour", "hours"): 3600 * 10**9, ("d", "day", "days"): 86400 * 10**9,
    ("w", "wk", "wks", "week", "weeks"): 604800 * 10**9, ("M", "month", "months"): 2630016 * 10**9, ("y", "yr", "yrs", "year", "years"): 31557600 * 10**9,
}
# fixed values: status of each kind of error
STATUS = {"invalid_argument": 3, "not_found": 5, "already_exists": 6, "permission_denied": 7, "resource_exhausted": 8, "failed_precondition": 9, "aborted": 10, "unauthenticated": 16}
INTERNAL = 13
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Ports with one of these words in their name are no devices of their own.
VIRTUAL = ("through", "rtpmidi", "network")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the text, in any case."""
    return reduce(lambda c, w: c | F.contains(F.lower(text), F.lit(w)), words, F.lit(False))


def list_items(text: Column) -> Column:
    """Items of a comma list without the empty ones."""
    return F.filter(F.split(text, ","), lambda x: x != "")


def list_with(text: Column, item: Column) -> Column:
    """A comma list with one more item."""
    return F.array_join(F.concat(list_items(F.coalesce(text, F.lit(""))), F.array(item)), ",")


def dotted(module: Column, kind: Column) -> Column:
    return F.concat_ws(".", module, kind)


def rate_key(scope: Column, subject: Column) -> Column:
    return F.concat_ws(":", F.lit("rl"), scope, subject)


def status_code(kind: Column) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[0], F.lit(kv[1])), STATUS.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(INTERNAL))


def is_uuid(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(UUID)), F.lit(False))


def _duration(text: Column, kind: str) -> Column:
    """Nanoseconds of a duration such as ``1h 30m`` or ``2 weeks`` in numbers of ``kind``; null where it is none or does not fit."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)\s*[A-Za-z]+"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(r"\d+\s*([A-Za-z]+)"), F.lit(1))

    def of(n: Column, u: Column) -> Column:
        unit = reduce(lambda c, kv: c.when(u.isin(*kv[0]), F.lit(kv[1]).cast("long")), UNITS.items(), F.when(F.lit(False), F.lit(0).cast("long")))
        return F.try_multiply(n.try_cast("long"), unit) if kind == "long" else F.try_multiply(n.try_cast("decimal(19,0)"), unit.cast("decimal(18,0)")).cast(kind)

    total = F.aggregate(F.zip_with(parts, units, of), F.lit(0).cast(kind), lambda a, x: F.try_add(a, x).cast(kind))
    return F.when(F.rlike(text, F.lit(r"^\s*(\d+\s*[A-Za-z]+\s*)+$")), total)


def duration_nanos(text: Column) -> Column:
    """Nanoseconds of a duration such as ``1h 30m`` or ``2 weeks``; null where the text is none or does not fit a long."""
    return _duration(text, "long")


def duration_seconds(text: Column) -> Column:
    """Whole seconds of a duration; null where the text is none or its seconds do not fit a long.

    Nanoseconds are added up in decimals: as a long they end at 292 years, or some 3,500 months.
    """
    nanos = _duration(text, "decimal(38,0)")
    second = F.lit(10**9).cast("decimal(10,0)")
    return ((nanos - nanos % second) / second).try_cast("long")


def rate_limit(text: Column) -> tuple[Column, Column]:
    """(hits, seconds) of a limit such as ``3/1h``; null where it is none."""
    return F.regexp_extract(text, r"^\s*(\d+)\s*/", 1).try_cast("long"), duration_seconds(F.regexp_extract(text, "/(.*)$", 1))


def interval_micros(months: Column, days: Column, micros: Column) -> Column:
    """An interval as microseconds; a month has 30 days, nothing is negative."""
    return F.greatest(F.lit(0).cast("long"), (months.cast("long") * 30 + days) * 86_400_000_000 + micros)


NIL_UUID = "00000000-0000-0000-0000-000000000000"


def _digits(seed: str, key: Column) -> Column:
    """32 hexadecimal digits that seed and key decide."""
    return F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary"))


def _laid_out(head: Column, version: str, h: Column) -> Column:
    """Groups of 8, 4, 4, 4 and 12 digits: twelve of ``head``, the version, and digits of ``h`` with the variant's two bits."""
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(head, 1, 8), F.substring(head, 9, 4), F.concat(F.lit(version), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def uuid_v4(seed: str, key: Column) -> Column:
    """A version 4 id of a row, the same at every run: of tasks that are repeated, too."""
    h = _digits(seed, key)
    return _laid_out(h, "4", h)


def uuid_v7(seed: str, key: Column, ms: Column) -> Column:
    """A version 7 id: ordered by the milliseconds since 1970, the rest as in ``uuid_v4``."""
    return _laid_out(F.lower(F.lpad(F.hex(ms), 12, "0")), "7", _digits(seed, key))


def with_item(items: Column, item: Column) -> Column:
    """A sorted set with one more item."""
    return F.array_sort(F.array_union(items, F.array(item)))


def without_item(items: Column, item: Column) -> Column:
    return F.array_sort(F.array_remove(F.array_distinct(items), item))


def without_all(items: Column, others: Column) -> Column:
    return F.array_sort(F.array_except(items, others))


def contains_all(items: Column, others: Column) -> Column:
    return F.size(F.array_except(others, items)) == 0
