"""Raw note messages: decoding, held notes, releases and changes between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def decode(raw: DataFrame) -> DataFrame:
    """(stream, seq, kind, pitch, velocity) of messages (stream, seq, status, data1, data2).

    The high half of the status tells the kind; a start without velocity is an end; others have no kind.
    """
    high = F.col("status").bitwiseAND(F.lit(0xF0))
    kind = F.when((high == 0x90) & (F.col("data2") > 0), "on").when(high.isin(0x80, 0x90), "off")
    return raw.select("stream", "seq", kind.alias("kind"), F.col("data1").alias("pitch"), F.when(high == 0x90, F.col("data2")).otherwise(0).alias("velocity"))


def synth_velocity(velocity: Column) -> Column:
    """Seven bits; silence stands for the default."""
    return F.when(velocity == 0, 100).otherwise(F.least(velocity, F.lit(127)))


def held(events: DataFrame) -> DataFrame:
    """(stream, held) of the pitches whose last event is a start; streams that hold none are left out."""
    last = events.where("kind is not null").groupBy("stream", "pitch").agg(F.max_by("kind", "seq").alias("last"))
    return last.where("last = 'on'").groupBy("stream").agg(F.sort_array(F.collect_list("pitch")).alias("held"))


def released(events: DataFrame) -> DataFrame:
    """(stream, seq, pitch) of the ends that release a sounding pitch."""
    before = F.lag("kind").over(Window.partitionBy("stream", "pitch").orderBy("seq"))
    return events.where("kind is not null").withColumn("_b", before).where("kind = 'off' and _b = 'on'").select("stream", "seq", "pitch")


def set_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(stream, added, removed): sizes of the differences of two held states, where there are any."""
    none = F.array().cast("array<int>")
    both = old.select("stream", F.col("held").alias("a")).join(new.select("stream", F.col("held").alias("b")), "stream", "full")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    out = both.select("stream", F.size(F.array_except(b, a)).cast("long").alias("added"), F.size(F.array_except(a, b)).cast("long").alias("removed"))
    return out.where("added > 0 or removed > 0")


def all_released(events: DataFrame) -> DataFrame:
    """(stream, seq, pitch, place) of the pitches that each event of kind ``alloff`` releases, in the order of their presses.

    A pitch sounds from its first start since it was last released; pressing it again does not move its place.
    """
    off = F.col("kind") == "alloff"
    round_ = F.coalesce(F.sum(off.cast("int")).over(Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.where("kind is not null").withColumn("round", round_)
    before = F.lag("kind").over(Window.partitionBy("stream", "round", "pitch").orderBy("seq"))
    notes = rows.where(~off).withColumn("began", F.when((F.col("kind") == "on") & ~before.eqNullSafe(F.lit("on")), F.col("seq")))
    held = notes.groupBy("stream", "round", "pitch").agg(F.max_by("kind", "seq").alias("last"), F.max("began").alias("began")).where("last = 'on'")
    ends = rows.where(off).select("stream", "round", "seq")
    place = F.row_number().over(Window.partitionBy("stream", "round").orderBy("began"))
    return held.withColumn("place", place).join(ends, ["stream", "round"]).select("stream", "seq", "pitch", "place")


def ports(names: DataFrame) -> DataFrame:
    """(host, seq, name, virtual, place): a host's real ports before virtual ones, otherwise in the order given; the first is taken."""
    virtual = text.contains_any(F.col("name"), text.VIRTUAL)
    return names.withColumn("virtual", virtual).withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("virtual", "seq")))


def port_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(host, changed) of two states (host, ports, device): changed where number, names or the connected device differ.

    A host that one side lacks has no ports and no device there.
    """
    none = F.array().cast("array<string>")
    both = old.select("host", F.col("ports").alias("a"), F.col("device").alias("da")).join(new.select("host", F.col("ports").alias("b"), F.col("device").alias("db")), "host", "full")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    changed = (F.size(a) != F.size(b)) | (F.size(F.array_except(b, a)) > 0) | ~F.col("da").eqNullSafe(F.col("db"))
    return both.select("host", changed.alias("changed"))
