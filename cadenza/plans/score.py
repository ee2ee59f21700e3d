"""Queries over scores and playback, each with its SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import playback as pb
from ..operators import score as sc
from ..sources import catalog
from . import adapters as ad
from .registry import registry

N, T = ad.NOTES_SQL, ad.TIMED_SQL
QUERIES, SQL, query = registry()


def joined(c):
    return F.array_join(c, ",")


@query(T + " SELECT doc, t, coalesce(array_to_string(list_sort(list(DISTINCT pitch) FILTER (pitch IS NOT NULL)), ','), '') pitches FROM probes LEFT JOIN timed n USING (doc) GROUP BY ALL HAVING false UNION ALL SELECT p.doc, p.t, coalesce(s.x, '') FROM probes p LEFT JOIN (SELECT p.doc, p.t, array_to_string(list_sort(list(DISTINCT pitch)), ',') x FROM probes p JOIN timed n ON n.doc = p.doc AND start_ms <= t + 1 AND t < start_ms + duration_ms GROUP BY ALL) s ON s.doc = p.doc AND s.t = p.t")
def q301_sounding_at(spark, d, probes=ad.probes):
    n = ad.timed(spark, d)
    p = probes(spark, d)
    tasks = ad.tasks(spark, d)
    return pb.pitch_sets(pb.sounding_at(n, p, tasks=tasks), p, "x", tasks).select("doc", "t", joined("x").alias("pitches"))


@query(T + " SELECT p.doc, t, staff = 1 right_hand, array_to_string(list_sort(list(DISTINCT pitch)), ',') pitches FROM probes p JOIN timed n ON n.doc = p.doc AND start_ms <= t + 1 AND t < start_ms + duration_ms GROUP BY ALL")
def q302_expected_by_hand(spark, d, probes=ad.probes):
    n = ad.timed(spark, d)
    met = pb.sounding_at(n, probes(spark, d), tasks=ad.tasks(spark, d)).withColumn("right_hand", F.col("staff") == 1)
    return met.groupBy("doc", "t", "right_hand").agg(joined(F.sort_array(F.collect_set("pitch"))).alias("pitches"))


@query(T + " SELECT s.doc, s.start_ms t, array_to_string(list_sort(list(DISTINCT pitch)), ',') pitches FROM starts s JOIN timed n ON n.doc = s.doc AND abs(n.start_ms - s.start_ms) <= 1 GROUP BY ALL")
def q303_onsets_at(spark, d):
    p = ad.starts(spark, d).select("doc", F.col("start_ms").alias("t"))
    return pb.onsets_at(ad.timed(spark, d), p).groupBy("doc", "t").agg(joined(F.sort_array(F.collect_set("pitch"))).alias("pitches"))


@query(T + " SELECT p.doc, t, min(start_ms) FILTER (start_ms > t + 1) next_ms FROM probes p JOIN timed n USING (doc) GROUP BY ALL")
def q304_next_onset(spark, d, probes=ad.probes):
    n = ad.timed(spark, d)
    return pb.next_onset(n, probes(spark, d), tasks=ad.tasks(spark, d))


@query(T + ", sx AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY doc ORDER BY measure_index), song_end) e FROM starts) SELECT p.doc, t, measure_index, round((t - start_ms) / (e - start_ms), 6) fraction FROM probes p JOIN sx ON sx.doc = p.doc AND t >= start_ms AND t < e")
def q305_measure_at(spark, d, probes=ad.probes):
    out = pb.measure_at(ad.starts(spark, d), probes(spark, d))
    return out.withColumn("fraction", F.round("fraction", 6))


@query(T + ", req AS (SELECT DISTINCT s.doc, s.start_ms t, pitch FROM starts s JOIN timed n ON n.doc = s.doc AND abs(n.start_ms - s.start_ms) <= 1), pressed AS (SELECT DISTINCT user_id doc, 21 + event_id % 88 pitch FROM events WHERE event_type IN ('click', 'view')) SELECT doc, t, bool_or(p.pitch IS NULL) blocked FROM req LEFT JOIN pressed p USING (doc, pitch) GROUP BY ALL")
def q306_onset_gate(spark, d):
    p = ad.starts(spark, d).select("doc", F.col("start_ms").alias("t"))
    required = pb.onsets_at(ad.timed(spark, d), p).select("doc", "t", "pitch").distinct()
    pressed = ad.midi(spark, d).where("(status & 240) = 144").select(F.col("stream").alias("doc"), F.col("data1").cast("long").alias("pitch")).distinct()
    missing = required.join(pressed, ["doc", "pitch"], "left_anti").select("doc", "t").distinct().withColumn("blocked", F.lit(True))
    return required.select("doc", "t").distinct().join(missing, ["doc", "t"], "left").select("doc", "t", F.coalesce("blocked", F.lit(False)).alias("blocked"))


@query(N + " SELECT doc, measure_index, note_seq, pos FROM a_notes")
def q109_cursor_positions(spark, d):
    e = ad.note_events(spark, d)
    kind = F.when(F.col("is_chord"), "chord").otherwise("note")
    return sc.cursor_positions(e.select("doc", "measure_index", "note_seq", kind.alias("kind"), F.col("dur").cast("long").alias("dur")))


@query(N + " SELECT hand, doc, count(*) n FROM a_notes, (VALUES ('both'), ('left'), ('right')) h(hand) WHERE hand = 'both' OR (hand = 'right' AND staff = 1) OR (hand = 'left' AND staff >= 2) GROUP BY ALL")
def q201_visible_notes(spark, d):
    hand = F.explode(F.when(F.col("staff") == 1, F.array(F.lit("both"), F.lit("right"))).when(F.col("staff") >= 2, F.array(F.lit("both"), F.lit("left"))).otherwise(F.array(F.lit("both"))))
    return ad.note_events(spark, d).withColumn("hand", hand).groupBy("hand", "doc").agg(F.count(F.lit(1)).alias("n"))


@query(N + " SELECT doc, bool_or(staff >= 2) multiple_staves, count(*) FILTER (NOT is_rest) sounding FROM a_notes GROUP BY doc")
def q202_multiple_staves(spark, d):
    return ad.note_events(spark, d).groupBy("doc").agg(F.bool_or(F.col("staff") >= 2).alias("multiple_staves"), F.count_if(~F.col("is_rest")).alias("sounding"))


WIDTHS = N + ", col AS (SELECT doc, measure_index, pos, min(dur) dd FROM a_notes GROUP BY ALL), wd AS (SELECT doc, measure_index, round(greatest(60, 20 + sum(30 * pow(greatest(dd, 1) / 4.0::DOUBLE, 0.6))), 6) width FROM col GROUP BY ALL)"


def widths(spark, d):
    return sc.min_widths(ad.notes(spark, d), F.lit(ad.DIVISIONS)).withColumn("width", F.round("width", 6))


@query(WIDTHS + " SELECT doc, measure_index, round(width, 3) width FROM wd")
def q320_min_width(spark, d):
    return widths(spark, d).withColumn("width", F.round("width", 3))


SYSTEMS = WIDTHS.replace("WITH ", "WITH RECURSIVE ", 1) + ", sys AS (SELECT doc, measure_index, width w, 0 system_index, width acc, 1 cnt FROM wd WHERE measure_index = 0 UNION ALL SELECT wd.doc, wd.measure_index, wd.width, CASE WHEN acc + wd.width > 1000 OR cnt >= 4 THEN system_index + 1 ELSE system_index END, CASE WHEN acc + wd.width > 1000 OR cnt >= 4 THEN wd.width ELSE acc + wd.width END, CASE WHEN acc + wd.width > 1000 OR cnt >= 4 THEN 1 ELSE cnt + 1 END FROM sys JOIN wd ON wd.doc = sys.doc AND wd.measure_index = sys.measure_index + 1)"


def dense_widths(spark, d):
    """Widths by the rank of the measure: an order without lines leaves a gap in the numbering."""
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("measure_index")) - 1
    return widths(spark, d).withColumn("measure_index", rank)


SYSTEMS = SYSTEMS.replace("wd AS (SELECT doc, measure_index, round", "wd0 AS (SELECT doc, measure_index, round").replace(", sys AS", ", wd AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY measure_index) - 1 measure_index, width FROM wd0), sys AS", 1)


@query(SYSTEMS + " SELECT doc, system_index, array_to_string(list(measure_index ORDER BY measure_index), ',') measures FROM sys GROUP BY ALL")
def q203_systems(spark, d):
    return sc.pack_systems(dense_widths(spark, d), 1000.0, tasks=ad.tasks(spark, d)).select("doc", "system_index", joined("measures").alias("measures"))


@query(SYSTEMS + " SELECT doc, system_index, measure_index, round(coalesce(sum(w * (900 / s)) OVER (PARTITION BY doc, system_index ORDER BY measure_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) x, round(w * (900 / s), 2) width FROM (SELECT *, sum(w) OVER (PARTITION BY doc, system_index) s FROM sys)")
def q334_justified_measures(spark, d):
    w = dense_widths(spark, d)
    out = sc.justify(w, sc.pack_systems(w, 1000.0, tasks=ad.tasks(spark, d)), 900.0)
    return out.withColumns({"x": F.round("x", 2), "width": F.round("width", 2)})


CLEFS = N + ", mv AS (SELECT DISTINCT doc, measure_index, s staff FROM a_notes, (VALUES (1), (2)) v(s)), chg AS (SELECT *, CASE WHEN (doc + measure_index + staff) % 5 = 0 THEN CASE WHEN measure_index % 2 = 0 THEN 'C' ELSE 'F' END END sign FROM mv)"


@query(CLEFS + " SELECT doc, staff, measure_index, coalesce(last_value(sign IGNORE NULLS) OVER w, CASE staff WHEN 1 THEN 'G' ELSE 'F' END) sign, coalesce(last_value(CASE WHEN sign IS NOT NULL THEN CASE sign WHEN 'C' THEN 3 ELSE 4 END END IGNORE NULLS) OVER w, CASE staff WHEN 1 THEN 2 ELSE 4 END) line FROM chg WINDOW w AS (PARTITION BY doc, staff ORDER BY measure_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q206_running_clef(spark, d):
    return sc.running_clefs(*clef_changes(spark, d))


def clef_changes(spark, d):
    m = ad.note_events(spark, d).select("doc", "measure_index").distinct().withColumn("staff", F.explode(F.array(F.lit(1), F.lit(2))))
    sign = F.when(F.col("measure_index") % 2 == 0, "C").otherwise("F")
    changes = m.where((F.col("doc") + F.col("measure_index") + F.col("staff")) % 5 == 0).select("doc", "staff", "measure_index", sign.alias("sign"), F.when(sign == "C", 3).otherwise(4).alias("line"))
    return m, changes


@query(N + " SELECT doc, measure_index, note_seq, CASE WHEN dur >= 16 THEN 'whole' WHEN dur >= 8 THEN 'half' ELSE 'black' END head, round(30 * pow(greatest(dur, 1) / 4.0::DOUBLE, 0.6), 3) space FROM a_notes")
def q211_note_heads(spark, d):
    div = F.lit(ad.DIVISIONS)
    return ad.note_events(spark, d).select("doc", "measure_index", "note_seq", music.head_kind(F.lit(None).cast("string"), F.col("dur"), div).alias("head"), F.round(music.column_space(F.col("dur"), div), 3).alias("space"))


@query(T + " SELECT doc, measure_index, note_seq, CASE WHEN duration_ms / (60000.0::DOUBLE / (60 + doc % 120)) <= 0.32 THEN 2 WHEN duration_ms / (60000.0::DOUBLE / (60 + doc % 120)) <= 0.62 THEN 1 ELSE 0 END flags FROM timed")
def q212_flags(spark, d):
    return ad.timed(spark, d).select("doc", "measure_index", "note_seq", music.flags_by_ratio(F.col("duration_ms"), ad.bpm()).alias("flags"))


FL = T + ", fl AS (SELECT doc, staff, start_ms, measure_index, note_seq, CASE WHEN duration_ms / (60000.0::DOUBLE / (60 + doc % 120)) <= 0.32 THEN 2 WHEN duration_ms / (60000.0::DOUBLE / (60 + doc % 120)) <= 0.62 THEN 1 ELSE 0 END flags FROM timed)"


def flagged(spark, d):
    n = ad.timed(spark, d)
    return n.withColumn("flags", music.flags_by_ratio(F.col("duration_ms"), ad.bpm()))


@query(FL + " SELECT doc, staff, count(*) n FROM (SELECT *, lead(flags) OVER (PARTITION BY doc, staff ORDER BY start_ms, measure_index, note_seq) nf FROM fl) WHERE flags >= 2 AND nf >= 2 GROUP BY ALL")
def q347_secondary_beams(spark, d):
    after = F.lead("flags").over(Window.partitionBy("doc", "staff").orderBy("start_ms", "measure_index", "note_seq"))
    return flagged(spark, d).withColumn("nf", after).where("flags >= 2 and nf >= 2").groupBy("doc", "staff").agg(F.count(F.lit(1)).alias("n"))


@query(FL + " SELECT doc, staff, g group_no, count(*) n, min(start_ms) first_ms, max(start_ms) last_ms FROM (SELECT *, coalesce(sum(CASE WHEN flags = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, staff ORDER BY start_ms, measure_index, note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) g FROM fl) GROUP BY ALL")
def q344_beam_groups(spark, d):
    rows = sc.end_mark_groups(flagged(spark, d), ["doc", "staff"], ["start_ms", "measure_index", "note_seq"], F.col("flags") == 0)
    return rows.groupBy("doc", "staff", "group_no").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))


@query(N + " SELECT doc, count(DISTINCT pitch) n, min(pitch) low, max(pitch) high, array_to_string(list_sort(list(DISTINCT pitch)), ',') pitches FROM a_notes WHERE NOT is_rest GROUP BY doc")
def q325_distinct_pitches(spark, d):
    p = F.sort_array(F.collect_set("pitch"))
    return ad.note_events(spark, d).where("not is_rest").groupBy("doc").agg(F.size(p).cast("long").alias("n"), F.min("pitch").alias("low"), F.max("pitch").alias("high"), joined(p).alias("pitches"))


@query(
    N.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", r0 AS (SELECT doc, min(pitch) lo, max(pitch) hi FROM a_notes WHERE NOT is_rest AND pitch % 9 = doc % 9 GROUP BY doc), gr AS (SELECT doc, lo, hi, lo - lo % 12 a, hi + (12 - hi % 12) % 12 b, false done FROM r0 UNION ALL SELECT doc, lo, hi, CASE WHEN b - a < 24 AND b + 12 > 108 AND a - 12 >= 21 THEN a - 12 ELSE a END, CASE WHEN b - a < 24 AND b + 12 <= 108 THEN b + 12 ELSE b END, b - a >= 24 OR (b + 12 > 108 AND a - 12 < 21) FROM gr WHERE NOT done) SELECT doc, CAST(least(greatest(a, 21), lo) AS INT) low, CAST(greatest(least(b, 108), hi) AS INT) high FROM gr WHERE done"
)
def q324_keyboard_range(spark, d):
    r = ad.note_events(spark, d).where("not is_rest and pitch % 9 = doc % 9").groupBy("doc").agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
    low, high = music.auto_range(F.col("lo"), F.col("hi"))
    return r.select("doc", low.alias("low"), high.alias("high"))


@query(
    N.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", r0 AS (SELECT doc, min(pitch) lo, max(pitch) hi FROM a_notes WHERE NOT is_rest GROUP BY doc), gr AS (SELECT doc, lo, hi, lo - lo % 12 a, hi + (12 - hi % 12) % 12 b, false done FROM r0 UNION ALL SELECT doc, lo, hi, CASE WHEN b - a < 24 AND b + 12 > 108 AND a - 12 >= 21 THEN a - 12 ELSE a END, CASE WHEN b - a < 24 AND b + 12 <= 108 THEN b + 12 ELSE b END, b - a >= 24 OR (b + 12 > 108 AND a - 12 < 21) FROM gr WHERE NOT done) SELECT doc, CAST(least(greatest(a, 21), lo) AS INT) low, CAST(greatest(least(b, 108), hi) AS INT) high FROM gr WHERE done"
)
def q324_keyboard_range_of_all_notes(spark, d):
    r = ad.note_events(spark, d).where("not is_rest").groupBy("doc").agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
    low, high = music.auto_range(F.col("lo"), F.col("hi"))
    return r.select("doc", low.alias("low"), high.alias("high"))


@query(T + " SELECT doc, round(max(end_at), 4) song_end FROM timed GROUP BY doc")
def q321_song_end(spark, d):
    return ad.timed(spark, d).groupBy("doc").agg(F.round(F.max("end_at"), 4).alias("song_end"))


@query(T + " SELECT doc, measure_index, CAST(span AS BIGINT) span, start_div FROM ms")
def q341_measure_starts(spark, d):
    return ad.spans(ad.notes(spark, d, dealt=False)).select("doc", "measure_index", F.col("span").cast("long").alias("span"), F.col("start_div").cast("long").alias("start_div"))


@query(T + " SELECT doc, measure_index, note_seq, pitch, staff, start_ms, duration_ms FROM timed")
def q461_timed_notes(spark, d):
    return ad.timed(spark, d).drop("end_at")


@query(T + " SELECT doc, measure_index, start_ms, round(coalesce(lead(start_ms) OVER (PARTITION BY doc ORDER BY measure_index), song_end), 4) until_ms FROM starts")
def q342_measure_intervals(spark, d):
    until = F.coalesce(F.lead("start_ms").over(Window.partitionBy("doc").orderBy("measure_index")).cast("double"), F.col("song_end"))
    return ad.starts(spark, d).select("doc", "measure_index", "start_ms", F.round(until, 4).alias("until_ms"))


@query(T + " SELECT p.doc, t, s staff, coalesce(max_by(n.pitch, struct_pack(a := n.start_ms, b := n.measure_index, c := n.note_seq)) FILTER (n.start_ms <= t), min_by(n.pitch, struct_pack(a := n.start_ms, b := n.measure_index, c := n.note_seq))) pitch FROM probes p, (VALUES (1), (2)) v(s), timed n WHERE n.doc = p.doc AND n.staff = s GROUP BY ALL")
def q343_last_before_playhead(spark, d, probes=ad.probes):
    return pb.last_before(ad.timed(spark, d), probes(spark, d), tasks=ad.tasks(spark, d))


@query(N + ", tp AS (SELECT * FROM a_notes), marks AS (SELECT doc, staff, pitch, row_number() OVER (PARTITION BY doc, staff, pitch ORDER BY measure_index, note_seq) seq, dur % 3 = 0 is_start, dur % 3 = 1 is_stop FROM tp WHERE NOT is_rest), o AS (SELECT *, last_value(CASE WHEN is_start OR is_stop THEN CASE WHEN is_start THEN seq ELSE -1 END END IGNORE NULLS) OVER (PARTITION BY doc, staff, pitch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) open FROM marks) SELECT doc, staff, pitch, open start_seq, seq stop_seq FROM o WHERE is_stop AND open > 0")
def q315_tie_pairs(spark, d):
    seq = F.row_number().over(Window.partitionBy("doc", "staff", "pitch").orderBy("measure_index", "note_seq"))
    marks = ad.note_events(spark, d).where("not is_rest").select("doc", "staff", "pitch", seq.alias("seq"), (F.col("dur") % 3 == 0).alias("is_start"), (F.col("dur") % 3 == 1).alias("is_stop"))
    return sc.pair_marks(marks, ["doc", "staff", "pitch"])


@query(
    N.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", tn AS (SELECT doc, measure_index, note_seq, CASE WHEN dur % 4 <> 0 THEN 2 + pitch % 3 END actual FROM a_notes), tg AS (SELECT doc, measure_index, note_seq, actual, CASE WHEN actual IS NULL THEN 0 ELSE actual END size, CASE WHEN actual IS NULL THEN 0 ELSE 1 END filled, CASE WHEN actual IS NULL THEN -1 ELSE 0 END grp, CASE WHEN actual IS NULL THEN 0 ELSE 1 END next FROM tn WHERE note_seq = 1 UNION ALL SELECT n.doc, n.measure_index, n.note_seq, n.actual, CASE WHEN n.actual IS NULL THEN 0 WHEN tg.filled > 0 AND tg.filled < tg.size THEN tg.size ELSE n.actual END, CASE WHEN n.actual IS NULL THEN 0 WHEN tg.filled > 0 AND tg.filled < tg.size THEN tg.filled + 1 ELSE 1 END, CASE WHEN n.actual IS NULL THEN -1 WHEN tg.filled > 0 AND tg.filled < tg.size THEN tg.grp ELSE tg.next END, CASE WHEN n.actual IS NULL THEN tg.next WHEN tg.filled > 0 AND tg.filled < tg.size THEN tg.next ELSE tg.next + 1 END FROM tg JOIN tn n ON n.doc = tg.doc AND n.measure_index = tg.measure_index AND n.note_seq = tg.note_seq + 1) SELECT doc, measure_index, grp group_no, array_to_string(list(note_seq ORDER BY note_seq), ',') members FROM tg WHERE grp >= 0 GROUP BY ALL"
)
def q345_tuplet_groups(spark, d):
    n = ad.note_events(spark, d).select("doc", "measure_index", "note_seq", F.when(F.col("dur") % 4 != 0, (2 + F.col("pitch") % 3).cast("int")).alias("actual"))
    return sc.tuplet_groups(n, ["doc", "measure_index"]).withColumn("members", joined("members"))


@query("SELECT p pitch, p % 12 IN (0, 2, 4, 5, 7, 9, 11) white, (SELECT count(*) FROM range(0, 128) r(q) WHERE q < p AND q % 12 IN (0, 2, 4, 5, 7, 9, 11)) white_before, ((p // 12) - 1) * 7 + (SELECT count(*) FROM (VALUES (2), (4), (5), (7), (9), (11)) v(w) WHERE w <= p % 12) diatonic FROM range(0, 128) t(p)")
def q348_keyboard(spark, d):
    p = F.col("id")
    return spark.range(128).select(p.alias("pitch"), music.is_white(p).alias("white"), music.white_before(p).alias("white_before"), music.diatonic_step(p).alias("diatonic"))


@query(T + " SELECT doc, CAST(start_ms AS DOUBLE) at_ms FROM starts WHERE start_ms > 0 UNION ALL SELECT doc, round(song_end, 4) FROM ends")
def q349_bar_lines(spark, d):
    s = ad.starts(spark, d)
    return s.where("start_ms > 0").select("doc", F.col("start_ms").cast("double").alias("at_ms")).union(s.groupBy("doc").agg(F.round(F.max("song_end"), 4)))


@query(T + " SELECT doc, pitch, start_ms, row_number() OVER (PARTITION BY doc ORDER BY start_ms, measure_index, note_seq) rank FROM timed QUALIFY rank <= 20")
def q350_first_notes(spark, d):
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("start_ms", "measure_index", "note_seq"))
    return ad.timed(spark, d).select("doc", "pitch", "start_ms", rank.alias("rank")).where("rank <= 20")


@query(T + " SELECT doc, pitch, start_ms, row_number() OVER (PARTITION BY doc ORDER BY start_ms, measure_index, note_seq) rank FROM timed")
def q350_sorted_notes(spark, d):
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("start_ms", "measure_index", "note_seq"))
    return ad.timed(spark, d).select("doc", "pitch", "start_ms", rank.alias("rank"))


@query(T + ", spn AS (SELECT doc, t from_ms, t + 500 to_ms FROM probes), on_ AS (SELECT s.doc, from_ms, list_sort(list(DISTINCT pitch)) x FROM spn s JOIN timed n ON n.doc = s.doc AND start_ms >= from_ms AND start_ms < to_ms GROUP BY ALL), of_ AS (SELECT s.doc, from_ms, list_sort(list(DISTINCT pitch)) x FROM spn s JOIN timed n ON n.doc = s.doc AND start_ms <= from_ms AND from_ms < start_ms + duration_ms WHERE NOT EXISTS (SELECT 1 FROM timed k WHERE k.doc = s.doc AND k.pitch = n.pitch AND k.start_ms <= to_ms AND to_ms < k.start_ms + k.duration_ms) GROUP BY ALL) SELECT s.doc, s.from_ms, s.to_ms, coalesce(array_to_string(a.x, ','), '') starts, coalesce(array_to_string(b.x, ','), '') stops FROM spn s LEFT JOIN on_ a ON a.doc = s.doc AND a.from_ms = s.from_ms LEFT JOIN of_ b ON b.doc = s.doc AND b.from_ms = s.from_ms")
def q503_note_edges(spark, d, probes=ad.probes):
    n = ad.timed(spark, d)
    s = probes(spark, d).select("doc", F.col("t").alias("from_ms"), (F.col("t") + 500).alias("to_ms"))
    return pb.edges(n, s, ad.tasks(spark, d), 500).withColumns({"starts": joined("starts"), "stops": joined("stops")})


@query(T + ", sx AS (SELECT *, (coalesce(lead(start_ms) OVER (PARTITION BY doc ORDER BY measure_index), song_end) - start_ms) / 4 step FROM starts) SELECT doc, count(*) beats, count(*) FILTER (k = 0) accents, round(sum(start_ms + k * step), 2) total_ms FROM sx, range(0, 4) r(k) WHERE step > 0 AND start_ms + k * step >= 1000 AND start_ms + k * step < 30000 GROUP BY doc")
def q504_beats_crossed(spark, d):
    b = pb.beats(ad.starts(spark, d), 4).where("time_ms >= 1000 and time_ms < 30000")
    return b.groupBy("doc").agg(F.count(F.lit(1)).alias("beats"), F.count_if("accent").alias("accents"), F.round(F.sum("time_ms"), 2).alias("total_ms"))


@query(T + ", sx AS (SELECT *, (coalesce(lead(start_ms) OVER (PARTITION BY doc ORDER BY measure_index), song_end) - start_ms) / 4 step FROM starts), bt AS (SELECT doc, k, start_ms + k * step time_ms FROM sx, range(0, 4) r(k) WHERE step > 0) SELECT doc, CAST(floor(time_ms / 30000) AS BIGINT) * 30000 from_ms, count(*) beats, count(*) FILTER (k = 0) accents, round(sum(time_ms), 2) total_ms FROM bt GROUP BY ALL")
def q504_beats_of_whole_scores(spark, d):
    b = pb.beats(ad.starts(spark, d), 4).withColumn("from_ms", F.floor(F.col("time_ms") / 30000) * 30000)
    return b.groupBy("doc", "from_ms").agg(F.count(F.lit(1)).alias("beats"), F.count_if("accent").alias("accents"), F.round(F.sum("time_ms"), 2).alias("total_ms"))


@query(T + ", ons AS (SELECT p.doc, p.t, list_sort(list(DISTINCT pitch)) x FROM probes p JOIN timed n ON n.doc = p.doc AND abs(start_ms - t) <= 1 GROUP BY ALL), nx AS (SELECT p.doc, p.t, min(start_ms) FILTER (start_ms > t + 1) nt FROM probes p JOIN timed n USING (doc) GROUP BY ALL), nxs AS (SELECT nx.doc, nx.t, list_sort(list(DISTINCT pitch)) x FROM nx JOIN timed n ON n.doc = nx.doc AND abs(start_ms - nt) <= 1 GROUP BY ALL) SELECT p.doc, p.t, coalesce(array_to_string(ons.x, ','), array_to_string(nxs.x, ','), '') pitches FROM probes p LEFT JOIN ons ON ons.doc = p.doc AND ons.t = p.t LEFT JOIN nxs ON nxs.doc = p.doc AND nxs.t = p.t")
def q317_expected_keys(spark, d, probes=ad.probes):
    n = ad.timed(spark, d)
    tasks = ad.tasks(spark, d)
    p = probes(spark, d)
    now = pb.onsets_at(n, p, tasks=tasks).repartition(tasks, "doc", "t").groupBy("doc", "t").agg(F.sort_array(F.collect_set("pitch")).alias("now"))
    ahead = pb.next_onset(n, p, tasks=tasks).where("next_ms is not null").select("doc", F.col("t").alias("asked"), F.col("next_ms").alias("t"))
    ahead = pb.onsets_at(n, ahead, tasks=tasks).repartition(tasks, "doc", "asked").groupBy("doc", F.col("asked").alias("t")).agg(F.sort_array(F.collect_set("pitch")).alias("ahead"))
    out = p.repartition(tasks, "doc", "t").join(now, ["doc", "t"], "left").join(ahead, ["doc", "t"], "left")
    return out.select("doc", "t", F.coalesce(joined("now"), joined("ahead"), F.lit("")).alias("pitches"))


@query(T + ", rq AS (SELECT doc, pitch, min(staff) staff FROM timed WHERE start_ms <= 7501 AND 7500 < start_ms + duration_ms GROUP BY ALL), ac AS (SELECT DISTINCT user_id doc, 21 + event_id % 88 pitch FROM events WHERE event_type IN ('click', 'view')) SELECT coalesce(rq.doc, ac.doc) doc, coalesce(rq.pitch, ac.pitch) pitch, CASE WHEN rq.doc IS NOT NULL AND ac.doc IS NOT NULL THEN 'correct' WHEN rq.doc IS NOT NULL AND staff = 1 THEN 'expectedRight' WHEN rq.doc IS NOT NULL THEN 'expectedLeft' ELSE 'pressed' END state FROM rq FULL JOIN ac ON rq.doc = ac.doc AND rq.pitch = ac.pitch")
def q213_key_feedback(spark, d):
    n = ad.timed(spark, d)
    p = n.select("doc").distinct().withColumn("t", F.lit(7500).cast("long"))
    required = pb.sounding_at(n, p).groupBy("doc", "pitch").agg(F.min("staff").alias("staff"))
    active = ad.midi(spark, d).where("(status & 240) = 144").select(F.col("stream").alias("doc"), F.col("data1").cast("long").alias("pitch")).distinct()
    return pb.key_feedback(required, active)


@query(T + " SELECT p.doc, t, count(*) FILTER (start_ms <= t + 3000) waterfall, count(*) FILTER (start_ms <= t + 4000) staff_view FROM probes p JOIN timed n ON n.doc = p.doc AND start_ms + duration_ms >= t AND start_ms <= t + 4000 GROUP BY ALL")
def q210_viewport(spark, d, probes=ad.probes):
    n = ad.timed(spark, d)
    met = pb.in_view(n, probes(spark, d), 4000, ad.tasks(spark, d))
    return met.groupBy("doc", "t").agg(F.count_if(F.expr("start_ms <= t + 3000")).alias("waterfall"), F.count(F.lit(1)).alias("staff_view"))


@query("SELECT level, CAST(count(*) AS BIGINT) n, string_agg(id, ',' ORDER BY id) ids FROM (VALUES ('ode', 'beginner'), ('twinkle', 'beginner'), ('minuet', 'intermediate'), ('arabesque', 'intermediate'), ('prelude', 'advanced')) v(id, level) GROUP BY level")
def q335_catalog_by_level(spark, d):
    return catalog.by_level(catalog.entries(spark)).select("level", "n", joined("ids").alias("ids"))


@query("SELECT k * 1000 + m.i * 250 start_ms, CAST(225 AS BIGINT) duration_ms FROM range(0, 0) t(k), range(0, 0) m(i) UNION ALL SELECT measure * 3000 + beat * 750, 675 FROM range(0, 4) a(measure), range(0, 4) b(beat)")
def q106_demo_score(spark, d):
    return catalog.demo_notes(spark).select("start_ms", "duration_ms")


#: Questions of the first minute, asked again from each score's start to its end.
for _name in ("q210_viewport", "q301_sounding_at", "q302_expected_by_hand", "q304_next_onset", "q305_measure_at", "q317_expected_keys", "q343_last_before_playhead", "q503_note_edges"):
    QUERIES[f"{_name}_over_whole_scores"] = partial(QUERIES[_name], probes=ad.probes_to_the_end)
    SQL[f"{_name}_over_whole_scores"] = SQL[_name].replace(ad.PROBES_SQL, ad.PROBES_TO_THE_END_SQL)
