"""Queries over keyboards, notation glyphs, geometry and ports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import events as ev
from ..operators import playback as pb
from ..operators import score as sc
from . import adapters as ad
from . import score as sq
from .registry import registry

N, T = ad.NOTES_SQL, ad.TIMED_SQL
QUERIES, SQL, query = registry()
WHITE = "(0, 2, 4, 5, 7, 9, 11)"
KEYS = f"keys AS (SELECT CAST(p AS BIGINT) pitch, p % 12 IN {WHITE} white, (SELECT count(*) FROM range(21, 109) r(q) WHERE q < p AND q % 12 IN {WHITE}) w FROM range(21, 109) t(p)), rect AS (SELECT pitch, white, CASE WHEN white THEN w * 20.0::DOUBLE ELSE w * 20.0::DOUBLE - 6.2 END \"left\", CASE WHEN white THEN 20.0::DOUBLE ELSE 12.4 END width FROM keys)"


def of_docs(spark, d, *columns):
    """Sounding notes without positions; enough where no time is asked."""
    return ad.note_events(spark, d).where("not is_rest").select("doc", *columns)


@query(
    N
    + ", r0 AS (SELECT doc, min(pitch) lo, max(pitch) hi FROM a_notes WHERE NOT is_rest GROUP BY doc), ps AS (SELECT doc, lo, hi, k AS \"keys\", a, k - 1 span FROM r0, (VALUES (25, 48), (37, 48), (49, 36), (61, 36), (76, 28), (88, 21)) v(k, a)),"
    " s1 AS (SELECT *, CASE WHEN lo < a THEN lo ELSE a END l1 FROM ps), s2 AS (SELECT *, CASE WHEN hi > l1 + span THEN hi - span ELSE l1 END l2, CASE WHEN hi > l1 + span THEN hi ELSE l1 + span END h2 FROM s1)"
    " SELECT doc, \"keys\", CAST(greatest(21, least(108, least(l2, lo))) AS INT) low, CAST(greatest(21, least(108, greatest(h2, hi))) AS INT) high FROM s2"
)
def q324_preset_ranges(spark, d):
    r = of_docs(spark, d, "pitch").groupBy("doc").agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
    r = r.withColumn("keys", F.explode(F.array(*map(F.lit, music.PRESETS))))
    low, high = music.preset_range(F.col("keys"), F.col("lo"), F.col("hi"))
    return r.select("doc", "keys", low.alias("low"), high.alias("high"))


@query("WITH " + KEYS + " SELECT pitch, round(\"left\", 4) \"left\", round(width, 4) width, round(\"left\" + width / 2, 4) centre, pitch BETWEEN 48 AND 72 inside FROM rect")
def q464_key_rectangles(spark, d):
    p = F.col("id")
    left, width = music.key_rect(p, F.lit(21), F.lit(20.0))
    return spark.range(21, 109).select(p.alias("pitch"), F.round(left, 4).alias("left"), F.round(width, 4).alias("width"), F.round(left + width / 2, 4).alias("centre"), p.between(48, 72).alias("inside"))


@query("WITH " + KEYS + ", pts AS (SELECT x / 2.0::DOUBLE x, CAST(y AS DOUBLE) y FROM range(-10, 2100) a(x), range(-10, 120, 12) b(y)) SELECT x, y, min_by(pitch, CASE WHEN white THEN 1000 ELSE 0 END + pitch) pitch FROM pts JOIN rect ON x >= \"left\" AND x < \"left\" + width AND (white OR y < 62) WHERE x >= 0 AND y BETWEEN 0 AND 100 GROUP BY ALL")
def q465_hit_test(spark, d):
    points = spark.range(-10, 2100).select((F.col("id") / 2.0).alias("x"), F.explode(F.expr("cast(sequence(-10, 119, 12) AS array<double>)")).alias("y"))
    return pb.hit_test(points, 21, 108, 20.0, 100.0)


@query(
    "WITH q AS (SELECT p, k, [p, p + k % 3, p - k % 4, p + 1 - k % 2] av FROM range(21, 109) a(p), range(0, 24) b(k)), c AS (SELECT *, list_filter([p - 1, p + 1, p - 2, p + 2, p - 3, p + 3], lambda x: x BETWEEN 21 AND 108 AND NOT list_contains(av, x)) cs FROM q)"
    " SELECT p pitch, k pick, CASE WHEN len(cs) > 0 THEN cs[1 + CAST(k % len(cs) AS INT)] ELSE p END miss FROM c"
)
def q466_near_misses(spark, d):
    p, k = F.col("pitch"), F.col("pick")
    rows = spark.range(21, 109).select(F.col("id").alias("pitch"), F.explode(F.expr("sequence(0L, 23L)")).alias("pick"))
    avoid = F.array(p, p + k % 3, p - k % 4, p + 1 - k % 2)
    return rows.select("pitch", "pick", music.near_miss(p, F.lit(21).cast("long"), F.lit(108).cast("long"), avoid, k).alias("miss"))


@query("SELECT f fifths, bass, i - 1 place, CAST(CASE WHEN f > 0 THEN [8, 5, 9, 6, 3, 7, 4][i] ELSE [4, 7, 3, 6, 2, 5, 1][i] END - CASE WHEN bass THEN 2 ELSE 0 END AS INT) step FROM range(-9, 10) a(f), (VALUES (true), (false)) b(bass), range(1, 8) c(i) WHERE i <= abs(f)")
def q472_key_signatures(spark, d):
    rows = spark.range(-9, 10).select(F.col("id").alias("fifths"), F.explode(F.array(F.lit(True), F.lit(False))).alias("bass"))
    return rows.select("fifths", "bass", F.posexplode(music.key_signature(F.col("fifths"), F.col("bass"))).alias("place", "step"))


@query("SELECT y / 2.0::DOUBLE y, 40.0::DOUBLE + k * 10 line FROM range(-120, 260) a(y), range(1, 20) b(k) WHERE 40 + k * 10 <= y / 2.0 + 0.5 UNION ALL SELECT y / 2.0::DOUBLE, -k * 10.0::DOUBLE FROM range(-120, 260) a(y), range(1, 20) b(k) WHERE -k * 10 >= y / 2.0 - 0.5")
def q473_ledger_lines(spark, d):
    rows = spark.range(-120, 260).select((F.col("id") / 2.0).alias("y"))
    return rows.select("y", F.explode(music.ledger_lines(F.col("y"), F.lit(40.0), 10.0)).alias("line"))


_DIGITS = "".join(chr(music.METER_DIGITS + d) for d in range(10)), "".join(chr(music.TUPLET_DIGITS + d) for d in range(10))


@query(f"SELECT o_orderkey, translate(CAST(o_orderkey % 100 AS VARCHAR), '0123456789', '{_DIGITS[0]}') meter, translate(CAST(o_orderkey % 13 AS VARCHAR), '0123456789', '{_DIGITS[1]}') tuplet, translate(regexp_replace(lower(o_orderpriority), '[^pmfrszn]', '', 'g'), 'pmfrszn', '{''.join(music.DYNAMICS.values())}') dynamics FROM orders")
def q438_glyphs(spark, d):
    k = F.col("o_orderkey")
    return ad.table(spark, d, "orders").select("o_orderkey", music.number_glyphs(k % 100, music.METER_DIGITS).alias("meter"), music.number_glyphs(k % 13, music.TUPLET_DIGITS).alias("tuplet"), music.dynamics_glyphs(F.col("o_orderpriority")).alias("dynamics"))


@query("SELECT event_id, CAST(least(2.0, greatest(0.25, value / 100)) AS DOUBLE) speed FROM events WHERE value - 50 > 0 AND value - 50 < 100")
def q470_accepted_frames(spark, d):
    return ad.table(spark, d, "events").where(music.frame_counts(F.col("value") - 50)).select("event_id", music.speed(F.col("value") / 100).alias("speed"))


TYPES = "CASE dur % 7 WHEN 0 THEN 'whole' WHEN 1 THEN 'half' WHEN 2 THEN 'quarter' WHEN 3 THEN 'eighth' WHEN 4 THEN '16th' WHEN 5 THEN '64th' END"


def written(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("whole", "half", "quarter", "eighth", "16th", "64th")), F.lit(None)), (F.col("dur") % 7 + 1).cast("int"))
    return ad.note_events(spark, d).withColumn("type", kind)


@query(
    N + f", ty AS (SELECT *, {TYPES} ty FROM a_notes) SELECT doc, measure_index, note_seq, CASE WHEN ty IN ('whole', 'half') THEN ty WHEN ty IS NOT NULL THEN 'black' WHEN dur >= 16 THEN 'whole' WHEN dur >= 8 THEN 'half' ELSE 'black' END head,"
    " CASE ty WHEN 'eighth' THEN 1 WHEN '16th' THEN 2 WHEN '64th' THEN 4 ELSE 0 END flags, CASE WHEN is_rest THEN CASE WHEN ty IN ('whole', 'half', 'eighth', '16th') THEN ty ELSE 'quarter' END END rest FROM ty"
)
def q211_written_types(spark, d):
    n, t = written(spark, d), F.col("type")
    return n.select("doc", "measure_index", "note_seq", music.head_kind(t, F.col("dur"), F.lit(ad.DIVISIONS)).alias("head"), music.flags_by_type(t).alias("flags"), F.when(F.col("is_rest"), music.rest_kind(t)).alias("rest"))


@query(
    N + f", fl AS (SELECT *, 1 + pitch % 2 voice, {TYPES} ty FROM a_notes WHERE NOT is_rest), g AS (SELECT *, coalesce(sum(CASE WHEN ty = 'eighth' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, measure_index, staff, voice ORDER BY note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) g FROM fl)"
    " SELECT doc, measure_index, staff, voice, g group_no, array_to_string(list(note_seq ORDER BY note_seq), ',') members FROM g GROUP BY ALL"
)
def q344_engraved_beams(spark, d):
    n = written(spark, d).where("not is_rest").withColumn("voice", 1 + F.col("pitch") % 2)
    rows = sc.end_mark_groups(n, ["doc", "measure_index", "staff", "voice"], ["note_seq"], F.coalesce(F.col("type") == "eighth", F.lit(False)))
    return rows.groupBy("doc", "measure_index", "staff", "voice", "group_no").agg(F.array_join(F.array_sort(F.collect_list("note_seq")), ",").alias("members"))


SLURS = (
    N.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", mk AS (SELECT doc, measure_index, staff, row_number() OVER (PARTITION BY doc, measure_index, staff ORDER BY note_seq) seq, pitch y, dur % 3 = 0 st, dur % 3 = 1 sp FROM a_notes WHERE NOT is_rest),"
    " f AS (SELECT doc, measure_index, staff, seq, CASE WHEN st THEN [seq] ELSE [] END stack, CAST(NULL AS BIGINT) start_seq FROM mk WHERE seq = 1 UNION ALL SELECT m.doc, m.measure_index, m.staff, m.seq, CASE WHEN m.st THEN list_append(f.stack, m.seq) WHEN m.sp THEN f.stack[:len(f.stack) - 1] ELSE f.stack END,"
    " CASE WHEN m.sp THEN f.stack[len(f.stack)] END FROM f JOIN mk m ON m.doc = f.doc AND m.measure_index = f.measure_index AND m.staff = f.staff AND m.seq = f.seq + 1),"
    " pr AS (SELECT f.doc, f.measure_index, f.staff, f.start_seq, f.seq stop_seq, min(m.y) top, any_value(a.y) ay, any_value(b.y) AS \"by\" FROM f JOIN mk m ON m.doc = f.doc AND m.measure_index = f.measure_index AND m.staff = f.staff AND m.seq BETWEEN f.start_seq AND f.seq"
    " JOIN mk a ON a.doc = f.doc AND a.measure_index = f.measure_index AND a.staff = f.staff AND a.seq = f.start_seq JOIN mk b ON b.doc = f.doc AND b.measure_index = f.measure_index AND b.staff = f.staff AND b.seq = f.seq WHERE f.start_seq IS NOT NULL GROUP BY ALL)"
)


def slurs(spark, d):
    keys = ["doc", "measure_index", "staff"]
    n = ad.note_events(spark, d).where("not is_rest").withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("note_seq")))
    marks = n.select(*keys, "seq", (F.col("dur") % 3 == 0).alias("is_start"), (F.col("dur") % 3 == 1).alias("is_stop"), F.col("pitch").alias("y"))
    return marks, sc.nested_pairs(marks, keys)


@query(SLURS + " SELECT doc, measure_index, staff, start_seq, stop_seq, CAST(top AS DOUBLE) top FROM pr")
def q315_nested_slurs(spark, d):
    return slurs(spark, d)[1]


@query(SLURS + " SELECT doc, measure_index, staff, start_seq, stop_seq, round((start_seq + stop_seq) * 5.0::DOUBLE, 4) cx, round(2 * (top - (14.0::DOUBLE + (stop_seq - start_seq) * 0.5::DOUBLE)) - 0.5::DOUBLE * (ay + \"by\"), 4) cy FROM pr")
def q471_slur_controls(spark, d):
    marks, pairs = slurs(spark, d)
    keys = ["doc", "measure_index", "staff"]
    a, b = (marks.select(*keys, F.col("seq").alias(s), F.col("y").alias(y)) for s, y in (("start_seq", "ay"), ("stop_seq", "by")))
    cx, cy = music.slur_control(F.col("start_seq") * 10.0, F.col("ay"), F.col("stop_seq") * 10.0, F.col("by"), F.col("top"), 10.0)
    return pairs.join(a, [*keys, "start_seq"]).join(b, [*keys, "stop_seq"]).select(*keys, "start_seq", "stop_seq", F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"))


@query("SELECT s step, o octave, a alter, CAST((o + 1) * 12 + CASE s WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 ELSE 0 END + a AS BIGINT) midi, CAST(50 - (o * 7 + CASE s WHEN 'D' THEN 1 WHEN 'E' THEN 2 WHEN 'F' THEN 3 WHEN 'G' THEN 4 WHEN 'A' THEN 5 WHEN 'B' THEN 6 ELSE 0 END - (24 - 3 * 2)) * 5 AS DOUBLE) bass_y FROM (VALUES ('C'), ('D'), ('E'), ('F'), ('G'), ('A'), ('B'), ('X')) v(s), range(-1, 10) b(o), range(-2, 3) c(a)")
def q460_midi_numbers(spark, d):
    rows = spark.range(-1, 10).select(F.col("id").alias("octave"), F.explode(F.array(*map(F.lit, "CDEFGABX"))).alias("step")).withColumn("alter", F.explode(F.expr("sequence(-2L, 2L)")))
    midi = music.midi_number(F.col("step"), F.col("octave"), F.col("alter")).cast("long")
    return rows.select("step", "octave", "alter", midi.alias("midi"), music.note_y(F.col("step"), F.col("octave"), F.lit("F"), F.lit(4), F.lit(50.0), 10.0).alias("bass_y"))


@query("SELECT d divisions, b beats, t beat_type, CAST(d * b * 4 // CASE WHEN t = 0 THEN 4 ELSE t END AS BIGINT) nominal FROM range(0, 17) x(d), range(0, 13) y(b), range(0, 17) z(t)")
def q462_nominal_divisions(spark, d):
    rows = spark.range(0, 17).select(F.col("id").alias("divisions"), F.explode(F.expr("sequence(0L, 12L)")).alias("beats")).withColumn("beat_type", F.explode(F.expr("sequence(0L, 16L)")))
    return rows.withColumn("nominal", music.nominal_divisions(F.col("divisions"), F.col("beats"), F.col("beat_type")))


STEADY = "sp AS (SELECT c_custkey doc, CAST(c_custkey % 120 AS INT) bpm, CAST(c_custkey % 7 * 1000 AS DOUBLE) f, CAST(c_custkey % 11 * 3000 AS DOUBLE) t FROM customer), bt AS (SELECT doc, k, k * (60000.0::DOUBLE / bpm) x FROM sp, range(0, 70) r(k) WHERE bpm > 0 AND t > f AND k >= ceil(f / (60000.0::DOUBLE / bpm)) AND k <= ceil(t / (60000.0::DOUBLE / bpm)) - 1)"


@query("WITH " + STEADY + " SELECT doc, round(x, 4) time_ms, k % 4 = 0 accent FROM bt")
def q504_steady_beats(spark, d):
    k = F.col("c_custkey")
    spans = ad.table(spark, d, "customer").select(k.alias("doc"), (k % 120).cast("int").alias("bpm"), (k % 7 * 1000).cast("double").alias("from_ms"), (k % 11 * 3000).cast("double").alias("to_ms"))
    return pb.steady_beats(spans, 4).withColumn("time_ms", F.round("time_ms", 4))


@query(sq.SYSTEMS + ", sz AS (SELECT doc, system_index, count(*) n FROM sys GROUP BY ALL), po AS (SELECT doc, system_index, measure_index, row_number() OVER (PARTITION BY doc, system_index ORDER BY measure_index) - 1 k FROM sys) SELECT p.doc, p.measure_index, p.system_index + 1 next_system FROM po p JOIN sz s ON s.doc = p.doc AND s.system_index = p.system_index JOIN sz x ON x.doc = p.doc AND x.system_index = p.system_index + 1 WHERE (k + 0.25) / s.n >= 0.5")
def q515_next_lines(spark, d):
    systems = sc.pack_systems(sq.dense_widths(spark, d), 1000.0, tasks=ad.tasks(spark, d)).select("doc", "system_index", "measures")
    places = systems.select("doc", F.explode("measures").alias("measure_index"), F.lit(0.25).alias("fraction"))
    return pb.next_lines(systems, places)


@query(ad.MIDI_SQL + ", e0 AS (SELECT stream, seq, data1 pitch, CASE WHEN seq % 9 = 0 THEN 'alloff' WHEN status & 240 = 144 AND data2 > 0 THEN 'on' WHEN status & 240 IN (128, 144) THEN 'off' END kind FROM midi), e1 AS (SELECT *, coalesce(sum(CASE WHEN kind = 'alloff' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) r FROM e0 WHERE kind IS NOT NULL), e2 AS (SELECT *, lag(kind) OVER (PARTITION BY stream, r, pitch ORDER BY seq) pk FROM e1 WHERE kind <> 'alloff'), h AS (SELECT stream, r, pitch, max(CASE WHEN kind = 'on' AND pk IS DISTINCT FROM 'on' THEN seq END) b FROM e2 GROUP BY ALL HAVING max_by(kind, seq) = 'on') SELECT h.stream, o.seq, h.pitch, row_number() OVER (PARTITION BY h.stream, h.r ORDER BY b) place FROM h JOIN e1 o ON o.stream = h.stream AND o.r = h.r AND o.kind = 'alloff'")
def q502_all_released(spark, d):
    rows = ev.decode(ad.midi(spark, d))
    return ev.all_released(rows.withColumn("kind", F.when(F.col("seq") % 9 == 0, "alloff").otherwise(F.col("kind"))))


PORTS = "pt AS (SELECT s_nationkey host, s_suppkey seq, CASE s_suppkey % 4 WHEN 0 THEN 'Midi Through ' WHEN 1 THEN 'Piano ' WHEN 2 THEN 'My RTPMIDI ' ELSE 'Keys ' END || s_suppkey AS name FROM supplier), pv AS (SELECT *, contains(lower(name), 'through') OR contains(lower(name), 'rtpmidi') OR contains(lower(name), 'network') virtual FROM pt)"


def named_ports(spark, d):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("Midi Through ", "Piano ", "My RTPMIDI ", "Keys "))), (k % 4 + 1).cast("int"))
    return ad.table(spark, d, "supplier").select(F.col("s_nationkey").alias("host"), k.alias("seq"), F.concat(kind, k.cast("string")).alias("name"))


@query("WITH " + PORTS + " SELECT host, seq, name, virtual, row_number() OVER (PARTITION BY host ORDER BY virtual, seq) place FROM pv")
def q207_ports(spark, d):
    return ev.ports(named_ports(spark, d))


@query("WITH " + PORTS + " SELECT host, name FROM pv QUALIFY row_number() OVER (PARTITION BY host ORDER BY virtual, seq) = 1")
def q208_chosen_port(spark, d):
    return ev.ports(named_ports(spark, d)).where("place = 1").select("host", "name")
