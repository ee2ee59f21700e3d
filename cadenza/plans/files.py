"""Queries that go through score files: customers' orders written as score XML, parsed again, with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import playback as pb
from ..operators import score as sc
from ..sources import scores
from . import adapters as ad
from .registry import registry

QUERIES, SQL, query = registry()


def _tag(name: str, value, mark: str = ""):
    return F.concat(F.lit(f"<{name}{mark}>"), value.cast("string"), F.lit(f"</{name}>"))


def files(spark, d, marked: bool = False):
    """(doc, content): a customer's orders as the measures of one score, with changes, bad numbers, backups and a second part.

    ``marked``: with a composer, and with numbers of staves and fifths in some measures.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    n = ad.tasks(spark, d)
    lines = ad.table(spark, d, "lineitem").repartition(n, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", F.row_number().over(order).alias("seq"))
    dur, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    chord = F.when((F.col("l_returnflag") == "A") & (F.col("seq") > 1), "<chord/>").otherwise("")
    pitch = F.when(p % 7 == 0, "<rest/>").otherwise(F.concat(F.lit("<pitch>"), _tag("step", F.substring(F.lit("CDEFGAB"), (p % 7 + 1).cast("int"), F.lit(1))), _tag("octave", 2 + p % 5), F.lit("</pitch>")))
    note = F.concat(F.lit("<note>"), chord, pitch, _tag("duration", dur), _tag("staff", 1 + F.col("l_suppkey") % 2), F.lit("</note>"))
    move = F.when(p % 5 == 0, F.concat(F.lit("<backup>"), _tag("duration", 2 * dur), F.lit("</backup>"))).when(p % 5 == 1, "<forward><duration>3</duration></forward>").otherwise("")
    notes = lines.select("l_orderkey", "seq", F.concat(note, move).alias("x")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"]), "").alias("notes"))

    key = F.col("o_orderkey")
    divisions = F.when(key % 3 == 0, _tag("divisions", 1 + key % 4)).when(key % 3 == 1, "<divisions>abc</divisions>").otherwise("")
    more = F.when(key % 7 == 0, F.concat(_tag("staves", key % 4), F.lit("<key>"), _tag("fifths", key % 9 - 4), F.lit("</key>"))).otherwise("") if marked else F.lit("")
    beats = F.when(key % 5 == 0, F.concat(F.lit("<time>"), _tag("beats", 2 + key % 3), F.lit("<beat-type>8</beat-type></time>"))).otherwise("")
    number = F.concat(F.lit('<clef number="'), (1 + key % 2).cast("string"), F.lit('">'))
    clef = F.when(key % 4 != 3, F.concat(number, _tag("sign", F.when(key % 3 == 0, "F").otherwise("G")), _tag("line", 2 + key % 3), F.lit("</clef>"))).otherwise("")
    second = F.when(key % 4 == 0, F.concat(number, F.lit("<sign>C</sign><line>3</line></clef>"))).otherwise("")
    tempo = F.when(key % 6 == 0, F.concat(F.lit("<direction><direction-type><metronome>"), _tag("per-minute", key % 4 * 30), F.lit("</metronome></direction-type></direction>"))).otherwise("")
    head = F.concat(F.lit("<measure><attributes>"), divisions, more, beats, clef, second, F.lit("</attributes>"), tempo)
    orders = ad.table(spark, d, "orders").join(notes, F.col("l_orderkey") == key, "left")
    measures = orders.select("o_custkey", F.struct("o_orderdate", "o_orderkey", F.concat(head, F.coalesce("notes", F.lit("")), F.lit("</measure>")).alias("x")).alias("m"))
    whole = measures.repartition(n, "o_custkey").groupBy(F.col("o_custkey").alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["x"]), "").alias("x"))
    other = "</part><part><measure><note><pitch><step>C</step><octave>4</octave></pitch><duration>9</duration></note></measure></part></score-partwise>"
    author = F.concat(F.lit('<identification><creator type="lyricist">No</creator><creator type="composer"> By '), F.col("c").cast("string"), F.lit("</creator></identification>")) if marked else F.lit("")
    text = F.concat(F.lit("<score-partwise><work><work-title> Score "), F.col("c").cast("string"), F.lit("</work-title><work-title> </work-title></work>"), author, F.lit("<part>"), "x", F.lit(other))
    return whole.select(F.col("c").cast("string").alias("doc"), text.cast("binary").alias("content"))


M = "WITH RECURSIVE mm AS (SELECT o_orderkey k, o_custkey doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 m FROM orders)"
CLEFS = M + ", cl AS (SELECT doc, m, 1 + k % 2 staff, 1 s, CASE WHEN k % 3 = 0 THEN 'F' ELSE 'G' END sign, 2 + k % 3 line FROM mm WHERE k % 4 <> 3 UNION ALL SELECT doc, m, 1 + k % 2, 2, 'C', 3 FROM mm WHERE k % 4 = 0)"


@query(M + " SELECT doc, 'By ' || doc composer, greatest(1, coalesce(arg_max(k % 4, m) FILTER (k % 7 = 0), 1)) staves, coalesce(arg_max(k % 9 - 4, m) FILTER (k % 7 = 0), 0) fifths FROM mm GROUP BY doc")
def q112_composers_and_staves(spark, d):
    docs = scores.documents(scores.parse_scores(files(spark, d, marked=True), scores.DOCUMENT))
    return docs.select(F.col("doc").cast("long").alias("doc"), "composer", "staves", "fifths")


@query(CLEFS + " SELECT doc, staff, arg_min(sign, m * 10 + s) sign, arg_min(line, m * 10 + s) line FROM cl GROUP BY doc, staff")
def q110_first_clefs(spark, d):
    return scores.first_clefs(scores.parse_scores(files(spark, d), ("clef",))).withColumn("doc", F.col("doc").cast("long"))


@query(CLEFS + " SELECT doc, m measure_index, staff, arg_max(sign, s) sign, arg_max(line, s) line FROM cl GROUP BY doc, m, staff")
def q110_measure_clefs(spark, d):
    return scores.measure_clefs(scores.parse_scores(files(spark, d), ("clef",))).withColumn("doc", F.col("doc").cast("long"))


@query(
    M + " SELECT doc, 'Score ' || doc title, coalesce(arg_max(1 + k % 4, m) FILTER (k % 3 = 0), 1) divisions, coalesce(arg_max(2 + k % 3, m) FILTER (k % 5 = 0), 4) beats, CASE WHEN count(*) FILTER (k % 5 = 0) > 0 THEN 8 ELSE 4 END beat_type,"
    " coalesce(arg_min(k % 4 * 30, m) FILTER (k % 6 = 0 AND k % 4 > 0), 90) bpm, count(*) measures FROM mm GROUP BY doc"
)
def q112_score_documents(spark, d):
    out = scores.documents(scores.parse_scores(files(spark, d), scores.DOCUMENT))
    return out.select(F.col("doc").cast("long").alias("doc"), "title", "divisions", "beats", "beat_type", "bpm", "measures")


@query(
    M
    + """, ll AS (SELECT l_orderkey k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) q, CAST(l_quantity AS INT) dur, l_partkey p, l_returnflag r FROM lineitem),
x AS (SELECT doc, m, q, dur, p, r = 'A' AND q > 1 chord, CASE WHEN p % 5 = 0 THEN -2 * dur WHEN p % 5 = 1 THEN 3 ELSE 0 END moved FROM ll JOIN mm USING (k)),
f AS (SELECT doc, m, q, CAST(0 AS BIGINT) pos, CAST(0 AS BIGINT) last, CAST(greatest(0, dur + moved) AS BIGINT) cur FROM x WHERE q = 1
  UNION ALL SELECT x.doc, x.m, x.q, CASE WHEN x.chord THEN f.last ELSE f.cur END, CASE WHEN x.chord THEN f.last ELSE f.cur END, greatest(0, f.cur + CASE WHEN x.chord THEN 0 ELSE x.dur END + x.moved) FROM f JOIN x ON x.doc = f.doc AND x.m = f.m AND x.q = f.q + 1)
SELECT doc, m measure_index, q note_seq, pos FROM f"""
)
def q109_cursor_of_files(spark, d):
    """Positions of the notes of files with chords, forwards and backups that reach behind the measure's start."""
    moves = scores.parse_scores(files(spark, d), ("note", "chord", "backup", "forward"), ["doc", "measure_index", "note_seq", "kind", "dur"]).where("kind <> 'error'")
    pos = sc.cursor_positions(moves)
    place = F.row_number().over(Window.partitionBy("doc", "measure_index").orderBy("note_seq"))
    return pos.select(F.col("doc").cast("long").alias("doc"), "measure_index", place.alias("note_seq"), "pos")


@query(
    "WITH RECURSIVE x AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) seq, CAST(l_partkey % 60 AS DOUBLE) x0, l_partkey % 60 + l_quantity x1 FROM lineitem),"
    " f AS (SELECT l_orderkey, seq, 0 lane, [x1] ends FROM x WHERE seq = 1 UNION ALL SELECT l_orderkey, seq, slot - 1, CASE WHEN slot > len(ends) THEN list_append(ends, x1) ELSE list_concat(list_append(ends[1:slot - 1], x1), ends[slot + 1:]) END"
    " FROM (SELECT x.*, f.ends, CAST(coalesce(nullif(list_position(list_transform(f.ends, lambda e: e <= x.x0), true), 0), len(f.ends) + 1) AS INT) slot FROM f JOIN x ON x.l_orderkey = f.l_orderkey AND x.seq = f.seq + 1)) SELECT l_orderkey, seq, lane FROM f"
)
def q346_text_lanes(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    x0 = (F.col("l_partkey") % 60).cast("double")
    rows = ad.table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("seq"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"))
    return sc.text_lanes(rows, ["l_orderkey"])


@query(
    "WITH c AS (SELECT s_suppkey, a accent, CASE WHEN s_suppkey % 10 > 1 THEN s_suppkey % 10 * 1000.0::DOUBLE ELSE 44100 END rate FROM supplier, (VALUES (false), (true)) v(a)), n AS (SELECT *, CAST(round(0.035 * rate) AS INT) n FROM c)"
    " SELECT s_suppkey, accent, k, round(CASE WHEN accent THEN 0.4 ELSE 0.25 END * (n - k) / n * sin(2 * pi() * CASE WHEN accent THEN 1500 ELSE 1000 END * k / rate), 6) + 0.0 AS sample FROM n, range(0, 1600) r(k) WHERE k < n"
)
def q469_click_samples(spark, d):
    k = F.col("s_suppkey")
    rows = ad.table(spark, d, "supplier").withColumn("accent", F.explode(F.array(F.lit(False), F.lit(True))))
    samples = music.click(F.col("accent"), k % 10 * 1000 - F.when(k % 10 == 1, 1000).otherwise(0))
    return rows.select("s_suppkey", "accent", F.posexplode(samples).alias("k", "s")).select("s_suppkey", "accent", F.col("k").cast("long").alias("k"), (F.round("s", 6) + F.lit(0.0)).alias("sample"))


@query()
def q508_playback(spark, d):
    """Wait-mode playback of every score: 30 ticks of 400 ms; each of its pitches is pressed before every third to seventh tick."""
    notes = ad.timed(spark, d).select("doc", "pitch", "start_ms", "duration_ms")
    ticks = notes.select("doc").distinct().withColumn("k", F.explode(F.expr("sequence(1L, 30L)")))
    ticks = ticks.select("doc", (F.col("k") * 1000).alias("seq"), F.lit("tick").alias("kind"), F.lit(400.0).alias("value"), F.lit(None).cast("long").alias("pitch"))
    press = notes.select("doc", "pitch").distinct().withColumn("k", F.explode(F.expr("sequence(3 + pitch % 5, 30L, 3 + pitch % 5)")))
    press = press.select("doc", (F.col("k") * 1000 - 1 - F.col("pitch")).cast("long").alias("seq"), F.lit("press").alias("kind"), F.lit(None).cast("double").alias("value"), "pitch")
    return pb.play(notes, ticks.unionByName(press), ad.tasks(spark, d))
