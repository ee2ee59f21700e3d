"""Score files: one row per note, direction, clef and measure attribute of symbolic score XML, in document order.

Files are read with Spark's binary reader and parsed one by one in the tasks with a streaming parser; siblings keep their
order, which a reader that groups by tag would lose. Positions come from the saturating time cursor of a measure.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

EVENTS = (
    "doc string, measure_index int, note_seq int, kind string, staff int, voice int, dur long, step string, octave int, alter int, is_rest boolean, note_type string, dots int,"
    " tie_start boolean, tie_stop boolean, slur_start boolean, slur_stop boolean, actual int, sign string, line int, text string, error string"
)
#: Elements that are read as a whole when they close.
HOLDING = ("measure", "note", "attributes", "direction", "backup", "forward")
COLUMNS = [c.split()[0] for c in EVENTS.split(",")]


def _number(text: str | None, old: int | None) -> int | None:
    """The number in a text; the old value where there is none or it is no number."""
    try:
        return int((text or "").strip())
    except ValueError:
        return old


def _int(e: ET.Element | None, path: str, old: int | None) -> int | None:
    """The number below ``path``; the old value where there is none or it is no number."""
    return _number(e.findtext(path, "") if e is not None else None, old)


def _direction(e: ET.Element) -> tuple[str, str] | None:
    """Kind and text of a direction, the last one where it has several; None for kinds that are not kept."""
    found = None
    for at in e.iter():
        if at.tag == "words":
            found = "words", (at.text or "").strip()
        elif at.tag == "dynamics":
            found = "dynamics", next((x.tag for x in at), "")
        elif at.tag == "wedge":
            found = "wedge", at.get("type", "")
        elif at.tag == "metronome":
            found = "metronome", str(_int(at, "per-minute", 0))
    return found


def _closed(e: ET.Element, part: int) -> list[tuple[str, dict]]:
    """(kind, values) of the rows that an element makes when it closes in the given part."""
    if e.tag == "note" and part == 1:
        kinds = [(x.tag, x.get("type")) for x in e.iter() if x.tag in ("tie", "slur")]
        pitch = e.find("pitch")
        return [(
            "chord" if e.find("chord") is not None else "note",
            dict(
                staff=_int(e, "staff", 1), voice=_int(e, "voice", 1), dur=_int(e, "duration", 0),
                step=None if pitch is None else pitch.findtext("step"), octave=None if pitch is None else _int(pitch, "octave", 4), alter=_int(pitch, "alter", 0),
                is_rest=e.find("rest") is not None, note_type=e.findtext("type"), dots=len(e.findall("dot")),
                tie_start=("tie", "start") in kinds, tie_stop=("tie", "stop") in kinds, slur_start=("slur", "start") in kinds, slur_stop=("slur", "stop") in kinds,
                actual=_int(e, "time-modification/actual-notes", 0) or None, text=e.findtext("lyric/text"),
            ),
        )]
    if e.tag in ("backup", "forward") and part == 1:
        return [(e.tag, {"dur": _int(e, "duration", 0)})]
    if e.tag == "attributes":  # of every part: the last value of a document wins
        rows = []
        for name in ("divisions", "key/fifths", "time/beats", "time/beat-type", "staves"):
            if (value := _int(e, name, None)) is not None:  # what is no number leaves the old value
                rows.append((name.rsplit("/", 1)[-1], {"dur": value}))
        return rows + [("clef", {"staff": _number(c.get("number"), 1), "sign": c.findtext("sign", "G"), "line": _int(c, "line", 2)}) for c in (e.findall("clef") if part == 1 else ())]
    if e.tag == "direction" and part == 1 and (d := _direction(e)):
        return [(d[0], {"staff": _int(e, "staff", 1), "text": d[1]})]
    if e.tag == "work-title":
        return [("title", {"text": e.text})]
    if e.tag == "creator" and e.get("type") == "composer":
        return [("composer", {"text": e.text})]
    return [("measure", {})] if e.tag == "measure" and part == 1 else []


def streamed(doc: str, stream: BinaryIO) -> Iterator[dict]:
    """Rows of EVENTS of one file: note, chord, backup, forward, clef, direction, attribute kinds.

    Only the first part's measures count. Rows go out when their measure closes; closed elements leave the tree, which holds
    no more than the open elements and one measure. What is not a score has no rows; broken markup ends with a row of its error.
    """
    part, measure, seq, rows, above = 0, -1, 0, [], []

    def row(kind: str, **more) -> None:
        nonlocal seq
        rows.append({"doc": doc, "measure_index": max(measure, 0), "note_seq": seq, "kind": kind} | more)
        seq += 1

    try:
        for event, e in ET.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(e)
                part += e.tag == "part"
                if e.tag == "measure" and part == 1:
                    measure, seq = measure + 1, 0
                continue
            above.pop()
            for kind, more in _closed(e, part):
                row(kind, **more)
            if not any(x.tag in HOLDING for x in above):  # nothing above asks for it any more
                if above:
                    above[-1].remove(e)
                yield from rows
                rows = []
    except (ET.ParseError, ValueError) as error:
        yield from rows
        yield {"doc": doc, "measure_index": max(measure, 0), "note_seq": seq, "kind": "error", "error": str(error)}


#: Children of a note that hold one text or nothing, and what they become; a pitch holds three such.
FLAT = {"duration": ("dur", 0), "staff": ("staff", 1), "voice": ("voice", 1)}
MARKS = ("chord", "rest", "dot", "type", "tie", "slur", "pitch", *FLAT)
#: Elements that count or make rows of their own.
OWN = frozenset(("part", "measure", "note", "backup", "forward", "attributes", "direction", "work-title", "creator"))
#: Bytes up to which a file is parsed as one tree.
SMALL = 1 << 20


class _Tree:
    """Rows of a small file as ``streamed`` makes them, from one tree: plain notes are read in one pass over their children.

    Anything that is not plain goes element by element, in the order in which elements close.
    """

    def __init__(self, doc: str, kinds: frozenset[str] | None):
        self.doc, self.kinds, self.part, self.measure, self.seq, self.rows = doc, kinds, 0, -1, 0, []
        self.notes = kinds is None or bool(kinds & {"note", "chord"})

    def row(self, kind: str, **more) -> None:
        if self.kinds is None or kind in self.kinds:
            self.rows.append({"doc": self.doc, "measure_index": max(self.measure, 0), "note_seq": self.seq, "kind": kind} | more)
        self.seq += 1

    def visit(self, e: ET.Element) -> None:
        tag = e.tag
        if tag == "note" and self.part == 1 and self.plain(e):
            return
        if tag == "part":
            self.part += 1
        elif tag == "measure" and self.part == 1:
            self.measure, self.seq = self.measure + 1, 0
        for x in e:
            if len(x) or x.tag in OWN:
                self.visit(x)
        if tag in OWN:
            for kind, more in _closed(e, self.part):
                self.row(kind, **more)

    def plain(self, e: ET.Element) -> bool:
        """Makes the row of a note whose children are all known and flat; False, without a row, for any other."""
        for x in e:
            if x.tag not in MARKS or len(x) and (x.tag != "pitch" or any(len(y) or y.tag not in ("step", "alter", "octave") for y in x)):
                return False
        if not self.notes:
            self.seq += 1
            return True
        kind, out = "note", {"staff": 1, "voice": 1, "dur": 0, "step": None, "octave": None, "alter": 0, "is_rest": False, "note_type": None, "dots": 0, "tie_start": False, "tie_stop": False, "slur_start": False, "slur_stop": False, "actual": None, "text": None}
        seen = set()
        for x in e:
            tag = x.tag
            if tag == "chord":
                kind = "chord"
            elif tag == "rest":
                out["is_rest"] = True
            elif tag == "dot":
                out["dots"] += 1
            elif tag in ("tie", "slur"):
                if x.get("type") in ("start", "stop"):
                    out[f"{tag}_{x.get('type')}"] = True
            elif tag not in seen:  # of several the first
                seen.add(tag)
                if tag == "pitch":
                    out["step"], out["octave"], out["alter"] = x.findtext("step"), _int(x, "octave", 4), _int(x, "alter", 0)
                elif tag == "type":
                    out["note_type"] = x.text or ""
                else:
                    name, old = FLAT[tag]
                    out[name] = _number(x.text, old)
        self.row(kind, **out)
        return True


def parse(doc: str, content: bytes, kinds: frozenset[str] | None = None) -> Iterator[dict]:
    """``streamed`` of a file's bytes, rows of ``kinds`` alone where these are given; broken markup has one row with its error and no others."""
    if len(content) <= SMALL:
        try:
            tree = _Tree(doc, kinds)
            tree.visit(ET.fromstring(content))
        except (ET.ParseError, ValueError, RecursionError):  # the stream tells what is wrong
            pass
        else:
            yield from tree.rows
            return
    rows = list(streamed(doc, io.BytesIO(content)))
    if rows and rows[-1]["kind"] == "error":
        rows = [rows[-1] | {"measure_index": 0, "note_seq": 0}]
    yield from (r for r in rows if kinds is None or r["kind"] in kinds or r["kind"] == "error")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """EVENTS of every file under ``path``; ``doc`` is the file's path."""
    return parse_scores(spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content"))


#: Rows that go out of a task at once, whole files of them.
ROWS = 8192


def parse_scores(files: DataFrame, kinds: tuple[str, ...] | None = None, columns: list[str] | None = None) -> DataFrame:
    """EVENTS of the files (doc, content), or of them the rows of ``kinds`` and of errors, and the ``columns``."""

    schema = files.sparkSession.createDataFrame([], EVENTS).select(*(columns or ["*"])).schema
    arrow, wanted = to_arrow_schema(schema), None if kinds is None else frozenset(kinds)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], type=f.type) for f in arrow], schema=arrow)

    def run(batches):
        for given in batches:
            rows = []
            for i in range(given.num_rows):
                rows += parse(given.column(0)[i].as_py(), given.column(1)[i].as_py() or b"", wanted)
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return files.select("doc", "content").mapInArrow(run, schema)


#: Kinds that ``documents`` asks for.
DOCUMENT = ("title", "composer", "divisions", "fifths", "beats", "beat-type", "staves", "metronome", "measure")


def documents(events: DataFrame) -> DataFrame:
    """(doc, title, composer, divisions, fifths, beats, beat_type, staves, bpm, measures) with defaults.

    The last value of an attribute wins over the document, and the last title and composer that are not empty; the tempo is the first positive metronome mark, 90 without one.
    """
    order = F.struct("measure_index", "note_seq")

    def last(kind: str, default: int):
        return F.coalesce(F.max_by("dur", F.when(F.col("kind") == kind, order)), F.lit(default))

    def named(kind: str):
        return F.max_by(F.trim("text"), F.when((F.col("kind") == kind) & (F.trim("text") != ""), order))

    positive = (F.col("kind") == "metronome") & (F.expr("try_cast(text as int)") > 0)
    return events.where("kind <> 'error'").groupBy("doc").agg(
        named("title").alias("title"), named("composer").alias("composer"),
        last("divisions", 1).alias("divisions"), last("fifths", 0).alias("fifths"), last("beats", 4).alias("beats"), last("beat-type", 4).alias("beat_type"),
        F.greatest(F.lit(1), last("staves", 1)).alias("staves"),
        F.coalesce(F.min_by(F.expr("try_cast(text as int)"), F.when(positive, order)), F.lit(90)).alias("bpm"),
        F.count_if(F.col("kind") == "measure").alias("measures"),
    )


def measure_clefs(events: DataFrame) -> DataFrame:
    """(doc, measure_index, staff, sign, line): each measure's clef changes, the last one of a staff."""
    rows = events.where("kind = 'clef'").groupBy("doc", "measure_index", "staff")
    return rows.agg(F.max_by(F.struct("sign", "line"), "note_seq").alias("c")).select("doc", "measure_index", "staff", F.substring("c.sign", 1, 1).alias("sign"), "c.line")


def first_clefs(events: DataFrame) -> DataFrame:
    """(doc, staff, sign, line): the first clef of each staff of a document; later ones are changes of their measures."""
    rows = events.where("kind = 'clef'").groupBy("doc", "staff")
    return rows.agg(F.min_by(F.struct("sign", "line"), F.struct("measure_index", "note_seq")).alias("c")).select("doc", "staff", F.substring("c.sign", 1, 1).alias("sign"), "c.line")
