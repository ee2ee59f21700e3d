"""Substring dedup over sliding sentence spans.

From every sentence starts a span: the shortest run of at least ``RUN`` sentences and ``WORDS`` words. Spans are hashed and
joined over all documents; sentences that lie in any span which is not that span's first occurrence are removed. "First"
is by document id, then by the document's text where ids repeat, then by place. Sentences end at ``.``, ``!`` or ``?`` before
white space and at line ends. In every ``PLACES`` places between words on end without a sentence end, the place with the least
hash of its two words is a cut. Each window of PLACES places thus holds a sentence end or a cut that its own words decide, and
what stands before or behind a passage can add cuts only before its first and behind its last such place. A passage of
over 50 words has at least 50 places and so four boundaries that every copy shares: it holds a span whatever its
punctuation and wherever it begins.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

RUN = 3
WORDS = 12
PLACES = 12
_WORD = re.compile(r"\S+\s*")


class Marks(dict):
    """Lower-cased word -> 64-bit hash, its last bit telling whether the word ends a sentence; the bound changes speed only."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | (word[-1] in ".!?")
        return h


def boundaries(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a sentence or a piece of one ends behind each word, given the marks of the words and where sentences end."""
    if len(marks) <= PLACES:  # no window of places between words
        return ends
    h = (marks[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (marks[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    h[ends[:-1]] = 0
    least, wide = h, 1  # of the ``wide`` places from each on
    while wide < PLACES:
        step = min(wide, PLACES - wide)
        least, wide = np.minimum(least[: len(least) - step], least[step:]), wide + step
    # A place is chosen where it is the least of any window that holds it: the greatest of those windows' minima is its own.
    most, wide = np.zeros(len(least) + 2 * (PLACES - 1), np.uint64), 1
    most[PLACES - 1 : PLACES - 1 + len(least)] = least
    while wide < PLACES:
        step = min(wide, PLACES - wide)
        most, wide = np.maximum(most[: len(most) - step], most[step:]), wide + step
    out = ends.copy()
    out[:-1] |= most == h
    return out


def cut(text: str, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """The marks of the text's words, and how many words lie before the end of each sentence or piece of one."""
    words, lines = [], []
    for line in text.lower().split("\n"):
        words += line.split()
        lines.append(len(words))
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = np.fromiter(map(marks.__getitem__, words), np.uint64, len(words))
    ends = (found & np.uint64(1)).astype(bool)
    closed = np.array(lines[:-1], np.int64)
    ends[closed[closed > 0] - 1] = True
    out = boundaries(found, ends)
    out[-1] = True
    return found, np.flatnonzero(out) + 1


def sentences(text: str | None, marks: Marks | None = None) -> list[str]:
    """The text in order as sentences and pieces of them with the white space after each; they join to the text."""
    text = text or ""
    parts = _WORD.findall(text)
    if not parts:
        return [text] if text else []
    bounds = cut(text, Marks() if marks is None else marks)[1].tolist()
    parts[0] = text[: len(text) - sum(map(len, parts))] + parts[0]
    return ["".join(parts[a:b]) for a, b in zip([0, *bounds], bounds)]


_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """The powers of both bases and of their inverses, modulo 2**64; a longer text than ``LIMIT`` words has tables of its own."""

    LIMIT = 1 << 16

    def __init__(self):
        self.known = self._made(1 << 12)

    @staticmethod
    def _made(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(_powers(b, n), _powers(pow(b, -1, 1 << 64), n)) for b in _BASES.tolist()]

    def of(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n <= len(self.known[0][0]):
            return self.known
        if n > self.LIMIT:
            return self._made(n)
        self.known = self._made(self.LIMIT)
        return self.known


def hashed(found: np.ndarray, bounds: np.ndarray, powers: Powers, run: int = RUN, least: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, sentences) of the span from each sentence on that has one: two polynomials over the marks of its words.

    A sentence's last word has another mark than the same word elsewhere, so that sentences count.
    """
    starts = np.concatenate([[0], bounds[:-1]])
    after = np.maximum(np.arange(len(bounds)) + run, np.searchsorted(bounds, starts + least) + 1)
    after = after[: np.searchsorted(after, len(bounds), "right")]
    low, high, hashes = starts[: len(after)], bounds[after - 1], []
    marks = found.copy()
    marks[bounds - 1] ^= np.uint64(0x5851F42D4C957F2D)
    for up, down in powers.of(len(found)):
        total = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(marks * up[: len(found)], out=total[1:])
        hashes.append(((total[high] - total[low]) * down[low]).view(np.int64))
        marks = (marks ^ marks >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return *hashes, after - np.arange(len(after))


def spans(parts: list[str], run: int = RUN, least: int = WORDS) -> list[tuple[int, int, int, int]]:
    """(h1, h2, first sentence, sentences) of every span; cases and the width of white space do not count."""
    words = [w for p in parts if (w := p.lower().split())]
    if not words:
        return []
    marks = Marks()
    found = np.array([marks[w] for part in words for w in part], np.uint64)
    h1, h2, n = hashed(found, np.cumsum([len(part) for part in words]), Powers(), run, least)
    return list(zip(h1.tolist(), h2.tolist(), range(len(n)), n.tolist()))


#: Documents whose spans are compared before they are dealt out.
TOGETHER = 1024


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, t, pos, n) of every span of ``docs`` (id, t, text) that is not its first occurrence.

    Of a span that TOGETHER documents hold several times, only the first is compared with other documents; the rest are
    known to be repeats and are dealt out by a number of their own, so that a common span does not meet in one task.
    """

    def make():
        marks, powers = Marks(), Powers()

        def batch(ids, ts, texts):
            order = [(key is not None, key, t) for key, t in zip(ids, ts)]
            rank = {x: k for k, x in enumerate(sorted(set(order)))}
            docs, made = sorted(range(len(ids)), key=lambda k: rank[order[k]]), []
            for k in docs:
                found, bounds = cut(texts[k] or "", marks)
                made.append(hashed(found, bounds, powers) if len(bounds) >= RUN else (np.zeros(0, np.int64),) * 3)
            if not made:
                return [[] for _ in range(7)]
            h1, h2, n = map(np.concatenate, zip(*made))
            size = [len(x) for _, _, x in made]
            doc, place = np.repeat(docs, size), np.concatenate([np.arange(x) for x in size])
            same = np.repeat([rank[order[k]] for k in docs], size)
            # rows are in order of documents and places, so a span's first row in ``by`` is its first occurrence
            by = np.argsort(h1, kind="stable")
            new = np.ones(len(by), bool)
            new[1:] = (h1[by[1:]] != h1[by[:-1]]) | (h2[by[1:]] != h2[by[:-1]])
            first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            again = (same[by] == same[first]) & (place[by] == place[first])  # the same document again
            by, known = by[new | ~again], ~new[new | ~again]
            doc, place = doc[by], place[by]
            t = np.array(ts, np.int64)[doc]
            h1, h2 = np.where(known, t * 0x1E3779B97F4A7C15 ^ place, h1[by]), np.where(known, place, h2[by])
            return [ids[k] for k in doc.tolist()], t, h1, h2, place.astype(np.int32), n[by].astype(np.int32), known

        return batch

    kind = docs.schema["id"].dataType.simpleString()
    found = map_arrow(docs, ["id", "t", "text"], make, f"id {kind}, t long, h1 long, h2 long, pos int, n int, known boolean", TOGETHER)
    # rows that repeat both id and text are one document: they have one rank
    order = F.rank().over(Window.partitionBy("h1", "h2", "known").orderBy("id", "t", "pos"))
    return found.withColumn("order", order).where("known or order > 1").select("id", "t", "pos", "n")


def dedup_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, n_removed, text) of every row, the text without its repeated sentences.

    A null text stays null with 0 sentences. Texts with fewer sentences than a span lose nothing. A null id comes before
    all others. Rows that repeat both id and text are one document and get the same result each; rows that share only
    the id are told apart by their text. Further columns are not read.
    """
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(7), id_col, text_col).alias("t"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    covered = repeated_spans(docs)
    places = covered.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("pos", "n")).alias("places"))
    rows = docs.join(places, F.col("id").eqNullSafe(F.col("_id")) & F.col("t").eqNullSafe(F.col("_t")), "left")

    def make():
        marks = Marks()

        def batch(ids, texts, places):
            n, gone, out = [], [], []
            for text, at in zip(texts, places):
                if not at:  # nothing goes, so the number of sentences is enough
                    n.append(len(cut(text, marks)[1]) or 1 if text else 0)
                    gone.append(0)
                    out.append(text)
                    continue
                parts = sentences(text, marks)
                drop = {k for x in at for k in range(x["pos"], x["pos"] + x["n"])}
                n.append(len(parts))
                gone.append(len(drop))
                out.append("".join(p for k, p in enumerate(parts) if k not in drop))
            return ids, n, gone, out

        return batch

    out = map_arrow(rows, ["id", "text", "places"], make, f"id {kind}, n_sentences long, n_removed long, text string")
    return out.withColumnRenamed("id", id_col)

