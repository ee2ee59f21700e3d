"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words. A random walk copies a window of the length of an item into a longer string: at every step
it emits the present word and moves on or stays, by a random bit of the step and the word. Two windows at a small edit
distance fall into step again after each edit, so their strings differ in few places (Hamming distance). Each repeat takes
a walk of its own and compares ``SAMPLES`` of its places. What is met is verified by the exact edit distance.

The chance that a walk stays in step falls with the number of edits before a place, so no fixed number of repeats serves
all lengths. Items of over ``PIECE`` words are therefore looked up by near-equal pieces of at most that many: of t pieces
one has at most a t-th of the edits, which puts it at the distance of a short item, and each of the others is one more
chance. ``REPEATS`` and ``SAMPLES`` are set for ``TARGET`` at the largest distance of an item of PIECE words; tests measure
recall at the largest distance from 10 to 1,000 words. The item is then verified whole. So neither the walks nor their
memory (eight bytes a word of the vocabulary and repeat) depend on the longest item.

Before the walk two lossless count filters drop windows with more words outside the items' vocabulary, or more pairs of
neighbouring words that no item has, than the edits allow.
Items go to the executors in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents for each block.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, map_arrow, resident, restored

#: Edits allowed, as a share of the item's words (rounded down, and at least one from MIN_WORDS words on).
SHARE = 0.1
MIN_WORDS = 8
TARGET = 0.95
REPEATS = 10
SAMPLES = 3
#: Words of the longest window; its walk has 63 steps, one for each bit of a random number.
PIECE = 42
BLOCK_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")
#: Words of documents that are embedded at once.
CHUNK = 1 << 20
#: Cells of the windows that walk at once.
CELLS = 1 << 22


def word_list(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []


def edits(n_words: int) -> int:
    return max(int(SHARE * n_words), 1) if n_words >= MIN_WORDS else 0


class Index:
    """Items of one block with their walks and keys."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 7):
        self.items = [(i, w) for i, w in ((i, word_list(t)) for i, t in items) if w]
        self.vocab = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in self.items for w in ws))}
        self.other = len(self.vocab)  # every word that no item has; also stands for places behind a document's end
        self.codes = [np.array([self.vocab[w] for w in ws], dtype=np.int32) for _, ws in self.items]
        self.pairs = np.zeros(1 << 20, dtype=bool)  # hashes of the items' neighbouring words
        #: (item, first word, codes) of each piece, and the most edits that windows of each length may have
        self.pieces: list[tuple[int, int, np.ndarray]] = []
        self.allowed: dict[int, int] = {}
        for k, c in enumerate(self.codes):
            self.pairs[self.pair_hash(c)] = True
            parts = -(-len(c) // PIECE)
            bounds = [len(c) * q // parts for q in range(parts + 1)]
            for a, b in zip(bounds, bounds[1:]):
                self.pieces.append((k, a, c[a:b]))
                self.allowed[b - a] = max(self.allowed.get(b - a, 0), edits(len(c)) // parts)
        self.lengths = sorted(self.allowed)
        self.most = max(self.allowed.values(), default=0)
        rng = np.random.default_rng(seed)
        # bit j of a word's number is its bit at step j; windows of all lengths share the numbers, as they never meet
        self.random = [rng.integers(0, 1 << 63, size=self.other + 2, dtype=np.int64) for _ in range(REPEATS)]
        self.walks: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for m in self.lengths:
            own = [k for k, (_, _, c) in enumerate(self.pieces) if len(c) == m]
            text = np.concatenate([self.pieces[k][2] for k in own])
            starts = np.arange(len(own), dtype=np.int64) * m
            self.walks[m] = []
            for random in self.random:
                steps = -(-3 * m // 2)  # further on most walks have left the window
                places = np.sort(rng.choice(steps, size=min(SAMPLES, steps), replace=False))
                keys = self.walk(self.windows(text, starts, m), places, random)
                order = np.argsort(keys, kind="stable")
                self.walks[m].append((places, random, keys[order], np.array(own)[order]))

    def pair_hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes[:-1].astype(np.int64) * 1_000_003 + codes[1:]) * 40_503 >> 3) & (len(self.pairs) - 1)

    def windows(self, text: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        """The windows as rows, each followed by as many marks of its end as a walk of 3/2 m steps can reach."""
        out = np.full((len(starts), -(-5 * m // 2) + 1), self.other + 1, dtype=np.int32)
        out[:, :m] = np.lib.stride_tricks.sliding_window_view(text, m)[starts]
        return out

    def walk(self, windows: np.ndarray, places: np.ndarray, random: np.ndarray) -> np.ndarray:
        """The key of each window: the words at the sampled places of its embedding."""
        flat = windows.reshape(-1)
        at = np.arange(len(windows), dtype=np.int64) * windows.shape[1]
        key = np.zeros(len(windows), dtype=np.int64)
        last, sampled = int(places[-1]), set(places.tolist())
        for j in range(last + 1):
            word = flat.take(at)
            if j in sampled:
                key = key * (self.other + 2) + word  # wraps around: equal windows keep equal keys
            if j < last:
                at += random.take(word) >> j & 1
        return key

    def candidates(self, text: np.ndarray, outside: np.ndarray):
        """Pairs (start, piece index) over one coded stretch of documents; ``outside`` sums words without code."""
        odd = np.concatenate(([0], np.cumsum(~self.pairs[self.pair_hash(text)])))
        for m in self.lengths:
            if len(text) < m:
                continue
            # of a stretch within k edits and the words behind it, up to the piece's length, at most k are not the piece's
            k = self.allowed[m]
            starts = np.flatnonzero(outside[m:] - outside[:-m] <= k)
            # an edit makes at most two pairs of neighbours that the item does not have
            starts = starts[odd[starts + m - 1] - odd[starts] <= 2 * k]
            if not len(starts):
                continue
            step = max(1, CELLS // (5 * m // 2 + 2))
            for at in range(0, len(starts), step):
                for pair in self._met(text, starts[at : at + step], m):
                    yield divmod(int(pair), len(self.pieces))

    def _met(self, text: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        """Sorted numbers start * pieces + piece of the windows and pieces that meet in any repeat."""
        met, rows = [np.zeros(0, dtype=np.int64)], self.windows(text, starts, m)
        for places, random, keys, own in self.walks[m]:
            found = self.walk(rows, places, random)
            low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            hit = np.flatnonzero(high > low)
            for k in range(int((high - low).max(initial=0))):
                more = hit[low[hit] + k < high[hit]]
                met.append(starts[more] * len(self.pieces) + own[low[more] + k])
        return np.unique(np.concatenate(met))


def _index(items: tuple) -> Index:
    """Built once per worker and block."""
    return resident(("items", items), lambda: Index(list(items)))


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the item to any stretch of the text, where the first such stretch ends): bit-parallel rows."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def scan(index: Index, ids: list, texts: list):
    """Rows (id, item_id, distance, end_word) of a batch: one for each document and item, the nearest first occurrence."""
    gap, other = index.most, index.other
    at, stop, size, codes = 0, [], 0, []
    begin = 0
    for k, text in enumerate(texts):
        words = word_list(text)
        code = np.full(len(words) + gap + 1, other, dtype=np.int32)
        get = index.vocab.get
        code[: len(words)] = [get(w, other) for w in words]
        codes.append(code)
        stop.append(len(code))
        size += len(code)
        if size < CHUNK and k + 1 < len(texts):
            continue
        joined = np.concatenate(codes)
        ends = np.cumsum(stop)
        weight = (joined == other).astype(np.int64)
        weight[ends - 1] = len(joined) + 10**6  # no window goes on into the next document
        outside = np.concatenate(([0], np.cumsum(weight)))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        looked: set[tuple[int, int, int]] = set()
        for start, piece in index.candidates(joined, outside):
            doc = int(np.searchsorted(ends, start, "right"))
            first = int(ends[doc - 1]) if doc else 0
            item, offset, _ = index.pieces[piece]
            m = len(index.codes[item])
            allowed = edits(m)
            wide = 1 + allowed // 2  # items that would begin within so many words are looked at together
            begin_at = (start - offset - first) // wide
            if (doc, item, begin_at) in looked:
                continue
            looked.add((doc, item, begin_at))
            low = max(first, first + begin_at * wide - allowed)
            high = min(int(ends[doc]) - 1 - gap, first + (begin_at + 1) * wide + m + 2 * allowed)
            distance, end = best_match(index.codes[item].tolist(), joined[low:high].tolist())
            value = (distance, low + end - first)
            if distance <= allowed and value < found.get((doc, item), (m + 1, 0)):
                found[doc, item] = value
        for (doc, item), (distance, end) in sorted(found.items()):
            yield ids[begin + doc], index.items[item][0], distance, end
        begin, codes, stop, size = k + 1, [], [], 0


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, n_words, distance, end_word): every document and item it holds within the allowed edits.

    ``n_words`` is the item's length, ``end_word`` where the nearest stretch ends, in words of the document. Null and wordless
    texts and items hold nothing and are held by nothing. Repeated items and rows give their rows each. An empty
    benchmark or document table gives an empty result. Texts and items of any length are matched whole.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, n_words long, distance int, end_word long"
    parts, block, held = [], [], 0
    items = benchmark.where(F.col(item_text).isNotNull()).select(item_col, item_text).orderBy(item_col, item_text)
    for row in items.toLocalIterator():  # item by item: the driver holds one block at a time
        block.append((len(block), row[1], row[0]))
        held += len(row[1]) // 4 + 1
        if held >= BLOCK_WORDS:
            parts.append(_pass(docs, block, id_col, text_col, schema))
            block, held = [], 0
    if block or not parts:
        parts.append(_pass(docs, block, id_col, text_col, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _pass(docs: DataFrame, block: list, id_col: str, text_col: str, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        index = _index(tuple((k, t) for k, t, _ in shared.value))
        length = {i: len(w) for i, w in index.items}
        names = {k: name for k, _, name in shared.value}

        def batch(ids, texts):
            rows = list(scan(index, ids, texts)) if index.items else []
            return [r[0] for r in rows], [names[r[1]] for r in rows], [length[r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows]

        return batch

    return map_arrow(docs, [id_col, text_col], make, schema, 4096)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item. Rows with a null id stay."""
    found = leaks(docs.select(id_col, text_col), benchmark, id_col, text_col).select(F.col(id_col).alias("found")).distinct()
    rows = carried(docs, id=F.col(id_col))
    return restored(rows.join(found, F.col("id") == F.col("found"), "left_anti"), docs)
