"""Phrase collocation mining by vertical positional inverted lists.

Tasks hold documents in blocks of ``BLOCK_WORDS`` words. A block's inverted lists name, for each word and later for each phrase,
the positions where it begins. Lists of phrases are extended a word at a time: the occurrence positions, moved on by the phrase's
length, are merge-joined with the postings of the words that stand there, and each pair of phrase and word is a new list. The
length of a list is the phrase's exact frequency in the block; the sums over all blocks are exact frequencies.

Most lists of a block belong to phrases that are rare in the whole corpus. Two passes before the mining find out which cannot be
frequent: they count hashed phrases (32 bits), words and pairs first, then those phrases of three and four words whose pairs are
all frequent. A task sends the distinct buckets of each of its chunks as packed bytes, two bytes a bucket; one task at a time
adds up one range of buckets in an array of fixed size. What comes back is a bitmap of ``FILTER`` bytes at every size of the
corpus. A bucket below the least frequency rules its phrases out, so no frequent phrase is lost; a crowded bitmap lets more lists
through and costs time, not results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, release, stored, vacate

LEAST, LONGEST = 30, 4
#: A phrase goes where a longer one around it has this many hundredths of its frequency.
COVERED = 80
TOP = 2000
UNKNOWN = "und"
BLOCK_WORDS = 1 << 20
#: Phrases whose list lengths a task adds up over its blocks before it sends them.
COMBINED = 1 << 20
#: Hashed phrases that a task holds before it packs and sends them.
CHUNK = 1 << 22
#: Ranges of buckets, buckets of each, and neighbouring buckets that share a bit of the bitmap.
RANGES, WIDTH, FOLD = 1 << 10, 1 << 22, 1 << 5
FILTER = RANGES * WIDTH // FOLD // 8
#: Piece borders, as a byte that UTF-8 does not have.
BORDER = b"\xff"
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def stream(text: str | None) -> list[bytes]:
    """Lower-cased words, with BORDER at the ends of pieces and of the text."""
    return (text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).replace(BORDER, b" \xff ") + b" \xff").split() if text else [BORDER]


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    out = (h ^ word) * _MIX
    return out ^ (out >> _SHIFT)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


class Bitmap:
    """Which hashed phrases may be frequent."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def __contains__(self, h: int) -> bool:
        return bool(self.test(np.array([h], dtype=np.uint64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        at = _buckets(h) // np.uint32(FOLD)
        return (self.packed[at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & np.uint8(1) != 0


def _seed(lang: str) -> np.uint64:
    return np.uint64(WordHash()[b"lang " + lang.encode("utf-8", "surrogatepass")])


def _grams(words: np.ndarray, inside: np.ndarray, seed: np.ndarray, longest: int):
    """For each length, (hashes of the runs that begin at each position, whether the run lies in one piece)."""
    h, ok = _mixed(seed, words), inside
    yield h, ok
    for k in range(1, longest):
        h, ok = _mixed(h[:-1], words[k:]), ok[:-1] & inside[k:]
        yield h, ok


def _packed(buckets: np.ndarray):
    """Rows (part, subs, low, n) of a chunk's distinct buckets: entries of each sixteen-bit range, low halves, counts up to LEAST."""
    buckets.sort()
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    n = np.minimum(np.diff(np.append(first, len(buckets))), LEAST).astype(np.uint8)
    buckets = buckets[first]
    per = WIDTH >> 16
    subs = np.bincount(buckets >> np.uint32(16), minlength=RANGES * per).astype(np.uint32).reshape(RANGES, per)
    ends = np.concatenate(([0], np.cumsum(subs.sum(axis=1, dtype=np.int64))))
    low = (buckets & np.uint32(0xFFFF)).astype(np.uint16)
    full = np.flatnonzero(np.diff(ends))
    return [full.tolist(), [subs[p].tobytes() for p in full], [low[ends[p] : ends[p + 1]].tobytes() for p in full], [n[ends[p] : ends[p + 1]].tobytes() for p in full]]


def _bucket_counts(lengths: tuple[int, ...], known):
    """Packed bucket counts of the phrases of ``lengths`` words; with ``known``, of those whose pairs it holds."""

    def run(batches):
        vacate()
        words, held, size = WordHash(), [], 0
        seeds: dict[str, np.uint64] = {}

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_packed(np.concatenate(held)), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "subs", "low", "n"])

        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                found, counts, of = [], [], []
                for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                    own = stream(text)
                    found += own
                    counts.append(len(own))
                    if lang not in seeds:
                        seeds[lang] = _seed(lang)
                    of.append(seeds[lang])
                h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
                inside = h != np.uint64(words[BORDER])
                pairs = None
                for k, (g, ok) in enumerate(_grams(h, inside, np.repeat(np.array(of, dtype=np.uint64), counts), max(lengths)), 1):
                    if known and k == 2:
                        pairs = known.value.test(g) & ok
                    if k in lengths:
                        if known:
                            ok = ok & np.logical_and.reduce([pairs[j : j + len(ok)] for j in range(k - 1)])
                        held.append(_buckets(g[ok]))
                        size += len(held[-1])
                if size >= CHUNK:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    return run


def _added(batches):
    """The bitmap of each range of buckets, out of its packed counts, which follow each other."""
    dense, full, now = np.zeros(WIDTH, dtype=np.uint8), [], None

    def told():
        bits = np.zeros(WIDTH // FOLD, dtype=np.uint8)
        bits[np.concatenate(full)] = 1
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    for batch in batches:
        for part, subs, low, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if part != now:
                if full:
                    yield told()
                now, full = part, []
                dense.fill(0)
            subs = np.frombuffer(subs, dtype=np.uint32)
            at = np.repeat(np.arange(len(subs), dtype=np.int64) << 16, subs) + np.frombuffer(low, dtype=np.uint16)
            sums = np.minimum(dense[at] + np.frombuffer(n, dtype=np.uint8), LEAST)
            dense[at] = sums
            if (reached := at[sums >= LEAST]).size:
                full.append(np.unique(reached // FOLD))
    if full:
        yield told()


def may_be_frequent(texts: DataFrame, lengths: tuple[int, ...], known=None) -> Bitmap:
    """A bitmap that holds every phrase of ``lengths`` words that occurs ``LEAST`` times in (_lang, _text)."""
    counts = texts.mapInArrow(_bucket_counts(lengths, known), "part int, subs binary, low binary, n binary")
    bits = counts.repartition("part").sortWithinPartitions("part").mapInArrow(_added, "part int, bits binary")
    packed = np.zeros((RANGES, WIDTH // FOLD // 8), dtype=np.uint8)
    for part, found in bits.collect():
        packed[part] = np.frombuffer(bytes(found), dtype=np.uint8)
    return Bitmap(packed.reshape(-1))


class _Lists:
    """Inverted lists of one block and one language: words by position, and the occurrence lists of phrases."""

    def __init__(self, lang: str):
        self.lang, self.seed, self.vocab, self.parts, self.size = lang, _seed(lang), {BORDER: 0}, [], 0

    def add(self, own: list[bytes]) -> None:
        vocab = self.vocab
        self.parts.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in own), dtype=np.int64, count=len(own)))
        self.size += len(own)

    def mined(self, words: WordHash, few: Bitmap, many: Bitmap):
        """(phrases, list lengths, hashes) of each number of words; first the number of all words under the empty phrase."""
        names = list(self.vocab)
        at = np.concatenate(self.parts)  # the word at each position
        hashes = np.fromiter(map(words.__getitem__, names), dtype=np.uint64, count=len(names))
        yield [b""], np.array([np.count_nonzero(at)]), np.array([self.seed])
        known = _mixed(np.broadcast_to(self.seed, hashes.shape), hashes)
        good = few.test(known)
        good[0] = False
        starts = np.flatnonzero(good[at])
        phrase, h, phrases = at[starts], known[at[starts]], names
        # the list of each phrase: positions in ascending order, list after list
        order = np.argsort(phrase, kind="stable")
        starts, phrase, h = starts[order], phrase[order], h[order]
        lengths = np.bincount(phrase, minlength=len(names))
        found = np.flatnonzero(lengths)
        yield [names[i] for i in found], lengths[found], known[found]
        at = np.append(at, np.zeros(LONGEST, dtype=np.int64))
        for k in range(1, LONGEST):
            follows = at[starts + k]  # occurrence positions meet the postings of the words that stand next
            h = _mixed(h, hashes[follows])
            keep = (follows > 0) & good[follows] & (few if k == 1 else many).test(h)
            starts, h = starts[keep], h[keep]
            code, phrase, lengths = np.unique(phrase[keep] * len(names) + follows[keep], return_inverse=True, return_counts=True)
            before, last = np.divmod(code, len(names))
            phrases = [phrases[b] + b" " + names[w] for b, w in zip(before.tolist(), last.tolist())]
            order = np.argsort(phrase, kind="stable")
            starts, phrase, h = starts[order], phrase[order], h[order]
            yield phrases, lengths, h[np.cumsum(lengths) - lengths]


def _mined(few, many, parts: int):
    """Rows (part, keys, f): list lengths, added up over a task's blocks, those of one range of hashes in a row.

    A key is language, tab, phrase.
    """

    def run(batches):
        vacate()
        words, lists, size = WordHash(), {}, 0
        place, f, hashes = {}, [], []  # of each key: where its number is, the numbers, the phrases' hashes

        def mine():
            for x in lists.values():
                lang = x.lang.encode("utf-8", "surrogatepass") + b"\t"
                for phrases, lengths, h in x.mined(words, few.value, many.value):
                    for p, n, g in zip(phrases, lengths.tolist(), h.tolist()):
                        at = place.setdefault(lang + p, len(f))
                        if at == len(f):
                            f.append(n)
                            hashes.append(g)
                        else:
                            f[at] += n

        def sent():
            part = np.array(hashes, dtype=np.uint64) % np.uint64(parts)
            order, keys = np.argsort(part, kind="stable"), list(place)
            full, n = np.unique(part, return_counts=True)
            ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            columns = [pa.array(full.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array([keys[i] for i in order.tolist()], pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(np.array(f, dtype=np.int64)[order]))]
            whole = pa.RecordBatch.from_arrays(columns, names=["part", "keys", "f"])
            for held in (place, f, hashes):
                held.clear()
            yield from (whole.slice(k, 64) for k in range(0, len(full), 64))

        for batch in batches:
            for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                own = stream(text)
                if lang not in lists:
                    lists[lang] = _Lists(lang)
                lists[lang].add(own)
                size += len(own)
                if size >= BLOCK_WORDS:
                    mine()
                    lists, size = {}, 0
                    if len(f) >= COMBINED:
                        yield from sent()
        mine()
        if f:
            yield from sent()

    return run


def _summed(batches):
    """(lang, phrase, f) of the phrases of each range of hashes that are frequent over all blocks, and the numbers of words."""
    found, now = defaultdict(int), None

    def told():
        kept = [(*k.rsplit("\t", 1), n) for k, n in found.items() if n >= LEAST or k.endswith("\t")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept) if kept else ([], [], []), (pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

    for batch in batches:
        for k, part in enumerate(batch.column(0).to_pylist()):
            if part != now:
                if found:
                    yield told()
                found, now = defaultdict(int), part
            for key, n in zip(batch.column(1)[k].values.to_pylist(), batch.column(2)[k].values.to_pylist()):
                found[key] += n
    if found:
        yield told()


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, f): exact frequencies of all phrases of one to ``LONGEST`` words with ``LEAST`` occurrences, a stored table.

    The empty phrase has the number of all words of the language. Null texts have no words, a null language is ``und``; a text of
    any length is one part of a block.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("_lang"), F.col(text_col).alias("_text")).where("_text is not null")
    context = docs.sparkSession.sparkContext
    few = context.broadcast(may_be_frequent(texts, (1, 2)))
    many = context.broadcast(may_be_frequent(texts, (3, 4), few))
    parts = max(RANGES, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = texts.mapInArrow(_mined(few, many, parts), "part int, keys array<string>, f array<long>")
    return stored(found.repartition("part").sortWithinPartitions("part").mapInArrow(_summed, "lang string, phrase string, f long"))


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def candidates(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more, by their lowest-scoring cut."""
    phrases = counts.where("phrase <> ''").withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words"))
    cuts = phrases.where("k > 1").select("lang", "phrase", "words", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", 1, F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    parts = counts.where("phrase <> ''")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumns({"wide": _exact(F.col("a")) * F.lit(2_000_000).cast("decimal(10,0)"), "both": _exact(F.col("l") + F.col("r"))}).withColumn("score", F.expr("wide div both"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut"))
    return cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("x")).select("lang", "phrase", "a", "x.*")


def uncovered(found: DataFrame) -> DataFrame:
    """The candidates without those that lie in a longer candidate of nearly their frequency."""
    longer = found.select("lang", F.split("phrase", " ").alias("words"), F.col("a").alias("by")).where(F.size("words") > 2)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    around = longer.select("lang", "by", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    gone = F.coalesce(F.lit(100).cast("decimal(3,0)") * _exact(F.col("by")) >= F.lit(COVERED).cast("decimal(3,0)") * _exact(F.col("a")), F.lit(False))
    return found.join(around, ["lang", "phrase"], "left").where(~gone).drop("by")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Ties of score go by frequency, then by the phrase's bytes. Repeated rows count each time; a language without a frequent
    phrase, and an empty table, give no row.
    """
    counts = phrase_counts(docs, lang_col, text_col)
    found = stored(candidates(counts))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = uncovered(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    out = stored(ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    release(counts, found)
    return out
