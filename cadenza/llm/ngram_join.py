"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, one verification per pair.

Documents with equal sets form one class, stood for by its smallest id, so copies cost nothing. The others are joined on
the shingles of their prefixes; what the filters leave is compared by sketches (a lossless bound of the distance, an
eighth of a byte a shingle) and verified by the whole texts. A shingle's rarity comes from counts in hashed buckets over all documents; any order that
all documents share is exact, a rarity order makes it quick.

The join runs in two rounds, because a large group of near copies would otherwise meet in all its pairs. First every
document meets the leader (smallest id) of each of its prefix shingles. Then only documents that the first round left
outside their leader's component meet the rest of that shingle's documents. No link between components is lost: two
documents that share a prefix shingle are either both in its leader's component already, or one of them is outside.
"""

from __future__ import annotations

import struct
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, carried, map_arrow, release, restored, stored, vacate
from .components import components

BUCKETS = 1 << 18
#: Value ranges whose counts bound the overlap of two sets (the suffix filter); eight bytes of a long.
RANGES = 8
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def shingles(text: str | None, n: int, words: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text: A-Z lower-cased, words set apart by ASCII white space.

    Fewer words than n form one shingle; a text without words has none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * _MIX[k % 3]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of at least as many places as the set has shingles: whether an odd number of them falls there."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Places where two sketches differ, the longer one folded; two sets differ in as many shingles, at least."""
    x, y, n, m = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)
    while n > m:
        n >>= 1
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m >>= 1
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


#: Shingles whose buckets are counted at once.
CHUNK = 1 << 20


def _survey(n: int):
    """Per document its set's size, key and sketch; at a partition's end its counts of shingles by bucket (id null, k1 bucket)."""

    def run(batches):
        vacate()
        words, counts, names = WordHash(), np.zeros(BUCKETS, dtype=np.int64), ["id", "n", "k1", "k2", "sketch"]
        for batch in batches:
            size, k1, k2, bits, sets, held = [], [], [], [], [], 0
            for text in batch.column(1).to_pylist():
                s = shingles(text, n, words)
                size.append(len(s))
                a, b = struct.unpack("<qq", blake2b(s.tobytes(), digest_size=16).digest()) if len(s) else (None, None)
                k1.append(a)
                k2.append(b)
                bits.append(sketch(s) if len(s) else None)
                sets.append((s & np.uint64(BUCKETS - 1)).astype(np.int32))
                held += len(s)
                if held >= CHUNK:
                    counts += np.bincount(np.concatenate(sets), minlength=BUCKETS)
                    sets, held = [], 0
            if held:
                counts += np.bincount(np.concatenate(sets), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.binary())], names=names)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(counts[at]), pa.array(at), pa.array(np.full(len(at), -1)), pa.nulls(len(at), pa.binary())], names=names)

    return run


def ceil_share(num: int, den: int, n):
    return -(-num * n // den)


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): rows (id, n_shingles, rep) of every row with its class's smallest id, labels (v, c) of linked classes.

    ``id_col`` must be integral. Two documents link when 100 * intersection >= percent * union of their shingle sets.
    Null and wordless texts have no shingles and link with nothing (rep is their own id). A null id links with nothing
    and keeps a null rep. Rows that share an id are one node: what links one of them links all.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    survey = stored(texts.mapInArrow(_survey(n), "id long, n long, k1 long, k2 long, sketch binary"))
    # a bucket's row has k2 = -1, a key below BUCKETS and no id; a document's row without an id has either a hash or nulls there
    is_bucket = F.col("id").isNull() & (F.col("k2") == -1) & F.col("k1").between(0, BUCKETS - 1)
    sums = survey.where(is_bucket).groupBy("k1").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(BUCKETS, dtype=np.int64)
    often[sums["k1"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    often = spark.sparkContext.broadcast(np.minimum(often, 2**31 - 1).astype(np.int32))

    members = survey.where(~F.coalesce(is_bucket, F.lit(False)))
    classes = members.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    rows = members.join(classes, ["k1", "k2"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    reps = classes.select(F.col("rep").alias("id"))
    sketches = members.where("n > 0 and id is not null").select("id", "n", "sketch")

    def prefixes():
        vacate()
        words, counts = WordHash(), often.value

        def batch(ids, found):
            out = [[], [], [], [], []]
            for key, text in zip(ids, found):
                s = shingles(text, n, words)
                size = len(s)
                if not size or key is None:
                    continue
                length = size - ceil_share(percent, 100, size) + 1
                often_here = counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                if length < size:
                    near = np.argpartition(often_here, length - 1)
                    cut = often_here[near[length - 1]]
                    near = np.flatnonzero(often_here <= cut)
                else:
                    near = np.arange(size)
                order = near[np.lexsort((s[near], often_here[near]))][:length]
                hist = np.minimum(np.bincount((s >> np.uint64(61)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8)
                for column, value in zip(out, (key, size, s[order].view(np.int64), int(hist.view(np.int64)[0]), None)):
                    column.append(value)
            return out[:4]

        return batch

    own = map_arrow(texts, ["id", "text"], prefixes, "id long, n long, prefix array<long>, ranges long")
    own = own.select("id", "n", "ranges", F.posexplode("prefix").alias("i", "s"))
    entries = stored(own.join(reps, "id", "left_semi"))
    leaders = entries.groupBy("s").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    led = stored(entries.join(leaders, "s"))
    first = entries.select("s", F.col("id").alias("leader"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("ranges").alias("ranges2"))
    first = led.where("id <> leader").join(first, ["s", "leader"]).where(_possible(percent)).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    tried = _likely(stored(first), sketches, percent)
    links = verify(texts, tried, n, percent)
    labels = components(links)
    release(links, entries)

    with_label = led.join(labels.withColumnRenamed("v", "id").withColumnRenamed("c", "label"), "id", "left")
    with_label = with_label.join(labels.withColumnRenamed("v", "leader").withColumnRenamed("c", "lead_label"), "leader", "left")
    with_label = stored(with_label.withColumn("label", F.coalesce("label", "id")).withColumn("lead_label", F.coalesce("lead_label", "leader")))
    left = with_label.where("label <> lead_label")
    right = with_label.select("s", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("ranges").alias("ranges2"), F.col("label").alias("label2"), (F.col("label") == F.col("lead_label")).alias("led2"), "leader")
    # the leader itself was met in the first round; of two that are both outside, the smaller id asks
    apart = (F.col("label") != F.col("label2")) & (F.col("id2") != F.col("leader")) & (F.col("led2") | (F.col("id") < F.col("id2")))
    right = right.join(left.select("s").distinct(), "s", "left_semi")
    second = left.drop("leader").join(right, "s").where(apart & _possible(percent)).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    # what the first round verified is not verified again
    second = _likely(stored(second.join(tried, ["a", "b"], "left_anti")), sketches, percent)
    release(led, with_label, tried)
    if not second.isEmpty():
        more = verify(texts, second, n, percent)
        old = labels
        labels = components(old.select(F.col("v").alias("a"), F.col("c").alias("b")).union(more))
        release(old, more)
    release(second)
    return rows, labels


def _possible(percent: int):
    """Length, positional and suffix filter of two entries (n, i, ranges) and (n2, i2, ranges2) of one shingle.

    Sets that link share a shingle before either's last ``least - 1``; entries behind these prefixes need not meet.
    """
    n, m, i, j = F.col("n"), F.col("n2"), F.col("i"), F.col("i2")
    least = F.floor((percent * (n + m) + (99 + percent)) / (100 + percent))
    apart = F.lit(0)
    for k in range(RANGES):
        byte = [F.shiftrightunsigned(F.col(c), 8 * k).bitwiseAND(F.lit(255)) for c in ("ranges", "ranges2")]
        apart = apart + F.abs(byte[0] - byte[1])
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (i <= n - least) & (j <= m - least) & (apart <= n + m - 2 * least)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not differ in more places than their sets may."""

    def check(batches):
        for batch in batches:
            n, m, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = [sketch_distance(p, q) <= i + j - 2 * ceil_share(percent, 100 + percent, i + j) for i, j, p, q in zip(n, m, x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    out = stored(both.mapInArrow(check, "a long, b long"))
    release(pairs)
    return out


def verify(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole shingle sets link."""

    def check(batches):
        words, known = WordHash(), {}
        for batch in batches:
            keep = []
            for a, p, q in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x = known.get(a)
                if x is None or x[0] != p:  # rows of one leader stand together
                    known = {a: (p, shingles(p, n, words))}
                    x = known[a]
                x, y = x[1], shingles(q, n, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) of every row; see ``near_links`` for nulls, empties and repeats."""
    rows, labels = near_links(docs, id_col, text_col, n, percent)
    found = rows.join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    return found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("c", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its group, with all columns of any name.

    Rows with a null id stay. Rows that share an id are one document: they stay or go together. Null and wordless texts
    stay, as they are linked with nothing.
    """
    groups = near_groups(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, n, percent)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct()
    rows = carried(docs, id=F.col(id_col))
    return restored(rows.join(gone, F.col("id") == F.col("gone"), "left_anti"), docs)
