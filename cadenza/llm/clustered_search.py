"""Ranked lexical search over an index that recursive graph bisection has put in order.

* ``bisection_tree`` takes a bounded sample of documents and halves it again and again. Each half-and-half starts from a split by
  the first term, then swaps the pairs of documents whose move shortens the gaps of the posting lists most, until none gains. A
  node keeps what each term gains on either side, so that every other document goes down the tree by the mean of its terms' gains:
  the sample decides only where a document lies, never whether it is indexed or found.
* ``build`` deals all documents out by their place (leaf, gain, id) into ranges of equal size, whatever the size of a leaf, and
  cuts these into blocks of one leaf. Each block has the inverted list of each of its terms and, beside it, the least document
  length for each frequency, from which the term's highest contribution follows for any statistics of the whole corpus.
* ``search`` bounds each item's score in each leaf, visits leaves from the highest bound downwards, a growing number at a time,
  and stops where no leaf left can reach the item's present last place. Blocks are bounded the same way inside a task. Scores are
  integers, bounds are exact, so the ranking is that of a full scan; places are mapped back to ids, which order equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, map_arrow, release, stored, vacate

#: Levels of the tree; it has 2 to this power leaves.
DEPTH = 6
#: Documents that the tree is fitted on, in expectation, and terms of each that count (those of least hash).
SAMPLE, SAMPLE_TERMS = 4096, 512
#: Hashed terms that a node tells apart: the tree takes 4 bytes for each of them and node, 8 MB in all.
BUCKETS = 1 << 15
ROUNDS = 8
SEED = 12
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 20
#: Characters of items that one pass over the index answers.
BLOCK_CHARS = 1 << 20
#: Leaves that an item visits first; each further round takes four times as many.
FIRST = 4
TOP = 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_FORWARD = "cluster int, gain float, n int, terms string, tf array<int>"
_INDEX = "cluster int, block long, term string, pos array<smallint>, tf array<int>, best_tf array<int>, best_n array<int>, ids array<long>"
_NO_ID = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and anything outside ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _cost(d: np.ndarray, n: int) -> np.ndarray:
    """Bits that the gaps of lists of d documents among n take, about."""
    return d * np.log2(max(n, 1) / (d + 1.0))


def _halves(rows: np.ndarray, cols: np.ndarray, n: int, start: np.ndarray) -> np.ndarray:
    """What each term gains by standing on the right side rather than on the left, after the swaps."""
    side = np.zeros(n, dtype=bool)
    side[start[n // 2 :]] = True
    right_n, left_n = n - n // 2, n // 2
    total = np.bincount(cols, minlength=BUCKETS).astype(np.float64)
    for _ in range(ROUNDS):
        on_right = side[rows]
        right = np.bincount(cols[on_right], minlength=BUCKETS).astype(np.float64)
        left = total - right
        now = _cost(left, left_n) + _cost(right, right_n)
        to_right = now - _cost(np.maximum(left - 1, 0), left_n) - _cost(right + 1, right_n)
        to_left = now - _cost(left + 1, left_n) - _cost(np.maximum(right - 1, 0), right_n)
        gain = np.bincount(rows, weights=np.where(on_right, to_left[cols], to_right[cols]), minlength=n)
        lefts, rights = np.flatnonzero(~side), np.flatnonzero(side)
        lefts, rights = lefts[np.argsort(-gain[lefts], kind="stable")], rights[np.argsort(-gain[rights], kind="stable")]
        m = min(len(lefts), len(rights))
        swaps = int(np.count_nonzero(gain[lefts[:m]] + gain[rights[:m]] > 0))
        if not swaps:
            break
        side[lefts[:swaps]], side[rights[:swaps]] = True, False
    right = np.bincount(cols[side[rows]], minlength=BUCKETS).astype(np.float64)
    left = total - right
    grown = (_cost(left + 1, left_n) - _cost(left, left_n)) - (_cost(right + 1, right_n) - _cost(right, right_n))
    return np.where(total > 0, grown, 0.0)


def fit_tree(lists: list, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(gains of each inner node and hashed term, cut of each inner node) from the term lists of sampled documents.

    A node sends a document right where the mean of its terms' gains passes the cut, the median of the node's own documents; a
    mean, so that long documents do not gather at the ends of the order.
    """
    nodes = (1 << depth) - 1
    gains, cuts = np.zeros((nodes, BUCKETS), dtype=np.float32), np.zeros(nodes, dtype=np.float64)
    lists = [np.asarray(x, dtype=np.int64) for x in lists if len(x)]
    members = {0: np.arange(len(lists))}
    for node in range(nodes):
        own = members.pop(node, np.zeros(0, dtype=np.int64))
        if len(own) < 4:
            continue
        rows = np.repeat(np.arange(len(own)), [len(lists[i]) for i in own])
        cols = np.concatenate([lists[i] for i in own])
        gains[node] = _halves(rows, cols, len(own), np.argsort([lists[i].min() for i in own], kind="stable"))
        value = np.bincount(rows, weights=gains[node][cols].astype(np.float64), minlength=len(own)) / np.bincount(rows, minlength=len(own))
        cuts[node] = np.median(value)
        members[2 * node + 1], members[2 * node + 2] = own[value <= cuts[node]], own[value > cuts[node]]
    return gains, cuts


def _hashed(found, words: WordHash) -> np.ndarray:
    return np.fromiter((words[w] & (BUCKETS - 1) for w in found), dtype=np.int64, count=len(found))


def bisection_tree(docs: DataFrame, text_col: str, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The tree of a sample of ``SAMPLE`` documents in expectation."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def make():
        words = WordHash()
        return lambda texts: [[np.unique(_hashed(set(terms(t)), words))[:SAMPLE_TERMS].astype(np.int32) for t in texts]]

    return fit_tree(map_arrow(docs.sample(share, SEED), [text_col], make, "found array<int>").toArrow().column(0).to_pylist(), depth)


def placed(docs: DataFrame, id_col: str, text_col: str, tree: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(_id, cluster, gain, n, distinct terms set apart by spaces, their frequencies) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def make():
        vacate()
        words, (gains, cuts) = WordHash(), shared.value
        inner = len(cuts)

        def batch(texts):
            out = [[], [], [], [], []]
            for text in texts:
                found = terms(text)
                tf = Counter(found)
                at, node, gain = _hashed(tf, words), 0, 0.0
                while node < inner:
                    gain = float(gains[node][at].sum(dtype=np.float64)) / max(1, len(at))
                    node = 2 * node + 1 + (gain > cuts[node])
                for c, x in zip(out, (node - inner, gain, len(found), b" ".join(tf).decode("utf-8", "replace"), np.fromiter(tf.values(), dtype=np.int32, count=len(tf)))):
                    c.append(x)
            return out

        return batch

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(rows, ["_text"], make, _FORWARD, keep=("_id",))


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


class _Block:
    """Documents of one leaf in a row, until they are enough."""

    def __init__(self, cluster: int, number: int):
        self.cluster, self.number, self.postings = cluster, number, 0
        self.ids, self.n, self.vocab, self.terms, self.tf = [], [], {}, [], []

    def add(self, key: int, n: int, found: str, tf: np.ndarray) -> None:
        self.ids.append(key)
        self.n.append(n)
        vocab = self.vocab
        self.terms.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in found.split(" ")), dtype=np.int64, count=len(tf)) if len(tf) else np.zeros(0, dtype=np.int64))
        self.tf.append(tf)
        self.postings += len(tf)

    def rows(self, schema: pa.Schema):
        """A row without a term for the documents, then one for each term, in order of terms."""
        n = np.array(self.n, dtype=np.int32)
        head = [[self.cluster], [self.number], [""], None, [n], None, None, [np.array(self.ids, dtype=np.int64)]]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) if c is None else pa.array(c, f.type) for c, f in zip(head, schema)], schema=schema)
        if not self.vocab:
            return
        names = sorted(self.vocab, key=lambda w: w.encode("utf-8", "surrogatepass"))
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.fromiter((self.vocab[w] for w in names), dtype=np.int64, count=len(names))] = np.arange(len(names))
        term, tf = rank[np.concatenate(self.terms)], np.concatenate(self.tf).astype(np.int32)
        doc = np.repeat(np.arange(len(n)), [len(x) for x in self.tf])
        order = np.argsort(term, kind="stable")
        near = np.lexsort((n[doc], tf, term))
        first = np.ones(len(near), dtype=bool)
        first[1:] = (term[near][1:] != term[near][:-1]) | (tf[near][1:] != tf[near][:-1])
        near = near[first]
        counts, best = np.bincount(term, minlength=len(names)), np.bincount(term[near], minlength=len(names))
        columns = [
            pa.array(np.full(len(names), self.cluster), pa.int32()), pa.array(np.full(len(names), self.number), pa.int64()), pa.array(names, pa.string()),
            _lists(doc[order].astype(np.int16), counts, pa.int16()), _lists(tf[order], counts, pa.int32()),
            _lists(tf[near], best, pa.int32()), _lists(n[doc[near]], best, pa.int32()), pa.nulls(len(names), schema[-1].type),
        ]
        whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        yield from (whole.slice(k, 4096) for k in range(0, len(names), 4096))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """The index of all documents, a stored table; hand it to ``release`` when no search needs it any more.

    Null and wordless texts are indexed without a term. A null id is one behind all others. Repeated rows are documents of their
    own. Texts count whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    forward = stored(placed(docs, id_col, text_col, bisection_tree(docs, text_col, depth)))
    schema = docs.sparkSession.createDataFrame([], _INDEX).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        vacate()
        context = TaskContext.get()
        number, block = (context.partitionId() if context else 0) << 32, None
        for batch in batches:
            tfs, ends = batch.column(5).values.to_numpy(zero_copy_only=False), batch.column(5).offsets.to_numpy()
            for k, (key, cluster, n, found) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)))):
                if block and (block.cluster != cluster or len(block.ids) >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS):
                    yield from block.rows(arrow)
                    block = None
                if block is None:
                    number += 1
                    block = _Block(cluster, number)
                block.add(key, n, found, tfs[ends[k] : ends[k + 1]])
        if block:
            yield from block.rows(arrow)

    place = ["cluster", "gain", "_id"]
    index = stored(forward.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(run, schema))
    release(forward)
    return index


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    return 75 + (25 * np.asarray(n, dtype=np.int64) * docs) // max(1, total)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = np.asarray(tf, dtype=np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Plan:
    """The items of one pass: terms by number, each item's terms and their repeats, weights, and bounds by leaf."""

    def __init__(self, texts: list):
        self.number: dict[str, int] = {}
        self.items = []
        for text in texts:
            found = Counter(w.decode("utf-8", "replace") for w in terms(text))
            at = np.fromiter((self.number.setdefault(w, len(self.number)) for w in found), dtype=np.int64, count=len(found))
            self.items.append((at, np.fromiter(found.values(), dtype=np.int64, count=len(found))))

    def weigh(self, docs: int, total: int, seen: pa.Table, clusters: int) -> None:
        """Weights from document frequencies, and each item's highest possible score in each leaf, from rows (term, cluster, df, best)."""
        self.docs, self.total = docs, total
        t = np.fromiter((self.number[w] for w in seen.column("term").to_pylist()), dtype=np.int64, count=seen.num_rows)
        df = np.bincount(t, weights=seen.column("df").to_numpy(), minlength=len(self.number)).astype(np.int64)
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        best = np.zeros((len(self.number), clusters), dtype=np.int64)
        best[t, seen.column("cluster").to_numpy()] = seen.column("best").to_numpy()
        self.bound = np.array([((self.weight[at] * times)[:, None] * best[at]).sum(axis=0) for at, times in self.items], dtype=np.int64).reshape(len(self.items), clusters)


class _Tops:
    """The best documents of each item so far, in one task."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top, self.found = least.copy(), top, {}

    def offer(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        if item in self.found:
            score, ids = np.concatenate((self.found[item][0], score)), np.concatenate((self.found[item][1], ids))
        order = np.lexsort((ids, -score))[: self.top]
        self.found[item] = score[order], ids[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], score[order[-1]])


def _visit(plan: Plan, cluster: int, chosen: np.ndarray, head, lists: dict, tops: _Tops) -> None:
    """Score one block for the items that visit its leaf."""
    n, ids = head
    m = norms(n, plan.docs, plan.total)
    gains = {}
    for t, (pos, tf) in lists.items():
        gains[t] = pos, plan.weight[t] * impacts(tf, m[pos])
    highest = np.zeros(len(plan.number), dtype=np.int64)
    for t, (_, g) in gains.items():
        highest[t] = g.max()
    for item in np.flatnonzero(chosen[:, cluster]):
        at, times = plan.items[item]
        if int((highest[at] * times).sum()) < tops.least[item]:
            continue
        score = np.zeros(len(n), dtype=np.int64)
        for t, k in zip(at.tolist(), times.tolist()):
            if t in gains:
                pos, g = gains[t]
                score[pos] += k * g
        good = np.flatnonzero(score >= tops.least[item])
        if len(good):
            tops.offer(int(item), score[good], ids[good])


def _searched(index: DataFrame, plan: Plan, vocab: DataFrame, chosen: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """(item, score, _id): each task's best documents of the leaves that ``chosen`` names for each item."""
    shared = index.sparkSession.sparkContext.broadcast((plan, chosen, least))
    leaves = [int(c) for c in np.flatnonzero(chosen.any(axis=0))]

    def run(batches):
        vacate()
        plan, chosen, least = shared.value
        tops, now, cluster, head, lists = _Tops(least, top), None, 0, None, {}
        for batch in batches:
            pos, tf, ids = batch.column(3), batch.column(4), batch.column(5)
            for k, (leaf, block, term) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if block != now:
                    if head:
                        _visit(plan, cluster, chosen, head, lists, tops)
                    now, cluster, head, lists = block, leaf, None, {}
                if term == "":
                    head = tf[k].values.to_numpy(), ids[k].values.to_numpy()
                else:
                    lists[plan.number[term]] = pos[k].values.to_numpy().astype(np.int64), tf[k].values.to_numpy()
        if head:
            _visit(plan, cluster, chosen, head, lists, tops)
        for item, (score, ids) in tops.found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item), pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], names=["item", "score", "_id"])

    rows = index.where(F.col("cluster").isin(leaves)).join(F.broadcast(vocab), "term", "left_semi")
    rows = rows.select("cluster", "block", "term", "pos", "tf", "ids").repartition("block").sortWithinPartitions("block", "term")
    return rows.mapInArrow(run, "item int, score long, _id long")


def _best(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", top: int = TOP, depth: int = DEPTH, told: list | None = None) -> DataFrame:
    """(item id, rank, id, score): the ``top`` documents of each item with a score above 0, equal scores by ascending id.

    Items without a term, or with none that a document has, get no row. Repeated rows of items are answered each. Items are
    answered in passes of about ``BLOCK_CHARS`` characters; the driver holds one pass: its terms, their bounds in each leaf and the
    items' last places. ``told`` receives for each pass the visited and all pairs of items and leaves.
    """
    spark, clusters = index.sparkSession, 1 << depth
    kind = items.schema[item_col].dataType
    heads = index.where("term = ''").select(F.expr("aggregate(tf, 0L, (a, x) -> a + x)").alias("total"), F.expr("size(filter(tf, x -> x > 0))").cast("long").alias("docs"))
    docs, total = (int(x or 0) for x in heads.agg(F.sum("docs"), F.sum("total")).first())
    chars = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    passes = max(1, math.ceil(chars / BLOCK_CHARS))
    out = []
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64(item_col), F.lit(passes)) == k).select(F.col(item_col), F.col(text_col)).collect()
        plan = Plan([r[1] for r in own])
        if not plan.number or not total:
            continue
        vocab = spark.createDataFrame([("",), *((w,) for w in plan.number)], "term string")
        norm = f"75 + (25 * cast(x.best_n as long) * {docs}) div {total}"
        best = F.expr(f"array_max(transform(arrays_zip(best_tf, best_n), x -> (1000000000 * cast(x.best_tf as long)) div (1000 * cast(x.best_tf as long) + 12 * ({norm}))))")
        lists = index.where("term <> ''").join(F.broadcast(vocab), "term", "left_semi").select("term", "cluster", F.size("pos").alias("df"), best.alias("best"))
        plan.weigh(docs, total, lists.groupBy("term", "cluster").agg(F.sum("df").alias("df"), F.max("best").alias("best")).toArrow(), clusters)
        least, visited, step, tops = np.ones(len(own), dtype=np.int64), np.zeros_like(plan.bound, dtype=bool), FIRST, None
        while True:
            still = ~visited & (plan.bound >= least[:, None])
            order = np.argsort(np.where(still, -plan.bound, 1), axis=1, kind="stable")[:, :step]
            chosen = np.zeros_like(visited)
            np.put_along_axis(chosen, order, True, axis=1)
            chosen &= still
            if not chosen.any():
                break
            visited |= chosen
            found = _searched(index, plan, vocab, chosen, least, top)
            found = stored(_best(found if tops is None else found.unionByName(tops.drop("rank")), top))
            if tops is not None:
                release(tops)
            tops, step = found, 4 * step
            for r in tops.where(F.col("rank") == top).select("item", "score").collect():
                least[r[0]] = max(least[r[0]], r[1])
        if told is not None:
            told.append((int(visited.sum()), visited.size))
        if tops is not None:
            names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(own)], f"item int, _item {kind.simpleString()}")
            out.append(tops.join(F.broadcast(names), "item").select(F.col("_item").alias(item_col), F.col("rank"), F.when(F.col("_id") != _NO_ID, F.col("_id")).alias(id_col), F.col("score")))
    empty = spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, `{id_col}` long, score long")
    return reduce(DataFrame.union, out, empty) if not out else reduce(DataFrame.union, out)


def ranked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Index ``docs``, answer ``items`` and delete the index."""
    index = build(docs, options.get("id_col", "doc_id"))
    try:
        return search(index, items, **options)
    finally:
        release(index)
