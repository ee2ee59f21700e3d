"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up n-gram counts per language on the executors; the driver receives at most ``BUCKETS`` counts per
language and turns them into one matrix of log probabilities and one vector of log priors (shares of documents), which
are broadcast. Texts are scored in batches: each is a sparse row of n-gram counts, and a batch's rows, laid end to end, are
multiplied with the matrix at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, map_arrow, restored, vacate

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SLICE = 1 << 18
#: N-grams of evidence that a score may rest on; longer texts do not become surer than that.
EVIDENCE = 40
#: Default of what a task and the driver hold; there are fewer than 200 two-letter language codes.
MAX_LANGUAGES = 256
#: Counts of a batch of sparse rows.
CELLS = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def buckets_of(text: str | None, size: int = SLICE):
    """Yield arrays of hashed n-grams of the lower-cased letters, words set apart by one space; slice after slice.

    A slice begins with the end of the one before it and yields the n-grams that end in it, so slices of any ``size`` give
    the n-grams of the whole text.
    """
    if not text:
        return
    letters, low = _letters(), text.lower()
    odd = [np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)]
    space = np.array([32], dtype=np.uint32)
    tail, inside = None, False  # the end of what was yielded; whether the last character was a letter
    for at in range(0, len(low) + 1, size):
        chars = np.frombuffer(low[at : at + size].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[chars]
        keep = is_letter.copy()
        if len(chars):
            keep[0] |= inside
            keep[1:] |= is_letter[:-1]
            inside = bool(is_letter[-1])
        chars = np.where(is_letter, chars, np.uint32(32))[keep]
        if tail is None and not len(chars):
            continue
        parts = [chars] if at + size <= len(low) else [chars, space]
        fresh = np.concatenate(parts if tail is not None else [space, *parts])
        tail = fresh[:0] if tail is None else tail
        chars, old = np.concatenate((tail, fresh)), len(tail)
        out = []
        for n in ORDERS:
            first = max(0, old - n + 1)
            count = len(chars) - n + 1 - first
            if count < 1:
                break
            h = np.full(count, n * 40503, dtype=np.uint32)
            for k in range(n):
                h = (h ^ chars[first + k : first + k + count]) * odd[k % 3]
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(BUCKETS - 1))
        tail = chars[len(chars) - min(len(chars), ORDERS[-1] - 1) :]
        if out:
            yield np.concatenate(out)


def _count_partition(batches):
    import pyarrow as pa

    vacate()
    counts: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
                documents[lang] = 0
            documents[lang] += 1
            for h in buckets_of(text):
                counts[lang] += np.bincount(h, minlength=BUCKETS)
    for lang, c in counts.items():
        c = np.append(c, documents[lang])  # behind the buckets
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", most: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities of BUCKETS rows with one column per language, log priors), from all labelled rows.

    Null labels and null texts are left out; texts of any length count whole, repeated rows count each time. The
    driver holds ``BUCKETS`` numbers a label: with more than ``most`` labels (null: MAX_LANGUAGES), a ValueError is raised before
    anything is gathered, and a caller with the memory for more of them sets ``most`` higher.
    """
    most = MAX_LANGUAGES if most is None else most
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col), F.col(label_col))
    if (many := rows.select(label_col).distinct().limit(most + 1).count()) > most:
        raise ValueError(f"at least {many} languages, where the caller allows for {most}")
    sums = rows.mapInArrow(_count_partition, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("bucket").agg(F.collect_list(F.struct("lang", "n")).alias("by")).toPandas()
    langs = sorted({x["lang"] for by in found["by"] for x in by})
    column = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((BUCKETS + 1, max(1, len(langs))))
    for bucket, by in zip(found["bucket"], found["by"]):
        for x in by:
            counts[bucket, column[x["lang"]]] += x["n"]
    grams, documents = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS]
    return langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), np.log(np.maximum(documents, 1) / max(1.0, documents.sum()))


def sparse_row(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's n-grams."""
    whole = np.zeros(BUCKETS, dtype=np.int64)
    for h in buckets_of(text):
        whole += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(whole)
    return at, whole[at]


def scores(texts: list, langs: list[str], matrix: np.ndarray, prior: np.ndarray | None = None):
    """(language, score) of each text; UNKNOWN with 0.0 for a null text, one without letters, or where nothing was learned.

    Evidence is cut to EVIDENCE n-grams of the text's average, so that scores of long texts stay comparable; the language is
    the one of the whole text's log probability and prior, ties go to the first.
    """
    prior = np.zeros(matrix.shape[1]) if prior is None else prior
    held, rows = 0, []
    for k, text in enumerate(texts):
        rows.append(sparse_row(text))
        held += len(rows[-1][0])
        if held < CELLS and k + 1 < len(texts):
            continue
        full = [i for i, (at, _) in enumerate(rows) if len(at)]
        total, n = np.zeros((len(rows), matrix.shape[1])), np.zeros(len(rows))
        if full and langs:
            at, count = (np.concatenate([rows[i][x] for i in full]) for x in (0, 1))
            begin = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in full])[:-1]))
            total[full] = np.add.reduceat(matrix[at] * count[:, None].astype(np.float64), begin, axis=0)
            n[full] = np.add.reduceat(count, begin)
        for i in range(len(rows)):
            if not n[i]:
                yield UNKNOWN, 0.0
                continue
            whole = total[i] + prior
            best = int(whole.argmax())
            logit = whole * (min(n[i], EVIDENCE) / n[i])
            p = np.exp(logit - logit.max())
            yield langs[best], float(p[best] / p.sum())
        held, rows = 0, []


def score(text: str | None, langs: list[str], matrix: np.ndarray, prior: np.ndarray | None = None) -> tuple[str, float]:
    return next(scores([text], langs, matrix, prior))


def predict(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with lang_pred and score. Repeated rows stay; ties go to the first language.

    ``keep`` must not hold columns of these two names; see ``told`` for tables that may.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        vacate()

        def batch(texts):
            found = list(scores(texts, *shared.value))
            return [x[0] for x in found], [x[1] for x in found]

        return batch

    return map_arrow(df, [text_col], make, "lang_pred string, score double", keep=tuple(keep))


def told(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more, with all their columns of any name.

    Trained on the given rows' labels outside the held-out fold. Rows with a null text or without letters go.
    """
    model = train(docs.where((fold(id_col) != 2) & F.col(id_col).isNotNull()), text_col, label_col, most)
    rows = carried(docs, text=F.col(text_col))
    scored = predict(rows, model, ["_row"])
    return restored(scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs)


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most: int | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score) of every document; rows whose fold is 2 are held out of training.

    A null id belongs to no fold: it is scored, not held out and not trained on.
    """
    held = F.coalesce(fold(id_col) == 2, F.lit(False))
    model = train(docs.where(~held & F.col(id_col).isNotNull()), text_col, label_col, most)
    return predict(docs.select(F.col(id_col), F.col(text_col), held.alias("held_out")), model, [id_col, "held_out"], text_col)
