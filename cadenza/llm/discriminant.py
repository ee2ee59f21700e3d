"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class of the labels has a mean and a shrinkage covariance of the statistics. They come from sums of products that the
executors add up over all labelled rows, so fitting needs no sample and the driver sees two rows of sums whatever the size of
the corpus. Executors receive the Cholesky factor of each covariance once (a few hundred numbers) and score batches of rows:
the score rests on the difference of the two Mahalanobis log densities and the log priors.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, vacate

FEATURES = ("f_words", "f_length", "f_growth", "f_punct", "f_symbols", "f_upper", "f_calls", "f_digits", "f_echo", "f_lines", "f_same_lines", "f_short")
P = len(FEATURES)
#: Share of the pooled covariance in each class's covariance, and of its diagonal in the mixture.
POOLED, DIAGONAL = 0.1, 0.05
#: Least variance of a statistic.
FLOOR = 1e-3
#: Words of ordinary prose (marks a word, capitals a character, words of under three bytes) added to each text's own in shares,
#: so that a text of a few words is not judged by one capital or full stop.
PRIOR, PROSE_MARKS, PROSE_CAPITALS, PROSE_SHORT = 30, 0.12, 0.025, 0.2
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MOMENTS = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(text: str | None) -> tuple[float, ...]:
    """The transformed statistics of a whole text: logarithms of lengths, square roots of shares. Zeros where it has no word."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * P
    chars = len(text) - sum(map(text.count, _SPACE))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    distinct = len(set(words))
    wide, deep = n + PRIOR, chars + 6 * PRIOR
    return (
        math.log1p(n),
        math.log(deep / wide),
        4 * math.log(distinct + PRIOR) / math.log(wide),  # a power of the length, so that it does not fall with it
        math.sqrt((sum(map(text.count, ".,;:")) + PRIOR * PROSE_MARKS) / wide),
        math.sqrt(sum(map(text.count, "#*$%&|<>{}[]=_~^\\/@")) / wide),
        math.sqrt((len(raw) - len(raw.translate(None, _UPPER)) + 6 * PRIOR * PROSE_CAPITALS) / deep),
        math.sqrt(sum(map(text.count, "!?")) / wide),
        math.sqrt((len(raw) - len(raw.translate(None, _DIGITS))) / deep),
        math.sqrt(sum(map(eq, words, words[1:])) / wide),
        math.log(wide / len(lines)),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt((sum(len(w) < 3 for w in words) + PRIOR * PROSE_SHORT) / wide),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, statistics) of every row."""

    def make():
        vacate()
        return lambda texts: [list(x) for x in zip(*map(statistics, texts))] if texts else [[] for _ in FEATURES]

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(rows, ["_text"], make, ", ".join(f"{f} double" for f in FEATURES), keep=("_id",))


def class_sums(rows: DataFrame, label: str = "label") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (rows, sums, sums of products) of the statistics, for the labels 0 and 1."""
    sums = [F.sum(x) for x in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in _MOMENTS]
    out = {}
    for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)), *sums).collect():
        second = np.zeros((P, P))
        for (i, j), x in zip(_MOMENTS, r[2 + P :]):
            second[i, j] = second[j, i] = x
        out[int(r[0])] = float(r[1]), np.array(r[2 : 2 + P], dtype=np.float64), second
    return out


def factors(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, float]] | None:
    """For the labels 0 and 1: mean, inverse Cholesky factor, and log prior less half the log determinant. None unless both occur."""
    if set(sums) != {0, 1}:
        return None
    total = sum(n for n, _, _ in sums.values())
    spread = {k: q / n - np.outer(s / n, s / n) for k, (n, s, q) in sums.items()}
    pooled = sum(sums[k][0] / total * spread[k] for k in sums)
    out = []
    for k in (0, 1):
        n, s, _ = sums[k]
        cov = (1 - POOLED) * spread[k] + POOLED * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov))
        lower = np.linalg.cholesky(cov + np.diag(np.maximum(FLOOR - np.diag(cov), 0) + 1e-9))
        out.append((s / n, np.linalg.inv(lower), math.log(n / total) - float(np.log(np.diag(lower)).sum())))
    return out


def scores(x: np.ndarray, model) -> np.ndarray:
    """Scores in (0, 1) of rows of statistics: above a half where class 1 is likelier. A half without a model.

    The log-odds d becomes (1 + |d|) / (2 + |d|) for class 1, and one less that for class 0, which orders rows as the odds do but
    does not run into 0 and 1, where rows would be tied.
    """
    if model is None:
        return np.full(len(x), 0.5)
    density = [c - 0.5 * (((x - m) @ inverse.T) ** 2).sum(axis=1) for m, inverse, c in model]
    d = density[1] - density[0]
    sure = (1 + np.abs(d)) / (2 + np.abs(d))
    return np.where(d >= 0, sure, 1 - sure)


def held_out(id_col: str):
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1. A null id belongs to no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every document, by the labels 0 and 1 of the documents outside the held-out fold.

    Only the text is an input of a score; texts count whole. A null or wordless text has zero statistics and gets a score as any
    other. A null id is scored, and never learned from. Null and other labels are left out; an id with several labels, and
    repeated rows of one id, count once for each pair. Where one of the classes has no row, every score is 0.5 and every document
    predicted 1.
    """
    rows = stored(measured(docs, id_col, text_col))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id is not null and label is not null")
    model = factors(class_sums(rows.where(~held_out("_id")).join(known, "_id")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def batch(*columns):
            s = scores(np.array(columns, dtype=np.float64).T.reshape(-1, P), shared.value)
            return [s, (s >= 0.5).astype(np.int32)]

        return batch

    told = map_arrow(rows, list(FEATURES), make, "score double, predicted int", rows=8192, keep=("_id",))
    return told.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", "predicted")
