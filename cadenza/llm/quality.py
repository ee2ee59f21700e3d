"""Quality rules: base counts of a text, and robust multivariate outliers per language and source.

Location and scatter of each (language, source) are minimum-covariance-determinant estimates. Each of ``STARTS`` starts
(median and median deviation, and random elemental subsets of one distinct row more than there are features) takes two
concentration steps, which keep the ``KEEP`` share of the group's rows nearest to the present estimate and take their mean and
covariance. The ``FINAL`` starts of least determinant go on until their determinants stop falling; the least is kept. A step is one pass that
adds up moments by group, start and distance bin, so it needs neither a sample nor a group's rows in one place; of the
bin that holds the last row kept, a share counts.

One law holds for groups of all sizes: the estimate is drawn towards the one of the language, and that towards the one of
all rows, as if ``WEIGHT`` rows of those had been seen. A group of a few rows is judged almost by its language, a large one by
itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, release, stored

MIN_WORDS = 20
WINDOW = 8
KEEP = 0.75
STARTS = 7
FINAL = 2
#: A log determinant that falls by less has stopped falling: rows of one distance bin change places at this size.
STILL = 1e-3
#: Rows of a group, in expectation, that the rows of an elemental subset are taken from.
DRAWN = 64
#: Rows of the next wider group that a group's own rows are weighed against.
WEIGHT = 30
#: Share of clean rows that the cut-off leaves in, were they normal.
CUT = 0.99999
FEATURES = ("f_words", "f_length", "f_distinct", "f_punct", "f_symbols")
#: Least standard deviation of each feature: a group in which a feature is constant does not reject every other value.
FLOOR = (0.25, 0.08, 0.10, 0.10, 0.15)
GRID = 32
BINS = 256
SYMBOLS = re.compile(r"[#*$%&|<>]")
PUNCT = re.compile(r"[.,;:!?]")
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # splits at x20 and x09-x0D
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    width = 1
    while width < WINDOW:  # ranks of windows of doubled width: exact, without hashes
        pairs = ranks[:-width] * n + ranks[width:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    often = np.bincount(ranks)[ranks] >= 2
    if not often.any():
        return 0
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    cover[at] += 1
    np.subtract.at(cover, at + WINDOW, 1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def features(text: str | None, n_words: int, chars: int, symbols: int) -> tuple[float, ...]:
    """The transformed statistics; zeros where there are no words."""
    if not n_words:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    distinct = len(set(text.encode("utf-8", "surrogatepass").split()))
    punct = sum(map(text.count, ".,;:!?"))
    # growth of the vocabulary with the length (a power of it), so that long texts are no outliers for being long
    growth = math.log(distinct) / math.log(n_words) if n_words > 1 else 1.0
    return math.log1p(n_words), math.log(max(1, chars) / n_words), 4 * growth, math.sqrt(punct / n_words), math.sqrt(symbols / n_words)


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, _group, counts, base_failed, features) of every row.

    A null text has zeros everywhere and fails the base rules; a null in a group column is a value of its own. Repeated rows stay.
    """
    group = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in group_cols])) if group_cols else F.lit("[]")

    def make():
        def batch(ids, texts, groups):
            c = [counts(t) for t in texts]
            f = [features(t, x[0], x[1], x[2]) for t, x in zip(texts, c)]
            failed = [x[0] < MIN_WORDS or 100 * x[4] > 30 * x[0] for x in c]
            return ids, groups, *[list(x) for x in zip(*c)], failed, *[list(x) for x in zip(*f)]

        return lambda *cols: batch(*cols) if cols[0] else [[] for _ in range(8 + len(FEATURES))]

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, _group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)
    return map_arrow(df.select(F.col(id_col), F.col(text_col), group.alias("_group")), [id_col, text_col, "_group"], make, schema)


def chi2_cdf(x: float, dof: int) -> float:
    """For odd degrees of freedom."""
    if x <= 0:
        return 0.0
    value, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, dof, 2):
        value -= term
        term *= x / (k + 2)
    return value


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def _inverse_root(cov: np.ndarray) -> np.ndarray:
    """Lower triangle L with L cov L' = 1."""
    return np.linalg.inv(np.linalg.cholesky(cov))


P = len(FEATURES)
_TRIANGLE = [(i, j) for i in range(P) for j in range(i + 1)]
_NAMES = ["_key", "start", "h", "det", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in _TRIANGLE], *[f"l{i}{j}" for i, j in _TRIANGLE]]
_SUMS = [*[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _TRIANGLE]]
#: An estimate: rows it rests on, log determinant, mean, covariance, and the root of the inverse covariance.
_FIT = "_key string, start int, " + ", ".join(f"{x} double" for x in _NAMES[2:])


def _row(key: str, start: int, h: float, mean: np.ndarray, cov: np.ndarray) -> list:
    cov = cov + np.diag(np.maximum(np.array(FLOOR) ** 2 - np.diag(cov), 0) + 1e-9)
    root = _inverse_root(cov)
    return [key, start, h, float(np.linalg.slogdet(cov)[1]), *mean, *[cov[i, j] for i, j in _TRIANGLE], *[root[i, j] for i, j in _TRIANGLE]]


def _square(values) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), x in zip(_TRIANGLE, values):
        out[i, j] = out[j, i] = x
    return out


def _median_start(pdf: pd.DataFrame) -> pd.DataFrame:
    """Median and median deviation of each feature, from the counts of its grid cells."""
    mean, scale = np.zeros(P), np.zeros(P)
    for f, part in pdf.groupby("f"):
        cell, n = part["cell"].to_numpy() / GRID, part["n"].to_numpy()

        def median(values: np.ndarray, n=n) -> float:
            order = np.argsort(values, kind="stable")
            return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

        mean[f] = median(cell)
        scale[f] = 1.4826 * median(np.abs(cell - mean[f]))
    return pd.DataFrame([_row(pdf["_key"].iloc[0], 0, 0.0, mean, np.diag(scale**2))], columns=_NAMES)


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and covariance out of the weighted sums over h of n rows, one row per group and start."""
    for pdf in frames:
        out = []
        for r in pdf.to_dict("records"):
            h, total = r["h"], r["n"]
            mean = np.array([r[f"s{i}"] for i in range(P)]) / h
            cov = _square([r[f"q{i}{j}"] / h for i, j in _TRIANGLE]) - np.outer(mean, mean)
            # what the nearest share of a normal sample lacks in spread
            cov *= (h / total) / chi2_cdf(chi2_quantile(h / total, P), P + 2) if h < total else 1.0
            out.append(_row(r["_key"], int(r["start"]), h, mean, cov))
        yield pd.DataFrame(out, columns=_NAMES)


def _concentrated(binned: DataFrame) -> DataFrame:
    """The estimates of the nearest KEEP of the rows, the last bin by the share that is needed of it."""
    group = Window.partitionBy("_key", "start")
    h = F.greatest(F.lit(1.0), KEEP * F.sum("n").over(group))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - F.sum("n").over(group.orderBy("bin")) + F.col("n")) / F.col("n")))
    shares = binned.withColumns({"h": h, "weight": weight}).groupBy("_key", "start")
    return shares.agg(F.sum("n").alias("n"), F.first("h").alias("h"), *[F.sum(F.col("weight") * F.col(x)).alias(x) for x in _SUMS]).mapInPandas(_estimates, _FIT)


def _distance(rows: DataFrame, fit: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``rows`` with _d2, the squared Mahalanobis distance from their estimate (null without one), and what ``on`` adds."""
    total = None
    for i in range(P):
        z = sum((F.col(f"l{i}{j}") * (F.col(FEATURES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = z * z if total is None else total + z * z
    return rows.join(fit, "_key", how).select(*dict.fromkeys([*rows.columns, *on]), total.alias("_d2"))


def determinant_fits(fitted: DataFrame) -> DataFrame:
    """The estimate of least determinant of each _key among ``fitted`` (_key, features, without nulls).

    Equal determinants go to the first start. A group of a single distinct row has the least variances. The driver learns only
    whether any start still moves.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.round(F.col(c) * GRID).cast("int").alias("cell")) for i, c in enumerate(FEATURES)])).alias("x")
    grid = fitted.select("_key", cells).groupBy("_key", "x.f", "x.cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = fitted.groupBy("_key").agg(F.count(F.lit(1)).alias("of"))
    # about DRAWN rows of each group and start, whatever its size; equal rows count once, however many there are
    drawn = fitted.join(sizes, "_key").withColumn("start", F.explode(F.array(*map(F.lit, range(1, STARTS)))))
    drawn = drawn.withColumn("by", F.xxhash64("start", *FEATURES)).where(F.pmod("by", F.lit(1 << 30)) * F.col("of") < DRAWN << 30)
    drawn = drawn.drop("of").dropDuplicates(["_key", "start", "by"])
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("_key", "start").orderBy("by"))).where(f"k <= {P + 1}")
    sums = [F.sum(FEATURES[i]).alias(f"s{i}") for i in range(P)] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in _TRIANGLE]
    subsets = drawn.groupBy("_key", "start").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("h"), *sums).mapInPandas(_estimates, _FIT)
    moving = stored(grid.groupBy("_key").applyInPandas(_median_start, _FIT).union(subsets.withColumn("h", F.lit(0.0))))  # no step taken
    tables, settled, steps = [moving], [], 0
    while True:
        # 16 bins for each doubling, the bins of all rows behind 2^16 together
        near = _distance(fitted, moving, ["start"], "inner").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(16 * F.log2(1 + F.col("_d2")))).cast("int"))
        after, steps = _concentrated(near.groupBy("_key", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)), steps + 1
        if steps <= 2:
            if steps == 2:
                place = F.row_number().over(Window.partitionBy("_key").orderBy("det", "start"))
                after = after.withColumn("_place", place).where(F.col("_place") <= FINAL).select(*_NAMES)
            moving = stored(after)
            tables.append(moving)
            continue
        was = moving.select("_key", "start", F.col("det").alias("before"))
        after = stored(after.join(was, ["_key", "start"]).select(*_NAMES, (F.col("det") < F.col("before") - STILL).alias("falls")))
        tables.append(after)
        settled.append(after.where("not falls").select(*_NAMES))
        moving = after.where("falls").select(*_NAMES)
        if moving.isEmpty():
            break
    ends = settled[0]
    for x in settled[1:]:
        ends = ends.union(x)
    best = stored(ends.groupBy("_key").agg(F.min_by(F.struct(*_NAMES[1:]), F.struct("det", "start")).alias("x")).select("_key", "x.*"))
    release(*tables)
    return best


def _shrunk(fits: DataFrame) -> DataFrame:
    """The estimates drawn towards those of their language, and these towards the one of all rows."""
    moments = [(F.col("h") * F.col(f"m{i}")).alias(f"a{i}") for i in range(P)] + [(F.col("h") * (F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"b{i}{j}") for i, j in _TRIANGLE]
    names = ["h", *[f"a{i}" for i in range(P)], *[f"b{i}{j}" for i, j in _TRIANGLE]]
    wide = F.to_json(F.slice(F.from_json("_key", "array<string>"), 1, 1))
    fits = fits.withColumn("_wide", wide)
    sums = fits.select("_wide", "h", *moments).groupBy("_wide").agg(*[F.sum(x).alias(f"w_{x}") for x in names])
    every = sums.agg(*[F.sum(f"w_{x}") for x in names]).first()

    def estimate(v):
        h, mean = max(v[0], 1e-9), np.array(v[1 : P + 1], dtype=np.float64) / max(v[0], 1e-9)
        return h, mean, _square(np.array(v[P + 1 :], dtype=np.float64) / h) - np.outer(mean, mean)

    def drawn(own, wider):
        (h, m, c), (_, n, d) = own, wider
        return h, (h * m + WEIGHT * n) / (h + WEIGHT), (h * c + WEIGHT * d) / (h + WEIGHT)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                own = r["h"], np.array([r[f"m{i}"] for i in range(P)]), _square([r[f"c{i}{j}"] for i, j in _TRIANGLE])
                language = drawn(estimate([r[f"w_{x}"] for x in names]), estimate(list(every)))
                h, mean, cov = drawn(own, language)
                out.append(_row(r["_key"], int(r["start"]), h, mean, cov))
            yield pd.DataFrame(out, columns=_NAMES)

    if every is None or every[0] is None:
        return fits.select(*_NAMES)
    return fits.join(sums, "_wide").mapInPandas(run, _FIT)


def outliers(rows: DataFrame) -> DataFrame:
    """``rows`` (with _key, a JSON list of language and source, features and base_failed) with _d2 from their estimate.

    Only rows that pass the base rules are fitted; all get a distance, null where a group has no fitted row.
    """
    fits = determinant_fits(rows.where(~F.col("base_failed")).select("_key", *FEATURES))
    shrunk = stored(_shrunk(fits))
    release(fits)
    return _distance(rows, shrunk, [])


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), cut: float = CUT) -> DataFrame:
    """(id, counts, base_failed, distance2, kept) of every row.

    Nulls: a null text has no words and fails the base rules; a null language or source is a value of its own. Repeated
    rows stay and count. Texts are counted whole. Where nothing could be fitted, the base rules alone decide.
    """
    rows = stored(base_counts(df, id_col, text_col, group_cols).withColumnRenamed("_group", "_key"))
    limit = chi2_quantile(cut, P)
    return outliers(rows).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("_d2").alias("distance2"),
        (~F.col("base_failed") & (F.coalesce(F.col("_d2"), F.lit(0.0)) <= limit)).alias("kept"),
    )
