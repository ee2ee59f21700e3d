"""Quality classifier, ranked search and collocations against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from cadenza.llm import clustered_search, collocations, discriminant, sql

DOCS = "doc_id long, text string, lang string, source string"


def prose(rng: random.Random, n: int, vocab: list[str]) -> str:
    return "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", ", ", ". ", ".\n"]) for _ in range(n))


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randrange(1, 8))) for _ in range(n)]


# --- quality classifier


def labelled(n: int = 900):
    rng, rows = random.Random(3), []
    vocab = words(rng, 500)
    for i in range(n):
        good = rng.random() < 0.75
        text = prose(rng, rng.randrange(5, 200), vocab)
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), f"{text.split()[0]} " * 90])
        rows.append((i, text, int(good)))
    return rows


def plain_scores(rows, learned):
    """Quadratic discriminant by the textbook, on all statistics at once."""
    x = np.array([discriminant.statistics(t) for _, t, _ in rows])
    y = np.array([k for *_, k in rows])
    cov = {k: np.cov(x[learned & (y == k)].T, bias=True) for k in (0, 1)}
    share = {k: (learned & (y == k)).sum() / learned.sum() for k in (0, 1)}
    pooled, density = share[0] * cov[0] + share[1] * cov[1], []
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * pooled
        c = 0.95 * c + 0.05 * np.diag(np.diag(c))
        c += np.diag(np.maximum(1e-3 - np.diag(c), 0) + 1e-9)
        d = x - x[learned & (y == k)].mean(axis=0)
        density.append(math.log(share[k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (d @ np.linalg.inv(c) * d).sum(axis=1))
    return density[1] - density[0]


def test_discriminant(spark):
    rows = labelled()
    docs = spark.createDataFrame([*((i, t, "xx", "s") for i, t, _ in rows), (None, "null id", None, None), (5000, None, None, None), (5001, " \n", None, None), (7, "twice", None, None)], DOCS)
    labels = spark.createDataFrame([*((i, k, 0) for i, _, k in rows), (None, 1, 0), (5000, None, None), (3, 7, 0)], "doc_id long, quality int, toxic int")
    out = discriminant.classify(docs, labels).collect()
    assert len(out) == docs.count()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows])
    found = {r["doc_id"]: r for r in out if r["doc_id"] != 7}
    right = 0
    for (i, _, k), h in zip(rows, held):
        if i == 7:
            continue
        assert found[i]["held_out"] == h and 0 <= found[i]["score"] <= 1 and found[i]["predicted"] == (found[i]["score"] >= 0.5)
        right += h and found[i]["predicted"] == k
    assert right / held.sum() > 0.97
    assert not found[None]["held_out"] and found[5000]["score"] == found[5001]["score"]
    # without the odd rows, the odds are those of the textbook
    clean = [r for r in rows if r[0] != 7]
    out = discriminant.classify(spark.createDataFrame([(i, t, "xx", "s") for i, t, _ in clean], DOCS), labels).collect()
    odds = plain_scores(clean, ~np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in clean]))
    for (i, *_), d in zip(clean, odds):
        s = next(r["score"] for r in out if r["doc_id"] == i)
        assert math.isclose((1 / (1 - s) - 2) if s >= 0.5 else 2 - 1 / s, d, rel_tol=1e-4, abs_tol=1e-5)


def test_discriminant_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (2, None, None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in discriminant.classify(docs, none).collect()} == {(0.5, 1)}
    assert discriminant.classify(docs.limit(0), none).count() == 0
    # other names, and tables whose columns bear the operator's own names
    odd = spark.createDataFrame([(1, "a b", 0.5, "x")], "key long, body string, score double, _id string")
    assert discriminant.classify(odd, none.withColumnRenamed("doc_id", "key"), "key", "body").columns == ["key", "held_out", "score", "predicted"]


def test_statistics_of_long_and_odd_texts():
    assert discriminant.statistics(None) == discriminant.statistics(" \t\n") == (0.0,) * discriminant.P
    assert all(map(math.isfinite, discriminant.statistics("a " * 500_000))) and all(map(math.isfinite, discriminant.statistics("x" * 2_000_000)))


# --- ranked search


def corpus(n: int = 700):
    rng = random.Random(8)
    vocab = words(rng, 400)
    topics = [rng.sample(vocab, 40) for _ in range(8)]
    rows = [(i, prose(rng, rng.randrange(1, 120), rng.choice(topics) + vocab[:20]), "xx", "s") for i in range(n)]
    rows += [(10_000 + i, rows[5][1], "xx", "s") for i in range(60)]  # copies: equal scores
    return [*rows, (20_000, None, None, None), (20_001, "... !", "xx", "s"), (20_002, "İstanbul É é ß " * 3, "xx", "s"), (20_003, f"{vocab[3]} " * 5000, "xx", "s")]


def search_items():
    rng = random.Random(9)
    docs = [r[1] for r in corpus() if r[1]]
    items = [(k, " ".join(rng.choice(docs).split()[:25])) for k in range(30)]
    return [*items, (90, None), (91, ""), (92, "nowhere-found qqqq"), (93, docs[5] * 3), (94, "É É"), (None, docs[9])]


def by_sql(text: str, **tables):
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con.execute(text).fetchall()


SQL_DOCS = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR"


def test_search_is_the_full_scan(spark, monkeypatch):
    monkeypatch.setattr(clustered_search, "BLOCK_DOCS", 16)  # many blocks to a leaf
    docs, items = corpus(), search_items()
    index = clustered_search.build(spark.createDataFrame(docs, DOCS).repartition(5))
    told: list = []
    out = clustered_search.search(index, spark.createDataFrame(items, "item_id long, text string"), told=told).select("item_id", "rank", "doc_id", "score").collect()
    want = by_sql(sql.RANKED_SEARCH, documents=(SQL_DOCS, docs), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str) and len(out) > 400
    assert told[0][0] < told[0][1]  # it stopped before all leaves
    clustered_search.release(index)


def test_search_in_several_passes(spark, monkeypatch):
    docs, items = corpus(200), search_items()
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, clustered_search.ranked(*frames).collect()), key=str)
    monkeypatch.setattr(clustered_search, "BLOCK_CHARS", 900)
    assert sorted(map(tuple, clustered_search.ranked(*frames).collect()), key=str) == whole


def test_search_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c", "x", "y"), (4, "a b c", "x", "y"), (4, "a b c", "x", "y"), (3, "a b d", "x", "y")], DOCS)
    items = spark.createDataFrame([(1, "c d a")], "item_id int, text string")
    found = [(r["rank"], r["doc_id"]) for r in clustered_search.ranked(docs, items).orderBy("rank").collect()]
    assert found[0] == (1, 3) and [d for _, d in found[1:]] == [4, 4, None]
    assert clustered_search.ranked(docs.limit(0), items).count() == 0 == clustered_search.ranked(docs, items.limit(0)).count()
    odd = docs.withColumns({"cluster": docs.doc_id, "block": docs.doc_id, "term": docs.text})
    assert clustered_search.ranked(odd, items).count() == 4


def test_bisection_parts_topics():
    rng = random.Random(1)
    lists = [np.array(rng.sample(range(0, 300) if i % 2 else range(300, 600), 30)) for i in range(200)]
    gains, cuts = clustered_search.fit_tree(lists, 1)
    side = [gains[0][x].mean() > cuts[0] for x in lists]
    assert len({s for i, s in enumerate(side) if i % 2}) == 1 == len({s for i, s in enumerate(side) if not i % 2}) and side[0] != side[1]


# --- collocations


def brute_counts(rows) -> Counter:
    f: Counter = Counter()
    for _, text, lang, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3, 4):
                f.update((lang or "und", " ".join(own[i : i + k])) for i in range(len(own) - k + 1))
    return f


def phrases():
    rng = random.Random(4)
    vocab = words(rng, 60)
    rows = []
    for i in range(400):
        text = prose(rng, rng.randrange(0, 80), vocab[:7] if i % 3 else vocab)
        if i % 4 == 0:
            text += " one Two\tthree four five. La la la la la la! É é"
        rows.append((i, text, ["xx", "yy", None][i % 3], "s"))
    return [*rows, (900, None, "xx", "s"), (901, "", "zz", "s"), (902, "\x0b\x0c ; \t", "zz", "s"), (903, "ha " * 20_000, "xx", "s"), *rows[:40]]


def test_collocations(spark, monkeypatch):
    rows = phrases()
    want = sorted(by_sql(sql.COLLOCATIONS, documents=(SQL_DOCS, rows)))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, collocations.collocations(docs).select(*columns).collect())) == want and len(want) > 60
    counts = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs).collect() if r["phrase"]}
    assert counts == {k: n for k, n in brute_counts(rows).items() if n >= 30}
    # small blocks and chunks change nothing
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 500)
    monkeypatch.setattr(collocations, "CHUNK", 300)
    monkeypatch.setattr(collocations, "COMBINED", 200)
    assert sorted(map(tuple, collocations.collocations(docs).select(*columns).collect())) == want


def test_collocations_of_a_crowded_bitmap(spark, monkeypatch):
    """A bitmap that rules nothing out gives the same phrases."""
    rows = phrases()
    docs = spark.createDataFrame(rows, DOCS)
    full = collocations.Bitmap(np.full(collocations.FILTER, 255, dtype=np.uint8))
    monkeypatch.setattr(collocations, "may_be_frequent", lambda *a: full)
    counts = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs).collect() if r["phrase"]}
    assert counts == {k: n for k, n in brute_counts(rows).items() if n >= 30}


def test_collocations_exact_arithmetic(spark):
    big = 3 * 10**18
    counts = spark.createDataFrame([("x", "a", big + 7), ("x", "b", big + 1), ("x", "a b", big - 11)], "lang string, phrase string, f long")
    (row,) = collocations.candidates(counts).collect()
    assert row["score"] == 2_000_000 * (big - 11) // (2 * big + 8)
    covered = spark.createDataFrame([("x", "a b", 100, 1, 1, 1), ("x", "a b c", 79, 1, 1, 1), ("x", "b c", 98, 1, 1, 1), ("x", "b c d", 79, 1, 1, 1)], "lang string, phrase string, a long, l long, r long, score long")
    assert {r["phrase"] for r in collocations.uncovered(covered).collect()} == {"a b", "a b c", "b c d"}


def test_collocations_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert collocations.collocations(docs).count() == 0
    odd = spark.createDataFrame([("a b. " * 40, "x", 1, "p")], "text string, lang string, rank int, phrase string")
    assert [(r["phrase"], r["a"], r["l"], r["n"]) for r in collocations.collocations(odd).collect()] == [("a b", 40, 40, 80)]
