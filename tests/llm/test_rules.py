"""Base counts, outliers, language identification and sharding."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest

from cadenza.llm import language_id, quality, shards


def brute_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_by_brute_force():
    rng = random.Random(5)
    texts = [None, "", " ", "a", "a " * 8, "a " * 9, "a\x0bb\x0cc\rd\te", "x y z", "é字🎹 #*$", "a\n\na\n a\n", "# & |\n# & |"]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "a b c ", "\n", "<$ "]) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += [" ".join(str(rng.randrange(40)) for _ in range(60)) * 2 for _ in range(20)]
    for text in texts:
        assert quality.counts(text) == brute_counts(text), text


def corpus(n: int = 1500):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(900)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(40, 400))]
        text = "".join(w + rng.choice([" ", " ", " ", " ", ", ", ". "]) for w in words)
        if i % 50 == 7:
            text = "".join(rng.choice(["$#%&* ", "<<|>> ", "a ", "b! ", "... "]) for _ in range(200))
        rows.append((i, text, "xx", "hot" if i % 3 else "cold"))
    return rows


def test_outliers(spark):
    rows = corpus()
    df = spark.createDataFrame([*rows, (None, None, None, None), (5000, "too few words", "yy", None)], "doc_id long, text string, lang string, source string").withColumn("_group", quality.F.lit(1))
    out = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert len(out) == len(rows) + 2
    for i, text, *_ in rows:
        assert tuple(out[i])[1:6] == brute_counts(text)
        assert out[i]["kept"] == (i % 50 != 7), i
    assert out[None]["base_failed"] and not out[None]["kept"] and out[5000]["base_failed"]
    assert quality.quality(df.limit(0)).count() == 0


def plain_determinant(x: np.ndarray) -> float:
    """Least log determinant by a plain version: exact concentration steps from many random subsets."""
    rng, best = np.random.default_rng(3), math.inf
    h = int(quality.KEEP * len(x))
    scale = quality.KEEP / quality.chi2_cdf(quality.chi2_quantile(quality.KEEP, quality.P), quality.P + 2)
    floor = np.array(quality.FLOOR) ** 2
    for _ in range(60):
        rows, last = x[rng.choice(len(x), quality.P + 1, replace=False)], math.inf
        factor = 1.0
        while True:
            mean, cov = rows.mean(axis=0), np.cov(rows.T, bias=True) * factor
            cov = cov + np.diag(np.maximum(floor - np.diag(cov), 0) + 1e-9)
            det = float(np.linalg.slogdet(cov)[1])
            if factor > 1 and det >= last - 1e-9:
                break
            last, factor = (det if factor > 1 else math.inf), scale
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            rows = x[np.argsort(d)[:h]]
        best = min(best, last)
    return best


def test_least_determinants_against_a_plain_version(spark):
    rng, groups = np.random.default_rng(1), {}
    for k, n in enumerate((40, 120, 400, 2000)):
        mix = rng.normal(size=(quality.P, quality.P)) / 2 + np.eye(quality.P)
        x = rng.normal(size=(n, quality.P)) @ mix
        x[: n // 5] = rng.normal(size=(n // 5, quality.P)) * 0.3 + 8  # a tight knot of outliers that drags a plain mean
        groups[f'["l{k}","s"]'] = x
    rows = [(key, *map(float, r)) for key, x in groups.items() for r in x]
    fits = quality.determinant_fits(spark.createDataFrame(rows, "_key string, " + ", ".join(f"{f} double" for f in quality.FEATURES))).collect()
    assert {r["_key"] for r in fits} == set(groups)
    for r in fits:
        x = groups[r["_key"]]
        assert abs(r["det"] - plain_determinant(x)) < 0.05, (r["_key"], r["det"], plain_determinant(x))
        clean = x[len(x) // 5 :].mean(axis=0)
        assert all(abs(r[f"m{i}"] - clean[i]) < 0.7 for i in range(quality.P))


def test_a_small_group_is_judged_by_its_language(spark):
    rows = [r for r in corpus(600)] + [(9000, rows_text(), "xx", "tiny"), (9001, "$#%&* " * 100, "xx", "tiny")]
    out = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[9000]["kept"] and not out[9001]["kept"]


def rows_text() -> str:
    return corpus(3)[2][1]


def test_a_constant_feature_is_no_crash(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30)), "a", "b") for i in range(150)], "doc_id long, text string, lang string, source string")
    assert all(r["kept"] for r in quality.quality(df).collect())


WORDS = {"en": "the of and house water reading under light", "de": "der die und haus wasser lesen unter licht", "fr": "le la et maison eau lecture sous lumière"}


def test_language(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 40))), lang) for i, lang in enumerate(rng.choices(list(WORDS), k=900))]
    odd = [(None, "the house", None), (2000, None, "en"), (2001, "", "en"), (2002, "123 !?", "en"), (2003, "haus und wasser", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, score string")
    out = language_id.identify(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r["doc_id"]: r for r in out.collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    held = [(i, lang) for i, _, lang in rows if found[i]["held_out"]]
    assert len(held) > 150 and sum(found[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert [found[i]["lang_pred"] for i in (2000, 2001, 2002, 2003)] == ["und", "und", "und", "de"]
    assert found[None]["lang_pred"] == "en" and not found[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.identify(df.limit(0)).count() == 0
    assert [r["lang_pred"] for r in language_id.identify(df.withColumn("lang", language_id.F.lit(None).cast("string")).limit(3)).collect()] == ["und"] * 3


def test_language_against_plain_naive_bayes(spark):
    """Counts, priors and argmax in plain Python over the same hashed n-grams."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(1, 6))), lang) for i, lang in enumerate(rng.choices(list(WORDS), weights=[8, 1, 1], k=300))]
    langs, matrix, prior = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams, documents = {lang: {} for lang in WORDS}, dict.fromkeys(WORDS, 0)
    for _, text, lang in rows:
        documents[lang] += 1
        for h in language_id.buckets_of(text):
            for b in h.tolist():
                grams[lang][b] = grams[lang].get(b, 0) + 1
    assert langs == sorted(WORDS)
    for text in [r[1] for r in rows[:80]] + ["haus", "x", "the la", "der of la " * 50]:
        best = {}
        for lang in langs:
            size = sum(grams[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
            best[lang] = math.log(documents[lang] / len(rows)) + sum(math.log((grams[lang].get(b, 0) + language_id.SMOOTHING) / size) for h in language_id.buckets_of(text) for b in h.tolist())
        top = max(best.values())
        assert best[language_id.score(text, langs, matrix, prior)[0]] > top - 1e-3
    both = list(language_id.scores([r[1] for r in rows] + [None, "", "12"], langs, matrix, prior))
    assert both == [language_id.score(t, langs, matrix, prior) for t in [r[1] for r in rows] + [None, "", "12"]]


def test_too_many_labels_are_refused_before_gathering(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.train(spark.createDataFrame([(k, "text", f"l{k}") for k in range(5)], "doc_id long, text string, lang string"))


def test_language_slices_equal_the_whole_text():
    text = "wasser und haus " * 30
    model = (["a", "b"], language_id.np.log(language_id.np.random.default_rng(1).random((language_id.BUCKETS, 2))).astype("float32"))
    whole = language_id.score(text, *model)
    assert language_id.score(text.upper(), *model) == whole
    rng = random.Random(8)
    texts = [text, "wasserundhaus" * 30, " . ", "a", "İΣ ", *("".join(rng.choice("abé ß.\n1İΣ") for _ in range(rng.randrange(60))) for _ in range(200))]
    for text in texts:
        counts = []
        for size in (1, 2, 7, 10, 1 << 18):
            counts.append(sum((np.bincount(h, minlength=language_id.BUCKETS) for h in language_id.buckets_of(text, size)), np.zeros(language_id.BUCKETS, dtype=int)))
        assert all((c == counts[-1]).all() for c in counts), text


def test_number_of_languages_is_the_callers(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", f"l{i % 5}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="allows for 4"):
        language_id.identify(docs, most=4)
    assert language_id.identify(docs, most=5).count() == 60


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(1, 400) + str(rng.randrange(2000))) for i in range(4000)] + [(5000 + i, "copy" * 30) for i in range(1500)] + [(9000, None), (9001, ""), (None, "é"), (None, "é")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, size int")
    out = shards.shard_by_bytes(df).collect()
    assert len(out) == len(rows)
    load, slots, homes = {}, {}, {}
    texts = dict(rows)
    for r in out:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(text, set()).add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in homes.values())
    assert set(load) == set(range(16))
    rest = sorted(load.values())
    copies = 1500 * 121
    if copies <= sum(rest) / 16:
        assert rest[-1] <= 1.02 * rest[0]
    else:  # one group is larger than a shard
        assert rest[-1] == copies and rest[-2] <= 1.02 * rest[0]
    assert shards.shard_by_bytes(df.limit(0)).count() == 0


def test_longest_first():
    assert shards.longest_first([(3, "a"), (3, "b"), (2, "c"), (2, "d"), (2, "e")], 2) == [("a", 0), ("b", 1), ("c", 0), ("d", 1), ("e", 0)]
