"""The similarity joins against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from cadenza.llm import line_dedup, ngram_join, sentence_spans
from cadenza.llm.components import components


def shingle_set(text: str | None, n: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, n))
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
            a, b = sorted((root(i), root(j)))
            least[b] = a
    return sorted(((i, len(shingle_set(t, n)), None if i is None else root(i)) for i, t in rows), key=str)


def near_corpus(seed: int, groups: int = 12, copies: int = 9) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["the"] * 60
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 40, 90]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            out = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(out))
                kind = rng.random()
                if kind < 0.4:
                    out[at] = rng.choice(vocab)
                elif kind < 0.7:
                    out.insert(at, rng.choice(vocab))
                elif len(out) > 1:
                    del out[at]
            texts.append("\t".join(out).upper() if rng.random() < 0.2 else " ".join(out))
            if rng.random() < 0.4:
                base = out  # chains: the ends may link only through what lies between
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 3, 80), (3, 5, 80), (4, 1, 50)])
def test_near_groups(spark, seed, n, percent):
    rows = near_corpus(seed)
    found = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent)
    assert sorted(map(tuple, found.collect()), key=str) == brute_groups(rows, n, percent)


def test_near_groups_of_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "two one"), (None, "one two"), (None, None), (12, "É a b"), (13, "é a b"), (14, "a b c d"), (3, "a b c d"), (8, "a b c d e")]
    df = spark.createDataFrame([(*r, r[0], "x") for r in rows], "doc_id long, text string, rep long, n_shingles string")
    assert sorted(map(tuple, ngram_join.near_groups(df).collect()), key=str) == brute_groups(rows, 3, 90)
    assert ngram_join.near_groups(df.limit(0)).count() == 0
    kept = ngram_join.one_of_each(df, n=3, percent=90)
    assert kept.columns == df.columns
    assert {r[0] for r in kept.collect()} == {5, 6, 7, 8, 10, 11, None, 12, 13, 3}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (10, 11), (12, 11), (7, 7), (None, 1)] + [(100 + k, 101 + k) for k in range(60)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 7: 7, **{100 + k: 100 for k in range(61)}}


def brute_lines(rows, percent):
    """(id, n_lines, n_removed, text) of rows with distinct ids, in the order of their ids (null first)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen: list[frozenset] = []
    out = []
    for i, t in order:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        lines, kept = t.split("\n"), []
        for line in lines:
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if not s:
                kept.append(line)
                continue
            if not any(100 * len(s & x) >= percent * len(s | x) for x in seen):
                kept.append(line)
            seen.append(s)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines(spark, seed):
    rng = random.Random(seed)
    vocab = [f"t{k}" for k in range(60)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 6, 10, 14]))) for _ in range(40)] + ["", "   ", "\t", "\r"]
    rows: list[tuple] = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = rng.choice(pool).split(" ")
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            lines.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        rows.append((i, "\n".join(lines)))
    rows += [(None, pool[0] + "\nnew words here"), (200, None), (201, ""), (202, "\n\n")]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, s string, n_lines string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "s", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute_lines(rows, 80)


def test_long_lines(spark):
    """Lines of over line_dedup.LONG words, near the limit of similarity from both sides."""
    rng = random.Random(11)
    vocab = [f"t{k}" for k in range(900)]
    base = [rng.sample(vocab, n) for n in (45, 49, 60, 90, 150, 300)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for at in rng.sample(range(len(words)), rng.randrange(0, len(words) // 6)):
            words[at] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute_lines(rows, 80)


def test_lines_are_cut_once_a_step_and_tokens_exchanged_in_passes(spark, monkeypatch):
    """No step cuts its lines into words for a filter and again for a column; no two exchanges of entries hold one token."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(12))) for i in range(80)]
    plans, tokens, stored, bucketed = [], [], line_dedup.stored, line_dedup.bucketed

    def kept(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, **options)

    def dealt(df, *keys):
        out = bucketed(df, *keys)
        tokens.append({r["s"] for r in out.select("s").collect()})
        return out

    monkeypatch.setattr(line_dedup, "stored", kept)
    monkeypatch.setattr(line_dedup, "bucketed", dealt)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute_lines(rows, 80)
    assert max(p.count("transform(split(") for p in plans) == 1
    assert len(tokens) > 1 and all(tokens) and not set.intersection(*tokens)


def test_lines_beside_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1, 2, 3), (2, "a b c d e f", "y", 4, 5, 6)], "doc_id long, text string, _row string, k_id int, at int, `a.b` int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d e f", "x", 1, 2, 3, 1, 0), (2, "", "y", 4, 5, 6, 1, 1)]


def test_lines_of_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "a b c"), (2, "g h i\na b c")], "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert out == [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, ""), (2, "g h i")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_spans(rows):
    """(id, n_sentences, n_removed, text) of rows with distinct ids."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = sentence_spans.sentences(t)
        gone = set()
        for a in range(len(parts)):
            for b in range(a + sentence_spans.RUN, len(parts) + 1):
                words = [p.lower().split() for p in parts[a:b]]
                if sum(map(len, words)) >= sentence_spans.WORDS:
                    key = tuple(map(tuple, words))
                    gone |= set(range(a, b)) if key in seen else set()
                    seen.add(key)
                    break
        out.append((i, len(parts), len(gone), t if not gone else "".join(p for k, p in enumerate(parts) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_spans(spark, seed):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(300)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 5, 9, 70]))) + rng.choice([".", "!", "?\n", "\n", ""]) for _ in range(80)]
    passages = [" ".join(rng.choice(pool) for _ in range(6)) for _ in range(5)]
    rows: list[tuple] = [(i, " ".join(rng.choice(pool + passages * 4) for _ in range(rng.randrange(1, 9)))) for i in range(50)]
    rows += [(None, passages[0]), (100, None), (101, ""), (102, " \n "), (103, passages[1].upper().replace(" ", "  "))]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, pos int")
    assert sorted(map(tuple, sentence_spans.dedup_spans(df).collect()), key=str) == brute_spans(rows)
    assert sentence_spans.dedup_spans(df.limit(0)).count() == 0


def test_a_passage_of_over_fifty_words_is_found_whatever_its_punctuation(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(k, f"Own words number {k} of this one. {passage} and then {k * k} more. The end of {k}.") for k in range(1, 5)]
    out = {r["doc_id"]: r["text"] for r in sentence_spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in out[1]
    for k in (2, 3, 4):
        assert "p40" not in out[k] and "Own words" in out[k]


@pytest.mark.parametrize("gap", [" ", "\t", "\u00a0"])
@pytest.mark.parametrize("ends", [0.0, 0.05, 0.3])
def test_passages_of_over_fifty_words_share_a_span_wherever_they_begin(gap, ends):
    rng = random.Random(7)
    words = lambda n: [f"s{rng.randrange(3000)}" + ("." if rng.random() < ends else "") for _ in range(n)]
    for _ in range(200):
        passage = words(rng.randrange(51, 61))
        found = []
        for _ in range(2):
            text = gap.join(words(rng.randrange(40)) + passage + words(rng.randrange(40)))
            parts = sentence_spans.sentences(text)
            assert "".join(parts) == text
            found.append({"".join(parts[i : i + n]).rstrip() for _, _, i, n in sentence_spans.spans(parts)})
        shared = found[0] & found[1]
        assert any(x in gap.join(passage) for x in shared)


def test_passages_in_the_middle_of_sentences_are_removed(spark):
    rng = random.Random(8)
    words = lambda n: [f"s{rng.randrange(3000)}" for _ in range(n)]
    passage = words(55)
    rows = [(k, " ".join(words(rng.randrange(40)) + passage + words(rng.randrange(40)))) for k in range(12)]
    out = sorted(map(tuple, sentence_spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert sorted(out, key=str) == brute_spans(rows)
    assert [r[2] > 0 for r in out] == [False] + [True] * 11


def test_sentences_join_to_the_text():
    for text in ["", "a. b! c?\n\nd", "1.5 is no end. Yes", "x " * 100, "...", " lead. Then", "no end\n \n\tthen"]:
        assert "".join(sentence_spans.sentences(text)) == text


def test_spans_are_hashed_by_their_words_and_sentences():
    """Equal hashes exactly where the sentences' words are equal, for texts beyond the tables of powers too."""
    rng, marks, powers, seen, back = random.Random(12), sentence_spans.Marks(), sentence_spans.Powers(), {}, {}
    texts = ["".join(rng.choice(["a ", "b ", "B  ", "c. ", "d\n", "e! ", "ΑΣ "]) for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += ["a b. " * 40, " \n", "\n x. y", "a b c d e f g h i j k l m. " * 400]
    for text in texts:
        parts = sentence_spans.sentences(text)
        found, bounds = sentence_spans.cut(text, marks)
        assert len(bounds) == len(parts) or not text.split()
        if not len(bounds):
            continue
        words = [tuple(p.lower().split()) for p in parts]
        h1, h2, n = sentence_spans.hashed(found, bounds, powers)
        expected = []
        for i in range(len(parts)):
            k = next((k for k in range(sentence_spans.RUN, len(parts) - i + 1) if sum(map(len, words[i : i + k])) >= sentence_spans.WORDS), None)
            if k:
                expected.append(k)
        assert n.tolist() == expected
        for i, (x, y, k) in enumerate(zip(h1.tolist(), h2.tolist(), n.tolist())):
            span = tuple(words[i : i + k])
            assert seen.setdefault((x, y), span) == span and back.setdefault(span, (x, y)) == (x, y)
