"""The corpus pipeline on a small corpus, stage by stage, against what each stage must keep and drop."""

from __future__ import annotations

import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from cadenza.llm import piece_codec  # noqa: E402

WORDS = {"en": "the of and house water reading under light morning".split(), "de": "der die und haus wasser lesen unter licht morgen".split()}


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lang = rng.choice(list(WORDS))
        lines = [" ".join(rng.choice(WORDS[lang]) + str(rng.randrange(300)) for _ in range(25)) for _ in range(4)]
        rows.append([i, "\n".join(lines), lang, "s"])
    near = rows[10][1].split("\n")
    item = "seven distinct benchmark words stand here in one long question about pianos"
    rows += [
        [300, rows[10][1], rows[10][2], "s"],  # a copy: every line goes
        [301, None, None, None],
        [302, "123 456", "en", "s"],  # no language
        [303, f"{rows[20][1].split(chr(10))[0]}\n{' '.join(WORDS['en'])} own line of this one", "en", "s"],  # its first line goes
        [304, f"{near[0]} end the of and {item} the house water light reading under", "en", "s"],  # a benchmark item
    ]
    return [(*r, len(r[1] or "")) for r in rows], [(1, item)]


def test_odd_tables(spark, tmp_path):
    """Columns with the operators' names, nulls everywhere, repeated rows, and no rows at all."""
    rows, bench = corpus()
    own = ", score int, lang_pred string, _row string, _id int, _kept string, l int, c int, `a.b` string"
    wide = [(*r[:4], 1, "x", "y", 2, "z", 3, 4, "w") for r in rows[:40]] + [(None,) * 12, (None, rows[0][1], *[None] * 10)]
    df = spark.createDataFrame([*wide, wide[0]], "doc_id long, text string, lang string, source string" + own)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (df, df.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == df.columns
                out = corpus_pipeline.stored(out)
            docs = out
        found = docs.collect()
        assert {r["doc_id"] for r in found} <= {r[0] for r in wide} and (len(found) > 30 or not found)


def test_stages(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = corpus_pipeline.table(spark, str(tmp_path), "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            out = corpus_pipeline.stored(out)
        docs = out
        kept.append({r["doc_id"]: r for r in out.collect()})
    language, lines, near, clean, ids = kept
    assert set(language) == set(range(200)) | {300, 303, 304}
    assert set(lines) == set(language) and lines[300]["text"] == "" and lines[303]["text"].count("\n") == 0
    assert all(lines[i]["n_chars"] == len(lines[i]["text"]) for i in lines)
    assert set(near) == set(lines)
    assert set(clean) == set(near) - {304}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_codec.MODEL))
    for i, r in ids.items():
        want = library.encode(clean[i]["text"])
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()
