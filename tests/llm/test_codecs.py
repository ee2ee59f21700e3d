"""Both encoders against the libraries whose results they reproduce."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
import tokenizers  # noqa: E402

from cadenza.llm import piece_codec, token_counts  # noqa: E402

TEXTS = [
    "", " ", "  ", "\n", "a", "Hello world", " leading", "trailing ", "two  spaces", "tabs\tand\nlines\r\n", "naïve café ﬁ", "日本語のテキスト", "🎹🎼 emoji 👩‍👩‍👧",
    "x" * 3000, "ab" * 2000, " " * 500, "▁mark ▁▁ marks", "<s>", "</s> <unk> <0x41>", "<|endoftext|> inside <|endoftext|>", "don't we'll I'm they've 123456 3.14159", "!!!???...", "​zero width", "\x00\x01 control", "ÀÉÎ" * 50, "á combining", "l'été 12e", "ß" * 9,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_codec.MODEL))


@pytest.fixture(scope="module")
def byte_library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(token_counts.MODEL))


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_as_the_library(library, text):
    codec = piece_codec.codec()
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", TEXTS)
def test_counts_as_the_library(byte_library, text):
    assert token_counts.counter().count(text) == len(byte_library.encode(text, add_special_tokens=False).ids)


odd = st.text(alphabet=st.sampled_from("abcdeXYZ  \n\t.,'▁éß字🎹0123<>|sun"), max_size=60) | st.text(max_size=40).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s))


@settings(max_examples=300, deadline=None)
@given(odd)
def test_any_text(library, byte_library, text):
    codec = piece_codec.codec()
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids)
    assert token_counts.counter().count(text) == len(byte_library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(3, 600), max_size=30))
def test_decoding_any_ids(library, ids):
    assert piece_codec.codec().decode(ids) == library.decode(ids)


@settings(max_examples=60, deadline=None)
@given(odd)
def test_prefix_counts(byte_library, text):
    c = token_counts.counter()
    counts = c.prefix_counts(text)
    assert counts == [len(byte_library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    for budget in (0, 1, 3):
        cut = c.truncate(text, budget)
        assert text.startswith(cut) and all(n <= budget for n in counts[: len(cut) + 1])
        assert cut == text or counts[len(cut) + 1] > budget


def test_frames(spark, library, byte_library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (900, None, None), (1, " ", "again"), (1, " ", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = sorted(map(tuple, piece_codec.digest_texts(df).collect()), key=str)
    ids = [(i, library.encode(t or "")) for i, t, _ in rows]
    assert found == sorted([(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in ids], key=str)
    found = sorted(map(tuple, token_counts.token_counts(df, limit=100).collect()), key=str)
    n = [(i, len((t or "").encode()), len(byte_library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert found == sorted([(*x, x[2] > 100) for x in n], key=str)
    assert piece_codec.digest_texts(df.limit(0)).count() == token_counts.token_counts(df.limit(0)).count() == 0
