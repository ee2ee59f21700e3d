"""Token counts by prefix dynamic programming (byte-level BPE).

For every prefix of a chunk of text the table holds the last token of that prefix's encoding and its token count:
the last token is the one vocabulary entry ending there that may stand beside the last token of the prefix before it.
Counts, truncation and budget questions are then look-ups; nothing is encoded again.
"""

from __future__ import annotations

import json
import re

import regex
from pyspark.sql import DataFrame

from .bpe import Merges
from .common import map_arrow, resident

MODEL = "byte_bpe_50k.json"
LIMIT = 1024


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(free)) for b in range(256)]


def latin_split() -> re.Pattern:
    """The splitting pattern with its classes spelled out for characters up to U+024F, for texts that have no others."""
    chars = [chr(c) for c in range(0x250)]
    kind = {k: "".join(c for c in chars if regex.fullmatch(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    letter, number, space = (re.escape(kind[k]) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class _Counts(dict):
    """chunk -> tokens, remembered up to a bound; the bound changes speed only."""

    LIMIT, LONGEST = 300_000, 64

    def __init__(self, table):
        self.table = table

    def __missing__(self, chunk: str) -> int:
        n = self.table(chunk)[0][-1]
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = n
        return n


class ByteTokenCounter:
    """Exact counts for one byte-level BPE file of the ``tokenizers`` JSON format.

    Special strings of the file count as one token each, as that library does by default.
    """

    def __init__(self, path: str):
        import public_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ranks = {pair: i for i, pair in enumerate(pairs)}
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.merges = Merges({t: i for t, i in vocab.items() if t not in self.special_ids}, lambda a, b: ranks.get((a, b)))
        self.latin = {b: c for b, c in enumerate(byte_alphabet())}
        self.latin_split, self.above = latin_split(), re.compile("[^\x00-\u024f]")
        self.known = _Counts(self.table)

    def table(self, chunk: str) -> tuple[list[int], list[int]]:
        """Counts and last tokens at every byte prefix of one chunk (index 0: the empty prefix)."""
        s = chunk.encode("utf-8").decode("latin-1").translate(self.latin)
        n = len(s)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        pairs, beside, alone = self.merges.pairs, self.merges.beside, self.merges.alone
        for end, (length, token) in self.merges.automaton.iter(s):
            end += 1
            if not count[end]:
                left = last[end - length]
                if left >= 0:
                    fits = pairs.get(left << 32 | token)
                    if fits or fits is None and beside(left, token):
                        count[end], last[end] = count[end - length] + 1, token
                elif length == end and alone(token):
                    count[end], last[end] = 1, token
        return count, last

    def chunks(self, piece: str) -> list[str]:
        return (self.split if self.above.search(piece) else self.latin_split).findall(piece)

    def pieces(self, text: str) -> list[str]:
        """Parts between special strings, and these strings."""
        return [p for p in self.special.split(text) if p] if self.special else [text] * bool(text)

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; 0 for null."""
        if not text:
            return 0
        known = self.known
        return sum(1 if p in self.special_ids else sum(map(known.__getitem__, self.chunks(p))) for p in self.pieces(text))

    def prefix_counts(self, text: str) -> list[int]:
        """Entry i: the tokens of text[:i] (characters), each exactly as if that prefix were encoded by itself.

        Inside a chunk the dynamic-programming table answers. Only where a cut changes how the text is split (inside
        a run of white space, a contraction or a special string) is the short tail split anew.
        """
        out, base = [0], 0
        chunks: list[tuple[int, int, str, bool]] = []
        at = 0
        for piece in self.pieces(text):
            for chunk in [piece] if piece in self.special_ids else self.chunks(piece):
                chunks.append((at, at + len(chunk), chunk, piece in self.special_ids))
                at += len(chunk)
        done: list[int] = []  # tokens before each chunk
        for start, end, chunk, special in chunks:
            done.append(base)
            k = len(done) - 1
            tail = k
            while tail and chunks[tail - 1][2].isspace() and not chunks[tail - 1][3]:
                tail -= 1
            plain = not special and not chunk.isspace() and chunk[0] not in "'"
            counts = None if special else self.table(chunk)[0]
            width = 0
            for i, c in enumerate(chunk):
                width += len(c.encode("utf-8"))
                if plain and chunk[: i + 1].strip() and i + 1 < len(chunk) or i + 1 == len(chunk) and (special or not chunk.isspace()):
                    out.append(base + (1 if special else counts[width]))
                else:
                    from_ = chunks[tail][0]
                    out.append(done[tail] + self.count(text[from_ : start + i + 1]))
            base += 1 if special else counts[-1]
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix whose every shorter prefix, and itself, has at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        over = next((i for i, n in enumerate(counts) if n > budget), len(counts))
        return text[: over - 1]


def counter(path: str | None = None) -> ByteTokenCounter:
    import public_tokenizers

    path = path or public_tokenizers.path(MODEL)
    return resident(("bytes", path), lambda: ByteTokenCounter(path))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    Null text counts as empty (0 bytes, 0 tokens). Repeated rows stay repeated, null ids stay null, further columns of
    ``df`` are not read. Any length is handled: memory follows the longest run between two splits.
    """

    def make():
        c = counter(path)

        def batch(ids, texts):
            n = [c.count(t) for t in texts]
            return ids, [len(t.encode("utf-8")) if t else 0 for t in texts], n, [x > limit for x in n]

        return batch

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df, [id_col, text_col], make, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
