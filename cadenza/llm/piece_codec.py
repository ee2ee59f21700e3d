"""SentencePiece encoding and decoding for merge-type models, by backtracking over vocabulary matches.

An Aho-Corasick automaton yields all vocabulary entries at every position of a word. The encoder takes the longest,
keeps it if it may stand beside its left neighbour (checked by re-merging the two), else tries the next shorter one,
and steps back when none is left; a bitfield marks the positions from which the rest failed, so no position fails
twice. Words are independent because no vocabulary entry has the space mark behind another character.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

from pyspark.sql import DataFrame

from .bpe import Merges
from .common import map_arrow, resident

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


def word_pattern(pieces) -> re.Pattern:
    """The parts of a text that no piece joins: words, and runs of letters and of other characters where pieces allow it."""
    alpha = "".join(chr(c) for c in range(0x110000) if chr(c).isalpha())
    letters, start = "", 0
    for i in range(1, len(alpha) + 1):
        if i == len(alpha) or ord(alpha[i]) != ord(alpha[i - 1]) + 1:
            letters += f"{re.escape(alpha[start])}-{re.escape(alpha[i - 1])}"
            start = i
    bare = (p.lstrip(SPACE) for p in pieces)
    if any(a.isalpha() != b.isalpha() for p in bare for a, b in zip(p, p[1:])):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(f"{SPACE}*[{letters}]+|{SPACE}*[^{SPACE}{letters}]+|{SPACE}+")


class _Words(dict):
    """word -> ids, remembered up to a bound; the bound changes speed only."""

    LIMIT, LONGEST = 300_000, 64

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = ids
        return ids


class PieceCodec:
    """Encoder and decoder for a SentencePiece BPE model with identity normalization, a dummy prefix and byte fallback.

    The library is used to read the model file only. A model of another kind raises ValueError.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        if sp.normalize("ﬁ  a") != SPACE + "ﬁ" + SPACE * 2 + "a":
            raise ValueError("only models with identity normalization and a dummy prefix are handled")
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = {names[i]: i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(SPACE in name.lstrip(SPACE) for name in plain):
            raise ValueError("a piece with a space mark inside would join words")
        score = {name: -sp.get_score(i) for name, i in plain.items()}
        self.byte_id = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.merges = Merges(plain, lambda a, b: score.get(a + b))
        self.words = word_pattern(plain)
        # what a piece shows when decoded: None where only the bytes around it tell
        self.shown: list[str | None] = [n.replace(SPACE, " ") for n in names]
        for b, i in self.byte_id.items():
            self.shown[i] = chr(b) if b < 128 else None
        for i in range(size):
            if sp.is_control(i):
                self.shown[i] = ""
        self.shown[self.unknown] = " ⁇ "
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.digits = [str(i) for i in range(size)]
        self.known = _Words(self.encode_word)

    def encode_word(self, word: str) -> tuple[int, ...]:
        n = len(word)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, entry in self.merges.automaton.iter(word):
            at[end + 1 - entry[0]].append(entry)  # by rising end, so the longest is last
        ids: list[int] = []
        begin = 0
        for i, entries in enumerate(at):  # characters without a piece never merge: they split the word
            if not entries or entries[0][0] != 1:
                if i > begin:
                    ids += self._run(at, begin, i)
                ids += [self.byte_id.get(b, self.unknown) for b in word[i].encode("utf-8")] if self.byte_id else [self.unknown]
                begin = i + 1
        if n > begin:
            ids += self._run(at, begin, n)
        return tuple(ids)

    def _run(self, at: list[list[tuple[int, int]]], begin: int, end: int) -> list[int]:
        pairs, beside, alone = self.merges.pairs, self.merges.beside, self.merges.alone
        failed = 0  # bit p: no encoding goes on from position begin + p
        tried: list[int] = []  # the index of the entry kept at each step
        ids: list[int] = []
        pos, left = begin, -1
        entries = at[pos]
        k = len(entries) - 1
        while True:
            while k >= 0:
                length, i = entries[k]
                to = pos + length
                if to <= end and not failed >> (to - begin) & 1:
                    fits = alone(i) if left < 0 else pairs.get(left << 32 | i)
                    if fits or fits is None and beside(left, i):
                        break
                k -= 1
            if k >= 0:
                ids.append(i)
                if to == end:
                    return ids
                tried.append(k)
                pos, left, entries = to, i, at[to]
                k = len(entries) - 1
            else:
                failed |= 1 << (pos - begin)
                k = tried.pop()
                pos -= len(self.merges.names[ids.pop()])
                left = ids[-1] if ids else -1
                entries = at[pos]
                k -= 1

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text as the library gives them, without begin or end ids; null and empty texts have none."""
        if not text:
            return []
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, as the library decodes them: bytes that are no UTF-8 become U+FFFD one by one."""
        shown = self.shown
        try:
            text = "".join([shown[i] for i in ids])
        except TypeError:
            text = "".join(self._with_bytes(ids))
        return text[1:] if text[:1] == " " and ids and ids[0] not in self.byte_of and ids[0] != self.unknown else text

    def _with_bytes(self, ids: list[int]):
        run = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                width = next((w for w in (1, 2, 3, 4) if _is_char(run[:w])), 0)
                yield run[:width].decode("utf-8") if width else "�"
                del run[: width or 1]
            if i is not None:
                yield self.shown[i]


def _is_char(raw: bytearray) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def codec(path: str | None = None) -> PieceCodec:
    import public_tokenizers

    path = path or public_tokenizers.path(MODEL)
    return resident(("pieces", path), lambda: PieceCodec(path))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text; null text counts as empty, repeated rows stay."""

    def make():
        c = codec(path)

        def batch(keys, texts):
            ids = [c.encode(t) for t in texts]
            return keys, ids, [c.decode(x) for x in ids]

        return batch

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df, [id_col, text_col], make, f"{id_col} {kind}, ids array<int>, decoded string")


def digest_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """As ``encode_texts``, with the digests of the ids and of the decoded text in place of both."""

    def make():
        c = codec(path)
        digits = c.digits

        def batch(keys, texts):
            n, a, b = [], [], []
            for t in texts:
                ids = c.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            return keys, n, a, b

        return batch

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df, [id_col, text_col], make, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
