"""Byte-pair merging by adjacency: vocabulary matches, a re-merging check of neighbours, and memory of both.

A sequence of tokens is the result of greedy merging exactly if every token re-merges to itself and every two
neighbours re-merge to themselves: the first merge that crosses a boundary in the whole text is also the first that
crosses it when only the two tokens beside it are merged, since greedy merging picks by (rank, position) and tokens
without a crossing merge do not see each other. Both encoders below rest on that.
"""

from __future__ import annotations

import ahocorasick


class Merges:
    """A vocabulary of strings with the rank of each merge.

    ``rank(a, b)`` is a number (lower merges first, ties go left) or None. ``singles`` are the strings that text is
    first split into; every other token is reachable only by merges.
    """

    MEMO = 1_000_000

    def __init__(self, tokens: dict[str, int], rank):
        self.ids = tokens
        self.rank = rank
        self.automaton = ahocorasick.Automaton()
        for token, i in tokens.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.names = {i: token for token, i in tokens.items()}
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self._alone: dict[int, bool] = {}

    def remerge(self, text: str) -> list[str]:
        """Greedy merging of a short text, one best pair at a time."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, token: int) -> bool:
        """Whether the token re-merges to itself."""
        known = self._alone.get(token)
        if known is None:
            name = self.names[token]
            known = self._alone[token] = self.remerge(name) == [name]
        return known

    def beside(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are next to each other."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= self.MEMO:
                self.pairs.clear()
            a, b = self.names[left], self.names[right]
            known = self.pairs[left << 32 | right] = self.remerge(a + b) == [a, b]
        return known
