"""Suffix automata over sequences of word numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of the added sequences: state 0 is the empty one; each state has its longest length, its suffix link and its transitions."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _clone(self, p: int, symbol: int, q: int) -> int:
        """The part of q that p reaches in one step, as a state of its own."""
        new = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = new
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = new
            p = self.link[p]
        return new

    def add(self, sequence: Iterable[int]) -> None:
        length, link, edges = self.length, self.link, self.next
        last = 0
        for c in sequence:
            q = edges[last].get(c)
            if q is not None:  # an earlier sequence had this far
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def statistics(self, sequence: Sequence[int]) -> list[int]:
        """Matching statistics: for each place, the length of the longest substring of the reference that ends there."""
        length, link, edges = self.length, self.link, self.next
        out, state, have = [], 0, 0
        for c in sequence:
            while state and c not in edges[state]:
                state = link[state]
                have = length[state]
            q = edges[state].get(c)
            if q is not None:
                state, have = q, have + 1
            else:
                have = 0
            out.append(have)
        return out


def spans_above(statistics: Sequence[int], threshold: int) -> list[tuple[int, int]]:
    """Maximal spans [start, end) covered by matches of at least the threshold, judged by windows of exactly that length."""
    out: list[tuple[int, int]] = []
    for end, have in enumerate(statistics, 1):
        if have >= threshold:
            if out and end - threshold <= out[-1][1]:
                out[-1] = out[-1][0], end
            else:
                out.append((end - threshold, end))
    return out
