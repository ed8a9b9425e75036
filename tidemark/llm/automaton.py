"""A generalised suffix automaton: one minimal machine for the substrings of many sequences."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """States are numbered from 0 (the root). A state stands for substrings that end at the same places; `length` is its longest one's."""

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: Hashable, q: int) -> int:
        """The part of q that p reaches by c, as a state of its own."""
        part = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = part
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = part
            p = self.link[p]
        return part

    def add(self, sequence: Iterable[Hashable]) -> list[int]:
        """Takes in a sequence; returns the state of each of its prefixes at that moment (later additions may split them; see `find`)."""
        at, path = 0, []
        for c in sequence:
            q = self.step[at].get(c)
            if q is not None:
                at = q if self.length[q] == self.length[at] + 1 else self._split(at, c, q)
            else:
                new, p = self._state(self.length[at] + 1, 0, {}), at
                while p >= 0 and c not in self.step[p]:
                    self.step[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                at = new
            path.append(at)
        return path

    def find(self, sequence: Iterable[Hashable]) -> int:
        """The state of a substring, or -1."""
        at = 0
        for c in sequence:
            at = self.step[at].get(c, -1)
            if at < 0:
                break
        return at

    def prefixes(self, sequence: Iterable[Hashable]) -> list[int]:
        """The states of the prefixes of a sequence that was added."""
        at, out = 0, []
        for c in sequence:
            at = self.step[at][c]
            out.append(at)
        return out
