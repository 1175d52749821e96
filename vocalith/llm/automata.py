"""A generalised suffix automaton over sequences of integers."""

from __future__ import annotations


class SuffixAutomaton:
    """Accepts every substring of every added sequence. State 0 is the root.

    `length[s]` is the longest string of state s, `link[s]` its suffix link, `step[s]` its transitions;
    a state also holds the strings down to length[link[s]] + 1.
    """

    def __init__(self) -> None:
        self.length, self.link, self.step = [0], [-1], [{}]

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings up to length[p] + 1."""
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.step.append(dict(self.step[q]))
        self.link[q] = new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.step.append({})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence) -> list[int]:
        """The states of the sequence's prefixes; a later `add` may split them, so use `walk` for final ones."""
        last, states = 0, []
        for c in sequence:
            last = self._extend(last, c)
            states.append(last)
        return states

    def by_length(self) -> list[int]:
        return sorted(range(1, len(self.length)), key=self.length.__getitem__)

    def matching(self, sequence):
        """(state, matching length) after each symbol: the longest suffix read so far that is a substring of an added sequence."""
        step, link, length = self.step, self.link, self.length
        s = n = 0
        for c in sequence:
            t = step[s].get(c)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = step[s].get(c)
            if t is not None:
                s, n = t, n + 1
            yield s, n
