"""A generalised suffix automaton over tokens, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


class SuffixAutomaton:
    """The smallest automaton that accepts every substring of the sequences added to it.

    State 0 is the root. Of each state, ``step`` has its transitions, ``link`` its suffix link and
    ``length`` the longest substring that leads to it.
    """

    __slots__ = ("step", "link", "length")

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: Sequence[Hashable]) -> None:
        """Add a sequence; no substring runs over the end of a sequence."""
        step, link, length = self.step, self.link, self.length
        last = 0
        for token in sequence:
            there = step[last].get(token)
            if there is not None and length[there] == length[last] + 1:
                last = there
                continue
            if there is not None:
                last = self._split(last, there, token)
                continue
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and token not in step[at]:
                step[at][token] = new
                at = link[at]
            if at >= 0:
                there = step[at][token]
                link[new] = there if length[there] == length[at] + 1 else self._split(at, there, token)
            last = new

    def _split(self, at: int, there: int, token: Hashable) -> int:
        """The part of state `there` whose substrings also end elsewhere becomes a state of its own."""
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[there]))
        link.append(link[there])
        length.append(length[at] + 1)
        link[there] = copy
        while at >= 0 and step[at].get(token) == there:
            step[at][token] = copy
            at = link[at]
        return copy

    def matches(self, sequence: Sequence[Hashable]) -> Iterator[tuple[int, int]]:
        """Matching statistics: at each token, the longest suffix that occurs here, and its state."""
        step, link, length = self.step, self.link, self.length
        at = n = 0
        for token in sequence:
            there = step[at].get(token)
            while there is None and at:
                at = link[at]
                n = length[at]
                there = step[at].get(token)
            if there is None:
                n = 0
            else:
                at = there
                n += 1
            yield n, at

    def of_length(self, state: int, n: int) -> int:
        """The state of the suffix of n tokens, from a state reached with n tokens or more."""
        link, length = self.link, self.length
        while length[link[state]] >= n:
            state = link[state]
        return state
