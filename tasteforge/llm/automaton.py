"""A suffix automaton over several word sequences, with the least document of each state."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """States stand for sets of runs that end at the same places; ``first`` is the least document among those places."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list[int | None] = [None]

    def _state(self, length: int, moves: dict, link: int, first: int | None) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, source: int, word: Hashable, target: int) -> int:
        """A state for the shorter runs of ``target``, which end in more places than its longer ones."""
        short = self._state(self.length[source] + 1, dict(self.next[target]), self.link[target], self.first[target])
        self.link[target] = short
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = short
            source = self.link[source]
        return short

    def add(self, words: Iterable[Hashable], document: int) -> None:
        last = 0
        for word in words:
            target = self.next[last].get(word)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
            else:
                new = self._state(self.length[last] + 1, {}, 0, None)
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    target = self.next[at][word]
                    self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
                last = new
            if self.first[last] is None or document < self.first[last]:
                self.first[last] = document

    def close(self) -> None:
        """Hand the least documents on to the shorter runs; to be called when all is added."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[state], self.first[state]
            if own is not None and (self.first[up] is None or own < self.first[up]):
                self.first[up] = own

    def matches(self, words: Sequence[Hashable], at_least: int) -> list[int | None]:
        """For each word, the least document with the ``at_least`` words that end there; None if none has them."""
        out: list[int | None] = []
        state, size = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            if size < at_least:
                out.append(None)
                continue
            while self.length[self.link[state]] >= at_least:
                state = self.link[state]
                size = self.length[state]
            out.append(self.first[state])
        return out
