"""A suffix automaton over words, grown one passage at a time, and matching statistics against it."""

from __future__ import annotations


class SuffixAutomaton:
    """Accepts every run of words of the passages added so far."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, source: int, word: bytes, target: int) -> int:
        """A copy of target that is reached from source by one word exactly."""
        copy = self._state(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        at = source
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another passage has been here
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest run of words, ending there, that some passage has."""
        at = length = 0
        out = []
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            if word in self.next[at]:
                at = self.next[at][word]
                length += 1
            else:
                length = 0
            out.append(length)
        return out
