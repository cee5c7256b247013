"""A suffix automaton of bounded depth over a shard of texts, as arrays: states, suffix links, and how often each ends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: What a byte is: part of a word, between words, between pieces. Bytes of characters beyond ASCII are parts of words.
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x20]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of text that are split at once.
_BLOCK = 1 << 20


def _block(letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts' bytes -> the words' letters, the words' sizes, and the number of each word's piece."""
    kind = _KIND[letters]
    inside = kind == _WORD
    new_text = np.zeros(len(letters), bool)
    new_text[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | new_text[1:]
    begins = np.flatnonzero(first)
    piece = np.cumsum((kind == _BREAK) | new_text, dtype=np.int32)[begins]
    upto = np.cumsum(inside, dtype=np.int64)
    return letters[inside], np.diff(np.append(upto[begins] - 1, upto[-1])), piece


def split(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Texts without nulls -> all their words in order, A-Z in lower case, and for each word the number of its piece: a piece ends
    with its text and at each of . , ; : ! ? and the line ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    bounds = ends[np.flatnonzero(np.diff(ends, prepend=ends[0] - 1))]  # without empty texts
    found, sizes, pieces, last, at = [], [], [], 0, 0
    while at < len(bounds) - 1:
        upto = max(int(np.searchsorted(bounds, bounds[at] + _BLOCK, "right")) - 1, at + 1)
        a, b, c = _block(_LOWER[letters[bounds[at] : bounds[upto]]], bounds[at:upto] - bounds[at])
        found.append(a)
        sizes.append(b)
        pieces.append(c + last)
        last += int(upto - at) + int(c[-1]) if len(c) else int(upto - at)
        at = upto
    if not found:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(found))), np.concatenate(pieces).astype(np.int64)


class PhraseAutomaton:
    """The generalised suffix automaton of pieces of words, cut at a depth of 3.

    A state holds the runs of words that end at the same places; they are suffixes of its longest run, down to those that are
    no longer than its suffix link's. Nodes of depth d are runs of d words, and a node's parent is the run without its first
    word. Each place of the text counts at the deepest node that ends there; links carry counts up, as in any suffix automaton.
    Where a parent ends as often as its only child, both are one state.
    """

    DEPTH = 3

    def __init__(self, words: np.ndarray, pieces: np.ndarray, n_words: int):
        """words: numbers below n_words, in order; pieces: the number of each word's piece."""
        n = len(words)
        words = words.astype(np.int64)
        # room[i]: words of the piece that end at i, 3 at most.
        second = np.zeros(n, bool)
        second[1:] = pieces[1:] == pieces[:-1]
        third = np.zeros(n, bool)
        third[2:] = second[2:] & second[1:-1]
        self.words = [np.arange(n_words, dtype=np.int64)[:, None]]
        self.counts, self.parents = [np.zeros(n_words, np.int64)], [np.zeros(n_words, np.int64)]
        node = words  # the node of the longest run so far that ends at each place
        deep = [np.ones(n, bool), second, third]
        for depth in (2, 3):
            here = np.flatnonzero(deep[depth - 1])
            # The run's first word and the node of what follows it tell the run.
            key = node[here] * n_words + words[here - depth + 1]
            known, at = np.unique(key, return_inverse=True)
            parent, first = np.divmod(known, n_words)
            self.words.append(np.concatenate([first[:, None], self.words[-1][parent]], 1))
            self.parents.append(parent)
            self.counts.append(np.zeros(len(known), np.int64))
            node = node.copy()
            node[here] = at
        depths = 1 + second.astype(np.int8) + third
        for depth in (1, 2, 3):
            self.counts[depth - 1] += np.bincount(node[depths == depth], minlength=len(self.counts[depth - 1]))
        for depth in (3, 2):  # suffix links
            self.counts[depth - 2] += np.bincount(self.parents[depth - 1], self.counts[depth - 1], len(self.counts[depth - 2])).astype(np.int64)
        self._states()

    def _states(self) -> None:
        """state[d][i]: the state of node i of depth d + 1; ends[s]: how often the runs of state s end."""
        self.state, total = [np.zeros(0, np.int64)] * 3, 0
        for d in (2, 1, 0):
            state = np.full(len(self.counts[d]), -1, np.int64)
            if d < 2:
                same = np.flatnonzero(self.counts[d + 1] == self.counts[d][self.parents[d + 1]])
                state[self.parents[d + 1][same]] = self.state[d + 1][same]
            new = np.flatnonzero(state < 0)
            state[new] = total + np.arange(len(new))
            self.state[d], total = state, total + len(new)
        self.ends = np.zeros(total, np.int64)
        for d in (0, 1, 2):
            self.ends[self.state[d]] = self.counts[d]

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All runs of so many words, as rows of words, and how often each ends, which its state knows."""
        return self.words[length - 1], self.ends[self.state[length - 1]]
