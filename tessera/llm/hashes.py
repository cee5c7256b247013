"""64-bit hashes of words and of runs of words, for whole texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RATE = np.uint64(0x9E3779B97F4A7C15)
#: Words hashed at once.
_BLOCK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _RATE)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.append(np.ones(1, np.uint64), np.full(2 * n, _RATE)), dtype=np.uint64)
    return _powers


def _hashes(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    out = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(_BYTE[letters] * _power(int(sizes.max()))[place], starts[some])
    return mixed(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, by sums over all the words' bytes at once."""
    out = np.empty(len(words), np.uint64)
    for i in range(0, len(words), _BLOCK):
        part = words[i : i + _BLOCK]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        out[i : i + _BLOCK] = _hashes(np.frombuffer(b"".join(part), np.uint8), np.cumsum(sizes) - sizes, sizes)
    return out


def column_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """The same of an Arrow column, without its words as objects."""
    out = np.empty(len(words), np.uint64)
    for i in range(0, len(words), _BLOCK):
        part = words.slice(i, _BLOCK)
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        letters = np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        out[i : i + _BLOCK] = _hashes(letters, ends[:-1] - ends[0], np.diff(ends))
    return out


def run_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, from the words' hashes."""
    out = np.zeros(len(hashed) - n + 1, np.uint64)
    for k in range(n):
        out = out * _RATE + hashed[k : k + len(out)]
    return mixed(out)
