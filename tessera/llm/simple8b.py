"""Simple-8b: a 64-bit word holds a 4-bit selector and as many ids as fit at the selector's width.

Selector 0 is the escape: the next word is one raw value of 60 bits or more. Ids are coded in blocks of `block_ids`; each
block begins with a new word and `offsets` says which, so that blocks can be decoded alone. Coding and decoding work on
all words of a selector at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_IDS = 4096
#: Ids in a word by selector 1 to 14; the width is 60 // count. Fixed values of the coding.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_COUNT = np.array([0, *COUNTS, 0], np.int64)


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """ids -> (words as uint64, offsets: the first word of each block, then their number)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    at = np.arange(n, dtype=np.int32)
    left = np.minimum(block_ids - at % block_ids, n - at)
    selector = np.zeros(n, np.int8)
    top = ids.astype(np.uint32) if int(ids.max()) < 1 << 32 else ids
    before = 1
    for s in range(len(COUNTS), 0, -1):  # fewest ids first, so that the most win
        count = COUNTS[s - 1]
        if count > n:
            break
        if count > before:  # the largest of each run of `count` ids, by two runs that overlap
            top = np.maximum(top[: n - count + 1], top[count - before :])
            before = count
        fits = top >> top.dtype.type(60 // count) == 0 if 60 // count < 8 * top.itemsize else np.ones(len(top), bool)
        if not fits.any():
            break  # longer runs of narrower ids are rarer still
        selector[: len(fits)][fits & (left[: len(fits)] >= count)] = s
    selector = selector.astype(np.int64)
    step = np.maximum(_COUNT[selector], 1).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    chosen = selector[starts]
    place = np.cumsum(np.where(chosen == 0, 2, 1))
    words = np.zeros(int(place[-1]), np.uint64)
    place -= np.where(chosen == 0, 2, 1)
    for s in np.unique(chosen).tolist():
        own = chosen == s
        if s == 0:
            words[place[own] + 1] = ids[starts[own]]
            continue
        count = COUNTS[s - 1]
        width = np.uint64(60 // count)
        packed = np.full(int(own.sum()), s << 60, np.uint64)
        for k in range(count):
            packed |= ids[starts[own] + k] << (np.uint64(k) * width)
        words[place[own]] = packed
    firsts = place[starts % block_ids == 0]
    return words, np.append(firsts, len(words))


def decode_blocks(words: np.ndarray, offsets: np.ndarray, at_once: int = 32) -> Iterator[np.ndarray]:
    """The ids of `at_once` blocks after the other, found by their offsets: memory is bounded however many there are."""
    for first in range(0, len(offsets) - 1, at_once):
        yield decode(words[offsets[first] : offsets[min(first + at_once, len(offsets) - 1)]])


def decode(words: np.ndarray) -> np.ndarray:
    """Words of one or more whole blocks -> ids as uint64."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(selector == 0)
    if len(escapes):  # a raw word may look like an escape itself, so they are walked in order
        last = -1
        for e in escapes.tolist():
            if e != last:
                raw[e + 1] = True
                last = e + 1
    counts = np.where(raw, 1, _COUNT[np.where(raw, 0, selector)])
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - counts
    out[begins[raw]] = words[raw]
    for s in np.unique(selector[~raw]).tolist():
        if s == 0:
            continue
        own = (selector == s) & ~raw
        count = COUNTS[s - 1]
        width = 60 // count
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[begins[own] + k] = (words[own] >> np.uint64(k * width)) & mask
    return out
