"""Word shingles of texts as sets of 64-bit names, computed over whole Arrow batches."""

from __future__ import annotations

import numpy as np

from .common import mix64
from .suffix_dedup import _names, _prefix_names

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle names of each text [offs[k], offs[k+1]).

    Words are runs of bytes other than space and \\t..\\r, with A-Z lowered. Fewer words than size: the whole
    sequence is one shingle. No words: the empty set.
    """
    base = int(offs[0])
    x = _LOWER[raw[base : int(offs[-1])]]
    n = len(offs) - 1
    ends_of = offs[1:] - base
    if len(x) == 0:
        return [np.zeros(0, np.uint64)] * n
    gap = _SPACE[x]
    word = ~gap
    border = np.zeros(len(x) + 1, bool)
    border[np.minimum(offs - base, len(x))] = True
    starts = np.flatnonzero(word & (np.concatenate([[True], gap[:-1]]) | border[:-1]))
    stops = np.flatnonzero(word & (np.concatenate([gap[1:], [True]]) | border[1:])) + 1
    names = _names(_prefix_names(x), starts, stops)
    cuts = np.searchsorted(starts, np.concatenate([[0], ends_of]))
    m = len(names)
    joined = np.zeros(max(0, m - size + 1), np.uint64)
    for k in range(size):
        joined = mix64(joined * _STEP[0] + names[k : m - size + 1 + k] + _STEP[1]) if m >= size else joined
    out = []
    for k in range(n):
        a, b = int(cuts[k]), int(cuts[k + 1])
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            v = np.array([b - a], np.uint64) * _STEP[2]
            for w in names[a:b]:
                v = mix64((v + w) * _STEP[1])
            out.append(v)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
