"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai common prefixes.

The order is complete; common prefixes are counted up to a stated depth, all that a search for repeats
of that length needs.
"""

from __future__ import annotations

import numpy as np

LANES = 1 << 13     # text positions that Kasai's step is applied to at once


def eight(text: np.ndarray) -> np.ndarray:
    """Big-endian number of the 8 bytes from each position (zeros after the end)."""
    t = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | t[j: j + len(text)]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes (of fewer than 2**30 bytes).

    Groups of equal prefix are refined by the group numbers h places on, h doubling; a group that
    has become single is never sorted again.
    """
    n = len(text)
    key = eight(text)
    sa = np.argsort(key)
    k = key[sa]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    group = np.empty(n + 1, np.int64)              # of each suffix: the place of its group's first member
    group[n] = -1
    group[sa] = np.repeat(first, np.diff(np.append(first, n)))
    h = 8
    single = new & np.append(new[1:], True)
    todo = np.flatnonzero(~single)                 # places in sa that lie in a group of several
    while len(todo):
        pos = sa[todo]
        # a suffix that ends within h bytes comes before what it is a beginning of, the shortest first
        nxt = np.where(pos + h < n, group[np.minimum(pos + h, n)] + h, n - pos - 1)
        # one number, sorted faster than two; places of a group stay together
        key = group[pos].astype(np.uint64) << np.uint64(32) | nxt.astype(np.uint64)
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[todo] = pos
        new = np.ones(len(todo), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        group[pos] = np.repeat(todo[first], np.diff(np.append(first, len(todo))))
        single = new & np.append(new[1:], True)
        todo = todo[~single]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each place in ``sa`` the bytes (up to ``depth``) its suffix shares with the one before.

    Kasai's rule, going through the text, begins each count at the last one less one.  It is applied to
    many stretches of the text side by side, each a lane that starts from zero.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)              # the suffix sorted before the suffix at a position
    before[sa[1:]] = sa[:-1]
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    key = np.concatenate([eight(text), np.zeros(depth + 9, np.uint64)])
    steps = -(-n // LANES)
    begin = np.arange(0, n, steps)
    h = np.zeros(len(begin), np.int64)
    for s in range(steps):
        i = begin + s
        i = i[i < n]
        h = np.maximum(h[: len(i)] - 1, 0)
        j = before[i]
        h[j < 0] = 0
        live = np.flatnonzero((j >= 0) & (h < depth))
        while len(live):
            x = key[i[live] + h[live]] ^ key[j[live] + h[live]]
            same = x == 0
            h[live] += np.where(same, 8, _leading(x))
            room = np.minimum(depth, n - np.maximum(i[live], j[live]))
            over = h[live] >= room
            h[live] = np.minimum(h[live], room)
            live = live[same & ~over]
        out[place[i]] = h
    return out


def _leading(x: np.ndarray) -> np.ndarray:
    """Number of leading zero bytes of nonzero 64-bit numbers (7 for zero)."""
    out = np.zeros(len(x), np.int64)
    for shift, add in ((32, 4), (16, 2), (8, 1)):
        zero = x >> np.uint64(64 - shift) == 0
        out += np.where(zero, add, 0)
        x = np.where(zero, x << np.uint64(shift), x)
    return out
