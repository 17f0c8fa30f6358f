"""Locally consistent parsing by recompression, with symbols named by hashes.

Round by round, runs of one symbol and pairs of symbols get a name.  A name is a 64-bit hash of what
it stands for, so every task gives equal substrings equal names without a table of names.  Which
pairs are named is decided by one bit of each symbol's hash (a left and a right alphabet, drawn anew
each round): the pair (left, right) always merges.  Runs longer than ``RUN_WORDS`` words stay as they are.

For every symbol the words are kept on which its being there depends: for a pair both parts, for a symbol
that stayed alone also the neighbour that could have joined it, for a run the symbols on its two
sides.  If these lie inside a window of words, the same symbol stands at the same place in every equal
window.  The anchor of a window is the symbol of the highest round whose words of dependence lie inside
it, the longest among several, then the smallest by hash; words themselves are round 0, so every window has one.
"""

from __future__ import annotations

import numpy as np

from pressroom.llm.common import U64, mix

RUN_WORDS = 16
#: Steps in order: "r" names runs, "p" names pairs.
STEPS = "rpprpppp"
_LEFT, _RUN = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


class Level:
    """Symbols in order: name, first word, words of dependence [low, high); separators stay apart."""

    def __init__(self, name, at, size, low, high, sep):
        self.name, self.at, self.size, self.low, self.high, self.sep = name, at, size, low, high, sep

    def runs(self) -> Level:
        n = len(self.name)
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | self.sep[1:] | self.sep[:-1]
        s = np.flatnonzero(new)
        e = np.append(s[1:], n)
        k = e - s
        most = np.maximum(RUN_WORDS // np.maximum(self.size[s], 1), 1)       # longest run that is named
        whole = k <= most
        # over-long runs stay single symbols
        keep = np.repeat(~whole, k)
        keep[s] = True
        pos = np.flatnonzero(keep)
        g = np.cumsum(new)[pos] - 1                                           # the run of each symbol left
        one = whole[g]
        first, last = np.maximum(s[g] - 1, 0), np.minimum(e[g], n - 1)
        low_at = np.where(one, first, np.maximum(first, pos - most[g]))
        high_at = np.where(one, last, np.minimum(last, pos + most[g]))
        count = np.where(one, k[g], 1)
        with np.errstate(over="ignore"):
            named = np.where(count > 1, mix(self.name[pos] ^ (count.astype(U64) * _RUN)), self.name[pos])
        sep = self.sep[pos]
        low, high = self.low[low_at], self.high[high_at]
        low[sep], high[sep] = self.low[pos][sep], self.high[pos][sep]
        return Level(named, self.at[pos], self.size[pos] * count, low, high, sep)

    def pairs(self, r: int) -> Level:
        n = len(self.name)
        salt = U64((2 * r + 1) * int(_LEFT) % (1 << 64))
        right = (mix(self.name + salt) >> U64(17)) & U64(1) == 1
        left = ~right & ~self.sep
        right &= ~self.sep
        joins = np.zeros(n, bool)
        joins[:-1] = left[:-1] & right[1:]
        second = np.zeros(n, bool)
        second[1:] = joins[:-1]
        pos = np.flatnonzero(~second)
        j = joins[pos]
        nxt, prv = np.minimum(pos + 1, n - 1), np.maximum(pos - 1, 0)
        with np.errstate(over="ignore"):
            named = np.where(j, mix(self.name[pos] + mix(self.name[nxt] ^ (salt + _RUN))), self.name[pos])
        sep = self.sep[pos]
        low = np.where(right[pos], self.low[prv], self.low[pos])              # alone and right: the symbol before
        high = np.where(sep, self.high[pos], np.where(left[pos], self.high[nxt], self.high[pos]))
        return Level(named, self.at[pos], self.size[pos] + np.where(j, self.size[nxt], 0), low, high, sep)


def levels(names: np.ndarray, sep: np.ndarray) -> list[Level]:
    at = np.arange(len(names))
    lv = [Level(names, at, np.ones(len(names), np.int64), at, at + 1, sep)]
    for r, step in enumerate(STEPS):
        lv.append(lv[-1].runs() if step == "r" else lv[-1].pairs(r))
    return lv


def anchors(names: np.ndarray, sep: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window [i, i + size) of ``starts`` (increasing, without separators inside): the
    anchor's round, name and first word."""
    n = len(starts)
    rnd = np.full(n, -1, np.int64)
    name, at = np.zeros(n, U64), np.zeros(n, np.int64)
    lv = levels(names, sep)
    todo = np.arange(n)
    for r in range(len(lv) - 1, -1, -1):
        if not len(todo):
            break
        x = lv[r]
        i = starts[todo]
        f = np.searchsorted(x.low, i, "left")
        last = np.searchsorted(x.high, i + size, "right") - 1
        ok = f <= last
        got, f, last = todo[ok], f[ok], last[ok]
        todo = todo[~ok]
        if not len(got):
            continue
        # the longest symbol, then the smallest hash: long symbols are shared by few documents
        key = ((U64(255) - np.minimum(x.size, 255).astype(U64)) << U64(56)) | (mix(x.name) >> U64(8))
        best = np.arange(len(key))
        width = last - f + 1
        depth = np.frexp(width.astype(float))[1] - 1                           # floor(log2(width))
        pick = np.empty(len(got), np.int64)
        for d in range(int(depth.max()) + 1):
            m = depth == d
            a, b = best[f[m]], best[last[m] - (1 << d) + 1]
            pick[m] = np.where(key[a] <= key[b], a, b)
            if d < depth.max():
                a, b = best[: -(1 << d)], best[1 << d:]
                best = np.where(key[a] <= key[b], a, b)
        rnd[got], name[got], at[got] = r, x.name[pick], x.at[pick]
    return rnd, name, at
