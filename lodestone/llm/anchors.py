"""Anchors of fixed-length windows: marks that every copy of a window carries at the same place.

A sequence's windows of length ``width`` are split into runs; the windows of a
run share one anchor, which is a function of the window's content alone. So
equal windows anywhere have equal anchors at equal distances, and windows need
comparing only where an anchor's name occurs twice.
"""

from __future__ import annotations

import numpy as np

from lodestone.llm._common import U64, splitmix


def runs(at: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each maximal stretch in which all arrays are constant."""
    change = np.zeros(len(at), dtype=bool)
    change[:1] = True
    for a in (at, *more):
        change[1:] |= a[1:] != a[:-1]
    first = np.flatnonzero(change)
    return first, np.append(first[1:], len(at)) - 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for each i that has all of them, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def minimum_anchors(gram: np.ndarray, span: int) -> np.ndarray:
    """For each window, the place of its smallest gram, the leftmost at a tie.

    gram[i] names what starts at i; a window starting at s has the grams
    s to s + span - 1. At most 2**24 grams.
    """
    order = (splitmix(gram) & ~U64(0xFFFFFF)) | np.arange(len(gram), dtype=U64)
    return (sliding_min(order, span) & U64(0xFFFFFF)).astype(np.int64)


class Level:
    """Symbols of one recompression level: names, and for each the stretch of level-0
    symbols it stands for and the stretch that decides it."""

    __slots__ = ("name", "low", "high", "from_", "to")

    def __init__(self, name, low, high, from_, to):
        self.name, self.low, self.high, self.from_, self.to = name, low, high, from_, to


def first_level(codes: np.ndarray) -> Level:
    i = np.arange(len(codes), dtype=np.int64)
    return Level(codes, i, i + 1, i, i + 1)


def _beside(x: Level, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Deciding stretches of the symbols before (-1) or after (1) those at ``at``; endless where there is none."""
    i = at + step
    real = (i >= 0) & (i < len(x.name))
    i = np.clip(i, 0, len(x.name) - 1)
    return np.where(real, x.from_[i], -1), np.where(real, x.to[i], np.iinfo(np.int64).max // 2)


def run_round(x: Level, codes: np.ndarray, breaks: np.ndarray) -> Level:
    """Each maximal run of one symbol becomes a symbol named by it and its length.

    What stands beside a run decides its extent: the next word, if that already
    tells the neighbour from the run's symbol, else the whole neighbour.
    breaks: level-0 places where a text begins.
    """
    n, words = len(x.name), len(codes)
    if not n:
        return x
    same = np.zeros(n, dtype=bool)
    same[1:] = (x.name[1:] == x.name[:-1]) & ~breaks[x.low[1:]]
    first = np.flatnonzero(~same)
    last = np.append(first[1:], n) - 1
    count = last - first + 1
    many = count > 1
    name = x.name[first].copy()
    name[many] = splitmix(name[many] ^ (count[many].astype(U64) * U64(0xA24BAED4963EE407)))
    low, high = x.low[first], x.high[last]
    from_, to = np.minimum(x.from_[first], low - 1), np.maximum(x.to[last], high + 1)
    like = codes[np.maximum(low - 1, 0)] == codes[high - 1]
    f, t = _beside(x, first[like], -1)
    from_[like], to[like] = np.minimum(from_[like], f), np.maximum(to[like], t)
    like = codes[np.minimum(high, words - 1)] == codes[low]
    f, t = _beside(x, last[like], 1)
    from_[like], to[like] = np.minimum(from_[like], f), np.maximum(to[like], t)
    return Level(name, low, high, from_, to)


def pair_round(x: Level, breaks: np.ndarray, salt: int) -> Level:
    """Symbols are dealt to two sides by name; each left one before a right one forms a pair with it.

    No symbol can be in two pairs, so a pair is decided by its own two symbols. One
    that stays alone is decided by its neighbour on the side where a partner could be.
    """
    n = len(x.name)
    if n < 2:
        return x
    side = (splitmix(x.name + U64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(63)).astype(bool)
    pair = np.zeros(n, dtype=bool)  # at the left one
    pair[:-1] = ~side[:-1] & side[1:] & ~breaks[x.low[1:]]
    second = np.zeros(n, dtype=bool)
    second[1:] = pair[:-1]
    keep = np.flatnonzero(~second)
    p = pair[keep]
    at, after = keep[p], keep[p] + 1
    name = x.name[keep].copy()
    name[p] = splitmix(x.name[at] * U64(0xD1342543DE82EF95) + splitmix(x.name[after] + U64(salt)))
    high, from_, to = x.high[keep].copy(), x.from_[keep].copy(), x.to[keep].copy()
    high[p], to[p] = x.high[after], np.maximum(x.to[after], to[p])
    from_[p] = np.minimum(from_[p], x.from_[after])
    for rows, step in ((np.flatnonzero(~p & ~side[keep]), 1), (np.flatnonzero(~p & side[keep]), -1)):
        f, t = _beside(x, keep[rows], step)
        from_[rows], to[rows] = np.minimum(from_[rows], f), np.maximum(to[rows], t)
    return Level(name, x.low[keep], high, from_, to)


def recompression_anchors(codes: np.ndarray, breaks: np.ndarray, width: int, rounds: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, name) of the anchor of each window that starts at ``starts``.

    After the rounds, two neighbouring symbols make a gram; of the grams decided
    inside a window, the one of the smallest name is its anchor, the leftmost at
    a tie. place -1: no gram is; such a window is its own anchor.
    """
    n = len(codes)
    x = first_level(codes)
    for r in range(rounds):
        x = pair_round(run_round(x, codes, breaks), breaks, r + 1)
    if len(x.name) < 2 or not len(starts):
        return np.full(len(starts), -1, dtype=np.int64), np.zeros(len(starts), dtype=U64)
    name = splitmix(x.name[:-1] * U64(0x9FB21C651E98DF25) + splitmix(x.name[1:]))
    low, from_, to = x.low[:-1], np.minimum(x.from_[:-1], x.from_[1:]), np.maximum(x.to[:-1], x.to[1:])
    first, last = np.maximum(to - width, 0), np.minimum(from_, n - 1)  # windows it lies in
    good = (first <= last) & ~breaks[x.low[1:]]
    value = (name & ~U64(0xFFFFFF)) | low.astype(U64)
    best = interval_min(first[good], last[good], value[good], n)[starts]
    none = best == U64(0xFFFFFFFFFFFFFFFF)
    place = np.where(none, -1, (best & U64(0xFFFFFF)).astype(np.int64))
    name_at = np.zeros(n, dtype=U64)
    name_at[low] = name
    return place, name_at[place]


def interval_min(first: np.ndarray, last: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """At each of n places, the least value of the intervals [first, last] over it (else all ones)."""
    none = U64(0xFFFFFFFFFFFFFFFF)
    if not len(first):
        return np.full(n, none, dtype=U64)
    size = np.frexp((last - first + 1).astype(np.float64))[1] - 1  # floor of log2
    above = np.full(n, none, dtype=U64)
    for k in range(int(size.max()), -1, -1):
        here = above  # of blocks of 2 ** k from each place on
        at = size == k
        np.minimum.at(here, first[at], value[at])
        np.minimum.at(here, last[at] - (1 << k) + 1, value[at])
        if k:
            half = 1 << (k - 1)
            above = here.copy()
            above[half:] = np.minimum(above[half:], here[:-half])
    return above
