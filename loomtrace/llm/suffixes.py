"""Suffix arrays by induced sorting, on numpy arrays.

Suffixes are classed as smaller or larger than their successor. Leftmost-smaller (LMS) substrings are sorted by one
round of induction and named; if names repeat, the string of names is sorted by the same function. Induction from the
sorted LMS suffixes then places all others, in time linear in the string.

Induction scans an array while filling it ahead of the scan. Everything filled up to the next empty slot is scanned in
one step, as what it induces always lies further on.
"""

from __future__ import annotations

import numpy as np


def _counted(c: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value how many equal ones come before it; the distinct values and their counts."""
    if c.size == 1:
        return np.zeros(1, np.int64), c, np.ones(1, np.int64)
    order = np.argsort(c.astype(np.uint16) if sigma <= 1 << 16 else c, kind="stable")  # short keys sort by radix
    sorted_ = c[order]
    starts = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1))
    counts = np.diff(np.concatenate((starts, [c.size])))
    before = np.empty(c.size, np.int64)
    before[order] = np.arange(c.size) - np.repeat(starts, counts)
    return before, sorted_[starts], counts


def _hole_after(a: np.ndarray, p: int) -> int:
    """The first empty slot from ``p`` on."""
    step = 256
    while p < a.size:
        empty = a[p : p + step] < 0
        k = int(empty.argmax())
        if empty[k]:
            return p + k
        p += step
        step *= 2
    return a.size


def _hole_before(a: np.ndarray, p: int) -> int:
    """The end of the last empty slot before ``p``."""
    step = 256
    while p > 0:
        empty = a[max(0, p - step) : p][::-1] < 0
        k = int(empty.argmax())
        if empty[k]:
            return p - k
        p -= step
        step *= 2
    return 0


class _Sorter:
    def __init__(self, t: np.ndarray, sigma: int):
        self.t, self.n = t, t.size
        d = np.diff(t)
        turns = np.flatnonzero(d)
        self.smaller = np.ones(self.n, bool)
        self.smaller[:-1] = np.repeat(d[turns] > 0, np.diff(np.concatenate(([-1], turns))))
        self.lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1
        self.is_lms = np.zeros(self.n, bool)
        self.is_lms[self.lms] = True
        self.larger_count = np.bincount(t[~self.smaller], minlength=sigma)
        self.end = np.cumsum(np.bincount(t, minlength=sigma))
        self.sigma = sigma

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes, induced from LMS positions in the order of their suffixes (or of their first symbols)."""
        t, smaller = self.t, self.smaller
        first = t[seeds]
        seed_count = np.bincount(first, minlength=self.sigma)
        room = self.larger_count + seed_count
        base = np.cumsum(room) - room
        a = np.full(int(room.sum()), -1, np.int64)
        a[base[first] + self.larger_count[first] + np.arange(seeds.size) - (np.cumsum(seed_count) - seed_count)[first]] = seeds
        head = base.copy()
        p = 0
        while p < a.size:
            q = _hole_after(a, p)
            j = a[p:q] - 1
            j = j[j >= 0]
            j = j[~smaller[j]]
            if j.size:
                before, values, counts = _counted(t[j], self.sigma)
                a[head[t[j]] + before] = j
                head[values] += counts
            p = q
        f = np.full(self.n, -1, np.int64)
        placed = a[~smaller[a]]
        c = t[placed]
        f[(self.end - np.bincount(t, minlength=self.sigma))[c] + np.arange(placed.size) - (np.cumsum(self.larger_count) - self.larger_count)[c]] = placed
        f[0] = self.n - 1
        tail = self.end.copy()
        p = self.n
        while p > 0:
            q = _hole_before(f, p)
            j = f[q:p][::-1] - 1
            j = j[j >= 0]
            j = j[smaller[j]]
            if j.size:
                before, values, counts = _counted(t[j], self.sigma)
                f[tail[t[j]] - 1 - before] = j
                tail[values] -= counts
            p = q
        return f

    def names(self, order: np.ndarray) -> np.ndarray:
        """A name for each LMS substring, in text order, equal for equal substrings; ``order`` has them sorted."""
        length = np.ones(self.n, np.int64)
        length[self.lms[:-1]] = np.diff(self.lms) + 1
        a, b = order[:-1], order[1:]
        differs = length[a] != length[b]
        left = np.flatnonzero(~differs)
        k = 0
        while left.size:
            unlike = self.t[a[left] + k] != self.t[b[left] + k]
            differs[left[unlike]] = True
            k += 1
            left = left[~unlike]
            left = left[length[a[left]] > k]
        name = np.empty(self.n, np.int64)
        name[order] = np.concatenate(([0], np.cumsum(differs)))
        return name[self.lms]


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes of ``t``, symbols 0 to sigma - 1, whose last symbol is 0 and occurs nowhere else."""
    if t.size < 3:
        return np.arange(t.size)[::-1].copy()
    s = _Sorter(t.astype(np.int64), sigma)
    order = s.induce(s.lms[np.argsort(s.t[s.lms].astype(np.uint16) if sigma <= 1 << 16 else s.t[s.lms], kind="stable")])
    order = order[s.is_lms[order]]
    names = s.names(order)
    if names.max() + 1 < names.size:
        order = s.lms[suffix_array(names, int(names.max()) + 1)]
    return s.induce(order)


def common_prefixes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Lengths, up to ``limit``, of the common prefixes at places ``a`` and ``b`` of bytes padded by 8 at least."""
    words = np.lib.stride_tricks.as_strided(raw.view(np.uint8), (raw.size - 7, 8), (1, 1))
    out = np.full(a.size, limit, np.int64)
    left = np.arange(a.size)
    for k in range(0, limit, 8):
        x = np.ascontiguousarray(words[a[left] + k]).view(np.uint64).ravel() ^ np.ascontiguousarray(words[b[left] + k]).view(np.uint64).ravel()
        unlike = x != 0
        lowest = x[unlike] & (~x[unlike] + np.uint64(1))
        out[left[unlike]] = np.minimum(limit, k + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
        left = left[~unlike]
        if not left.size:
            break
    return out


def repeated_windows(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of bytes that lie within one piece, and a class for each: equal windows share a class.

    ``raw`` has pieces at ``starts`` with ``lengths``, parted by one byte each, and ends in 8 bytes or more of padding.
    Places are in the order of their suffixes, so a class is a run.
    """
    n = int(starts[-1] + lengths[-1] + 1) if starts.size else 0
    t = np.empty(n, np.int64)
    t[:] = raw[:n].astype(np.int64) + 2
    t[starts + lengths] = 1
    t[n - 1] = 0
    left = np.zeros(n, np.int64)  # bytes from a place to its piece's end
    ends = np.repeat(starts + lengths, lengths + 1)
    left[:] = ends - np.arange(n)
    order = suffix_array(t, 258)
    whole = left >= window
    # Permuted common prefixes: each place against the one before it in suffix order.
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    places = np.flatnonzero(whole & (previous >= 0))
    places = places[whole[previous[places]]]
    permuted = np.zeros(n, np.int64)
    permuted[places] = common_prefixes(raw, places, previous[places], window)
    kept = order[whole[order]]
    return kept, np.cumsum(permuted[kept] < window) - 1
