"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the next one. Leftmost S
suffixes start the substrings that reach to the next leftmost S suffix. Those substrings
are sorted by inducing from their buckets, and the string of their names is sorted: by the
same function while there are few names, else by names of two, four, eight ... names in a
row, of only those that are not told apart yet (many names would need as many buckets).
From the sorted leftmost S suffixes a scan of the buckets upwards induces the L suffixes,
and a scan downwards the S suffixes.

A scan is linear: each suffix is looked at once and appended to the bucket of the symbol
before it. It goes bucket by bucket; what a bucket appends to itself is the next wave, so
a step handles a whole wave. Memory is some forty bytes for each symbol.
"""

from __future__ import annotations

import numpy as np

#: Names up to which their string is sorted by induction too.
FEW_NAMES = 256


def _is_smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not."""
    n = len(t)
    change = np.where(t[1:] != t[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n))
    decided = np.minimum.accumulate(change[::-1])[::-1]  # where the run of equal symbols ends
    rises = np.append(t[:-1] < t[1:], False)
    out = np.zeros(n, dtype=bool)
    inside = decided < n
    out[:-1][inside] = rises[decided[inside]]
    return out


class _Buckets:
    """The scans of one text."""

    def __init__(self, t: np.ndarray, symbols: int):
        self.t, self.symbols = t, symbols
        self.is_s = is_s = _is_smaller(t)
        total = np.bincount(t, minlength=symbols)
        self.head = np.concatenate(([0], np.cumsum(total)))
        self.l_end = self.head[:-1] + np.bincount(t[~is_s], minlength=symbols)
        self.used = np.flatnonzero(total)
        # the symbol before each place if the suffix there is L (S), else a number that no symbol has
        none, before = np.uint16(symbols), np.concatenate((t[:1], t[:-1])).astype(np.uint16)
        s_before = np.concatenate((is_s[:1], is_s[:-1]))
        self.before_l, self.before_s = np.where(s_before, none, before), np.where(s_before, before, none)
        self.before_l[0] = self.before_s[0] = none
        self.leftmost = np.flatnonzero(is_s & np.concatenate(([False], ~is_s[:-1]))).astype(np.int32)

    def _append(self, sa: np.ndarray, scanned: np.ndarray, before: np.ndarray, free: np.ndarray, sign: int) -> None:
        """Append what stands before the scanned suffixes, in their order, to its buckets; sign: the side that buckets grow to."""
        symbol = before[scanned]
        own = np.flatnonzero(symbol < self.symbols)
        if not len(own):
            return
        symbol = symbol[own]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        start = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
        size = np.diff(np.append(start, len(symbol)))
        which = symbol[start]
        first = free[which] if sign > 0 else free[which] - 1
        at = np.repeat(first - sign * start, size) + sign * np.arange(len(symbol))
        sa[at] = scanned[own[order]] - 1
        free[which] += sign * size

    def induce(self, leftmost: np.ndarray) -> np.ndarray:
        """The suffix array that follows from the order of the leftmost S suffixes (of one bucket: as given)."""
        sa = np.empty(len(self.t), dtype=np.int32)
        symbol = self.t[leftmost]
        cut = np.searchsorted(symbol, np.arange(self.symbols + 1))
        free = self.head[:-1].copy()
        last = int(self.t[-1])
        sa[free[last]] = len(self.t) - 1  # stands before the empty suffix
        free[last] += 1
        for c in self.used:
            lo = self.head[c]
            while lo < free[c]:
                lo, scanned = free[c], sa[lo : free[c]]
                self._append(sa, scanned, self.before_l, free, 1)
            if cut[c] < cut[c + 1]:
                self._append(sa, leftmost[cut[c] : cut[c + 1]], self.before_l, free, 1)
        free = self.head[1:].copy()
        for c in self.used[::-1]:
            hi = self.head[c + 1]
            while free[c] < hi:
                hi, scanned = free[c], sa[free[c] : hi][::-1]
                self._append(sa, scanned, self.before_s, free, -1)
            if self.head[c] < self.l_end[c]:
                self._append(sa, sa[self.head[c] : self.l_end[c]][::-1], self.before_s, free, -1)
        return sa


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of t on, zeros beyond its end."""
    padded = np.concatenate((np.ascontiguousarray(t).view(np.uint8), np.zeros(16, dtype=np.uint8)))
    return np.ndarray(shape=(len(padded) - 8,), dtype="<u8", buffer=padded, strides=(1,))


def _names(t: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Names, from 0, of the sorted substrings that start at ``ordered``; equal ones alike."""
    n, width = len(t), t.itemsize
    end = np.zeros(n, dtype=np.int32)
    end[leftmost[:-1]] = leftmost[1:]
    size = (end[ordered] - ordered + 1).astype(np.int64) * width  # the next leftmost one's symbol belongs to it
    a, b = ordered[:-1].astype(np.int64) * width, ordered[1:].astype(np.int64) * width
    # the last substring runs to the end of the text and equals no other
    same = (size[:-1] == size[1:]) & (ordered[:-1] != leftmost[-1]) & (ordered[1:] != leftmost[-1])
    words, live, depth = _words(t), np.flatnonzero(same), 0
    while len(live):
        apart = words[a[live] + depth] ^ words[b[live] + depth]
        left = size[live] - depth
        apart &= np.where(left < 8, (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        same[live[apart != 0]] = False
        live = live[(apart == 0) & (left > 8)]
        depth += 8
    return np.concatenate(([0], np.cumsum(~same)))


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a string of names in order."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    new = np.concatenate(([True], names[order[1:]] != names[order[:-1]]))
    rank = np.empty(m + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0)) + 1
    rank[m] = 0  # the end
    alike = ~(new & np.append(new[1:], True))
    left, ahead = order[alike], 1
    while len(left):
        # suffixes that start with the same names are ordered by what follows those
        mine, then = rank[left], rank[np.minimum(left + ahead, m)]
        sort = np.argsort(mine * (m + 1) + then)
        left, mine, then = left[sort], mine[sort], then[sort]
        index = np.arange(len(left))
        group = np.concatenate(([True], mine[1:] != mine[:-1]))
        new = group | np.concatenate(([True], then[1:] != then[:-1]))
        rank[left] = mine + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        left = left[~(new & np.append(new[1:], True))]
        ahead *= 2
    out = np.empty(m, dtype=np.int64)
    out[rank[:m] - 1] = np.arange(m)
    return out


def suffix_array(t: np.ndarray, symbols: int = 256) -> np.ndarray:
    """Starts of the suffixes in order; t: uint8 or uint16 below ``symbols``. A suffix precedes those that it begins."""
    if len(t) < 2:
        return np.arange(len(t), dtype=np.int32)
    buckets = _Buckets(t, symbols)
    leftmost = buckets.leftmost
    if len(leftmost) < 2:
        return buckets.induce(leftmost)
    start = leftmost[np.argsort(t[leftmost], kind="stable")]
    found = buckets.induce(start)
    is_leftmost = np.zeros(len(t), dtype=bool)
    is_leftmost[leftmost] = True
    ordered = found[is_leftmost[found]]
    del found
    names = _names(t, ordered, leftmost)
    known = int(names[-1]) + 1
    if known < len(names):
        of_place = np.zeros(len(t), dtype=np.int32)
        of_place[ordered] = names
        in_text = of_place[leftmost]
        del of_place
        ordered = leftmost[suffix_array(in_text.astype(np.uint16), known) if known <= FEW_NAMES else _order_of_names(in_text)]
    return buckets.induce(ordered)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of t (uint8) the bytes that its suffix shares with the one sorted before it (0 for the first).

    Where the bytes before the two suffixes are equal, the length is one less than that of
    the place before; only the other places are compared, and they carry theirs on.
    """
    n = len(t)
    before = np.empty(n, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    carried = np.zeros(n, dtype=bool)
    able = np.flatnonzero(before[1:] > 0) + 1
    carried[able] = t[able - 1] == t[before[able] - 1]
    compared = np.flatnonzero(~carried & (before >= 0))
    a, b = compared.astype(np.int64), before[compared].astype(np.int64)
    room = n - np.maximum(a, b)
    shared = np.zeros(len(compared), dtype=np.int64)
    words, live, depth = _words(t), np.arange(len(compared)), 0
    while len(live):
        apart = words[a[live] + depth] ^ words[b[live] + depth]
        differ = apart != 0
        low = apart[differ] & (~apart[differ] + np.uint64(1))
        shared[live[differ]] = depth + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live, depth = live[~differ], depth + 8
        ended = room[live] <= depth
        shared[live[ended]] = depth
        live = live[~ended]
    length = np.zeros(n, dtype=np.int64)
    length[compared] = np.minimum(shared, room)
    own = np.flatnonzero(~carried)
    source = np.zeros(n, dtype=np.int64)
    source[own] = own
    np.maximum.accumulate(source, out=source)
    return (length[source] - (np.arange(n) - source)).astype(np.int32)
