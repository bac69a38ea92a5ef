"""Suffix arrays by induced sorting, and permuted common prefixes.

Leftmost-smaller (LMS) substrings are sorted by one induction and named by comparing neighbours;
where names repeat, the string of names is sorted by the same function again. Over bytes the scans of
an induction run bucket by bucket in NumPy: all entries of a bucket known so far induce their
predecessors in one step, and entries they add to the same bucket make the next step. Strings of
names have about as many buckets as symbols and are scanned entry by entry.
"""

from __future__ import annotations

import numpy as np

from candlemill.llm.blocks import U, mix, powers

_INV = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_inverse = np.ones(1, U)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        _inverse = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 1 << 16), _INV, U)]))
    return _inverse[:n]


class Prefix:
    """Prefix sums of a polynomial hash: a hash of any substring in constant time."""

    _random = np.random.default_rng(77).integers(1, 1 << 63, (2, 1024), dtype=U) * U(2) + U(1)

    def __init__(self, t: np.ndarray, which: int = 0) -> None:
        n = len(t)
        # symbols of up to 16 bits are below 1,024
        value = self._random[which][t] if t.dtype.itemsize <= 2 else mix(t.astype(U) + self._random[which][0])
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(value * powers(n))]) if n else np.zeros(1, U)
        self.inv = inverse_powers(n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inv[start]


def small_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last (sentinel) is."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(nxt, n - 2)] > 0
    return out


def _put(sa: np.ndarray, t: np.ndarray, who: np.ndarray, head: np.ndarray, way: int) -> None:
    """Append suffixes to their buckets, at heads (way 1) or tails (way -1), in the given order."""
    c = t[who]
    order = np.argsort(c, kind="stable")
    c, who = c[order], who[order]
    count = np.bincount(c, minlength=len(head))
    rank = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
    sa[head[c] + way * rank] = who
    head += way * count


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array from LMS suffixes in order (or LMS substrings, if their order is only by character)."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int64)
    tail = end - 1
    _put(sa, t, lms[::-1], tail, -1)
    first_lms = tail + 1
    head = start.copy()
    for c in range(sigma):
        lo = start[c]
        while lo < head[c]:
            batch, lo = sa[lo : head[c]], head[c]
            pred = batch[batch > 0] - 1
            pred = pred[~small[pred]]
            if len(pred):
                _put(sa, t, pred, head, 1)
        batch = sa[first_lms[c] : end[c]]
        pred = batch[batch > 0] - 1
        pred = pred[~small[pred]]
        if len(pred):
            _put(sa, t, pred, head, 1)
    large_end = head.copy()
    tail = end - 1
    for c in range(sigma - 1, -1, -1):
        hi = end[c] - 1
        while hi > tail[c]:
            batch, hi = sa[tail[c] + 1 : hi + 1][::-1], tail[c]
            pred = batch[batch > 0] - 1
            pred = pred[small[pred]]
            if len(pred):
                _put(sa, t, pred, tail, -1)
        batch = sa[start[c] : large_end[c]][::-1]
        pred = batch[batch > 0] - 1
        pred = pred[small[pred]]
        if len(pred):
            _put(sa, t, pred, tail, -1)
    if n:
        sa[0] = n - 1
    return sa


def induce_each(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same as ``induce``, entry by entry, for alphabets about as large as the text."""
    n = len(t)
    end = np.cumsum(np.bincount(t, minlength=sigma))
    text, is_small, sa, tail = t.tolist(), small.tolist(), [-1] * n, end.tolist()
    head = [0, *tail[:-1]]
    last = tail.copy()
    for i in lms[::-1].tolist():
        c = text[i]
        tail[c] -= 1
        sa[tail[c]] = i
    for i in sa:
        if i > 0 and not is_small[i - 1]:
            c = text[i - 1]
            sa[head[c]] = i - 1
            head[c] += 1
    for k in range(n - 1, -1, -1):
        i = sa[k]
        if i > 0 and is_small[i - 1]:
            c = text[i - 1]
            last[c] -= 1
            sa[last[c]] = i - 1
    out = np.array(sa, np.int64)
    if n:
        out[0] = n - 1
    return out


def ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all ranges in turn, where each range begins among them)."""
    begin = np.cumsum(length) - length
    return np.arange(int(length.sum())) - np.repeat(begin - start, length), begin


def same_spans(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Are t[a : a + length] and t[b : b + length] equal (lengths of 1 or more)?"""
    at, begin = ranges(a, length)
    return np.logical_and.reduceat(t[at] == t[at + np.repeat(b - a, length)], begin) if len(a) else np.zeros(0, bool)


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol is 0 and occurs nowhere else."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    scan = induce if 64 * sigma < n else induce_each
    small = small_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        rough = scan(t, small, lms, sigma)
        ordered = rough[is_lms[rough]]
        # an LMS substring ends with the first symbol of the next; the last one is the sentinel
        size = np.ones(n, np.int64)
        size[lms[:-1]] = np.diff(lms) + 1
        a, b = ordered[:-1], ordered[1:]
        equal = size[a] == size[b]
        equal[equal] = same_spans(t, a[equal], b[equal], size[a[equal]])
        name = np.cumsum(np.concatenate([[0], ~equal]))
        if name[-1] + 1 < len(lms):
            at = np.empty(n, np.int64)
            at[ordered] = name
            ordered = lms[suffix_array(at[lms], int(name[-1]) + 1)]
        lms = ordered
    return scan(t, small, lms, sigma)


def common_prefixes(t: np.ndarray, sa: np.ndarray, prefix: Prefix) -> np.ndarray:
    """Permuted common prefixes: for each text position, the prefix shared with the suffix before it in order.

    Where the symbols before both suffixes agree, the value is one less than the one before;
    only the others (irreducible) are measured, by galloping over substring hashes, and the
    symbols found equal are then compared.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    less = (i > 0) & (phi > 0)
    less[less] = t[i[less] - 1] == t[phi[less] - 1]
    need = np.flatnonzero(~less & (phi >= 0))
    a, b = need, phi[need]
    got = np.zeros(len(need), np.int64)
    limit = n - np.maximum(a, b)
    live, reach = np.arange(len(need)), 32
    while len(live):
        k = np.minimum(reach, limit[live] - got[live])
        s, e = a[live] + got[live], b[live] + got[live]
        whole = prefix.of(s, s + k) == prefix.of(e, e + k)
        got[live[whole]] += k[whole]
        rest = live[~whole]
        step = reach // 2
        while step and len(rest):
            k = np.minimum(step, limit[rest] - got[rest])
            s, e = a[rest] + got[rest], b[rest] + got[rest]
            same = prefix.of(s, s + k) == prefix.of(e, e + k)
            got[rest[same]] += k[same]
            step //= 2
        live = live[whole & (got[live] < limit[live])]
        reach *= 2
    confirm(t, a, b, got)
    out = np.zeros(n, np.int64)
    base = np.full(n, -1, np.int64)
    base[need] = need
    base = np.maximum.accumulate(base)
    value = np.zeros(n, np.int64)
    value[need] = got
    ok = base >= 0
    out[ok] = np.maximum(value[base[ok]] - (i[ok] - base[ok]), 0)
    out[phi < 0] = 0
    return out


def confirm(t: np.ndarray, a: np.ndarray, b: np.ndarray, got: np.ndarray, limit: int = 1 << 20) -> None:
    """Shorten prefixes that only their hashes hold to be equal, comparing about ``limit`` symbols at a time."""
    total = np.cumsum(got)
    lo = 0
    while lo < len(got):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - got[lo] + limit, side="right")))
        at, begin = ranges(a[lo:hi], got[lo:hi])
        wrong = np.flatnonzero(t[at] != t[at + np.repeat((b - a)[lo:hi], got[lo:hi])])
        if len(wrong):
            which = np.searchsorted(begin, wrong, side="right") - 1
            np.minimum.at(got, lo + which, wrong - begin[which])
        lo = hi
