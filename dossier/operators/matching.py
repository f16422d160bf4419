"""Matching blocks of texts as difflib finds them (autojunk off), in numpy for many pairs at once.

difflib takes the longest common stretch of two windows (of equal ones the
first in a, then the first in b) and goes on to the left and to the right of
it.  Here all windows of all pairs go together, by falling length: where every
window's longest stretch has at most some length, a scan from left to right
takes the stretches of just that length in difflib's order, and what is left
of a stretch is a window of its own.  Stretches are compared by exact names of
their first and last 2^k characters, so there are no collisions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import numpy as np


def _joint(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """One number for each different (x, y), and their bound."""
    if not len(x):
        return x.astype(np.int64), 1
    high = int(y.max()) + 1
    if int(x.max()) < (1 << 62) // high:
        key = x.astype(np.int64) * high + y
    else:
        key = np.unique(x, return_inverse=True)[1].astype(np.int64) * high + y
    return key, int(key.max()) + 1


def _shared(key: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a key that occurs on both sides, and for those one small number a key, in the order of keys."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) < 1 << (63 - bits):  # numbers that hold their places too are sorted some times faster
        by = np.sort(key << bits | np.arange(len(key)))
        order, by = by & ((1 << bits) - 1), by >> bits
    else:
        order = np.argsort(key)
        by = key[order]
    new = np.empty(len(by), bool)
    new[:1] = True
    np.not_equal(by[1:], by[:-1], out=new[1:])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(by)))
    ones = np.add.reduceat(left[order].astype(np.int64), first) if len(first) else size
    both = (ones > 0) & (ones < size)
    some = np.zeros(len(by), bool)
    number = np.empty(len(by), np.int64)
    some[order], number[order] = np.repeat(both, size), np.repeat(np.cumsum(both) - 1, size)
    return some, number[some]


def matches(pairs: Iterable[tuple[str, str]]) -> np.ndarray:
    """Characters in matching blocks of each pair."""
    pairs = list(pairs)
    n = len(pairs)
    texts = [a for a, _ in pairs] + [b for _, b in pairs]
    total = np.zeros(n, np.int64)
    # all a, then all b, a separator after each text
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + 1) - size - 1
    if not size.sum():
        return total
    length = int((size + 1).sum())
    char = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    half = int((size[:n] + 1).sum())
    window = np.repeat(np.tile(np.arange(n), 2), size + 1)
    ends = first + size
    window[ends] = -1
    end = np.repeat(ends, size + 1)
    pair = window.copy()

    # names of the stretches of 2^k characters that both texts of a pair have
    places, names = [], []
    at = np.flatnonzero(window >= 0)
    name = _joint(char[at], pair[at])[0]  # a stretch of two pairs has two names, so names are told from names alone
    k = 0
    while len(at):
        shared, name = _shared(name, at < half)
        at = at[shared]
        if not len(at):
            break
        places.append(at)
        names.append(name)
        dense = np.full(length, -1, np.int64)
        dense[at] = name
        fits = at + (2 << k) <= end[at]
        at, name = at[fits], name[fits]
        second = dense[at + (1 << k)]
        at, name, second = at[second >= 0], name[second >= 0], second[second >= 0]
        name = _joint(name, second)[0]
        k += 1

    low_a, low_b, owner = first[:n].tolist(), first[n:].tolist(), list(range(n))
    for k in range(len(places) - 1, -1, -1):
        short = 1 << k
        dense = np.full(length, -1, np.int64)
        dense[places[k]] = names[k]
        at = places[k]
        at = at[(window[at] >= 0) & (window[at] == window[at + short - 1])]
        at = at[_shared(_joint(dense[at], window[at])[0], at < half)[0]]
        if not len(at):
            continue
        # a stretch of 2^k + r characters starts r + 1 of these in a row
        last = np.flatnonzero(np.append(np.diff(at) != 1, True))
        most = short + at[last[np.searchsorted(last, np.arange(len(at)))]] - at
        top = min(2 * short - 1, int(most[at < half].max()), int(most[at >= half].max()))
        while top >= short:
            some = most >= top
            if k:
                here = window[at]
                some &= here >= 0
                some[some] = here[some] == window[at[some] + top - 1]
            start = at[some]
            key, _ = _joint(_joint(dense[start], dense[start + top - short])[0], window[start])
            both, key = _shared(key, start < half)
            start = start[both]
            if len(start):
                split = int(np.searchsorted(start, half))
                order = np.lexsort((start[split:], key[split:]))
                b_sorted = start[split:][order].tolist()
                bound = np.searchsorted(key[split:][order], np.arange(int(key.max()) + 2)).tolist()
                for i, g, w in zip(start[:split].tolist(), key[:split].tolist(), window[start[:split]].tolist()):
                    if i < low_a[w]:
                        continue
                    p = bisect_left(b_sorted, low_b[w], bound[g], bound[g + 1])
                    if p == bound[g + 1]:
                        continue
                    j = b_sorted[p]
                    total[owner[w]] += top
                    new = -1
                    if low_a[w] < i and low_b[w] < j:
                        new = len(owner)
                        owner.append(owner[w])
                        low_a.append(low_a[w])
                        low_b.append(low_b[w])
                    window[low_a[w] : i], window[low_b[w] : j] = new, new
                    window[i : i + top], window[j : j + top] = -1, -1
                    low_a[w], low_b[w] = i + top, j + top
            # what was not taken, or starts in what is left, is shorter
            if top == short:
                break
            live = window[at] >= 0
            at, most = at[live], np.minimum(most[live], top - 1)
            a_side = at < half
            if not a_side.any() or a_side.all():
                break
            top = min(top - 1, int(most[a_side].max()), int(most[~a_side].max()))
    return total


def ratios(pairs: Iterable[tuple[str | None, str | None]], batch: int = 1 << 18) -> list[float]:
    """What difflib's ratio() gives for each pair (1 for two empty texts), some `batch` characters at a time."""
    out, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        out.extend(2.0 * m / (len(a) + len(b)) if a or b else 1.0 for (a, b), m in zip(held, matches(held).tolist()))
        held, size = [], 0

    for a, b in pairs:
        held.append((a or "", b or ""))
        size += len(held[-1][0]) + len(held[-1][1])
        if size >= batch:
            flush()
    if held:
        flush()
    return out
