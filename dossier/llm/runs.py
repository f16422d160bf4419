"""Periodic runs of words by Main-Lorentz divide and conquer.

A text's words are interned as numbers, and the text is halved again and again.
A run lies inside the first stretch whose middle it holds.  There Z-functions
from the middle m on, and from m back, extend it both ways for every period q
at once:

* right of the middle: how far words m.. equal words m + q.., and how far back
  the words before m equal those before m + q;
* left of it: the same for m - q and m.

What reaches over a stretch's bounds was found in a longer one; an interval
that is found with several periods is one run, of the smallest.

Z-functions are only worked out where a run can be: a run of three periods or
more has, beside the middle, two equal neighbours of at least one period, which
running sums of random numbers test for all periods of all stretches of a level
at once.  Equal stretches never fail that test, so nothing is lost, and a chance
pass costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_LENGTH, MIN_PERIODS = 24, 3
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _codes(count: int) -> np.ndarray:
    """A fixed random number for each interned word."""
    if len(_tables.get("codes", ())) < count:
        _tables["codes"] = np.random.default_rng(12).integers(1, 1 << 63, max(2 * count, 1 << 12), dtype=np.uint64)
    return _tables["codes"]


def _powers(count: int) -> np.ndarray:
    if len(_tables.get("powers", ())) < count:
        many = np.full(max(2 * count, 1 << 12), _BASE, np.uint64)
        many[0] = 1
        _tables["powers"] = np.cumprod(many, dtype=np.uint64)
    return _tables["powers"]


def z_function(s: list[int], upto: int | None = None) -> list[int]:
    """For each place below upto, how many items from there on equal those from the start on; the first is the whole length."""
    n = len(s)
    upto = n if upto is None else min(upto, n)
    z = [0] * upto
    if not n:
        return z
    z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(words: list[int], left: int, middle: int, right: int, periods: int) -> Iterator[tuple[int, int, int]]:
    """start, end and period of what repeats across the middle of words[left:right], for each period up to periods: from two Z-functions, over a half, a mark, and what lies across with that half."""
    u, v = words[left:middle][::-1], words[middle:right]
    ahead = z_function(v + [-1] + words[middle - periods : middle] + v, len(v) + 1 + periods)
    behind = z_function(u + [-1] + v[:periods][::-1] + u, len(u) + 1 + periods)
    for q in range(1, periods + 1):
        after = ahead[q] if q < len(v) else 0  # m and m + q
        before = behind[len(u) + 1 + periods - q]
        yield middle - before, middle + q + after, q
        before = behind[q] if q < len(u) else 0  # m - q and m
        after = ahead[len(v) + 1 + periods - q]
        yield middle - q - before, middle + after, q


def _suspects(ids: np.ndarray, min_length: int, min_periods: int) -> Iterator[tuple[int, int, int, int]]:
    """left, middle, right and the largest period of the stretches across whose middle something may repeat."""
    n = len(ids)
    power = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_codes(int(ids.max()) + 1)[ids] * power[:n], out=total[1:])
    lefts, rights = np.array([0]), np.array([n])
    while len(lefts):
        middles = (lefts + rights) // 2
        periods = (rights - lefts) // min_periods
        node = np.repeat(np.arange(len(lefts)), periods)
        q = np.arange(len(node)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        left, middle, right = lefts[node], middles[node], rights[node]
        # half of what min_periods - 1 periods, or the shortest run less one period, leave on the longer side
        size = np.maximum((min_periods - 1) * q, min_length - q) + 1 >> 1
        hit = np.zeros(len(node), bool)
        # a.. and a + q.., size words each; below three periods the shorter side may be the one that is left
        for a in (middle, middle - size, middle - q - size, *([middle - q] if min_periods < 3 else [])):
            fits = np.flatnonzero((a >= left) & (a + q + size <= right))
            at, by, long = a[fits], q[fits], size[fits]
            same = (total[at + long] - total[at]) * power[by] == total[at + by + long] - total[at + by]
            hit[fits[same]] = True
        if hit.any():
            found, first = np.unique(node[hit][::-1], return_index=True)
            largest = q[hit][::-1][first]
            for k, most in zip(found.tolist(), largest.tolist()):
                yield int(lefts[k]), int(middles[k]), int(rights[k]), most
        lefts, rights = np.concatenate([lefts, middles]), np.concatenate([middles, rights])
        enough = rights - lefts >= max(min_length, min_periods)
        lefts, rights = lefts[enough], rights[enough]


def find_runs(words: list, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """start, length and smallest period of each run of words, by start, then period: min_length words and min_periods periods or more, that no neighbour extends."""
    n = len(words)
    if n < min_length or min_periods < 2:
        if min_periods < 2:
            raise ValueError("a run has two periods at least")
        return []
    number: dict = {}
    numbers = [number.setdefault(w, len(number)) for w in words]
    if len(number) == n:
        return []
    best: dict[tuple[int, int], int] = {}
    for left, middle, right, most in _suspects(np.array(numbers), min_length, min_periods):
        for start, end, q in _crossing(numbers, left, middle, right, most):
            if end - start < max(min_length, min_periods * q):
                continue
            # what goes on beyond the stretch holds a middle of a longer stretch, and was found there
            if start == left and start and numbers[start - 1] == numbers[start - 1 + q]:
                continue
            if end == right and end < n and numbers[end] == numbers[end - q]:
                continue
            if q < best.get((start, end), n + 1):
                best[start, end] = q
    return sorted((start, end - start, q) for (start, end), q in best.items())


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    held = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(held).tolist()]


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def detect(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs and collapsed (the text with one period of each run, words joined by a space) of every row of docs (doc_id, text).

    Words are what lies between ASCII white space.  A null text has none: no
    runs, an empty collapsed text.  Runs that overlap are all listed.  Repeated
    rows come back as often, a null doc_id stays null, an empty table gives no
    rows; other columns, whatever their names, are not read.  A text is one
    row's work in one task, with some hundred bytes of memory a word; there is
    no shuffle.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(doc_ids, rows):
            counts, runs, texts = zip(*rows)
            listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in some] for some in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), listed, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            rows, held, at = [], 0, 0
            column = batch.column("text").cast(pa.binary())
            for i in range(len(column)):
                text = column[i].as_py() or b""
                words = text.split()
                runs = find_runs(words, min_length, min_periods)
                rows.append((len(words), runs, b" ".join(kept_words(words, runs)).decode()))
                held += len(text)
                if held > 1 << 22:
                    yield made(batch.column("doc_id").slice(at, len(rows)), rows)
                    rows, held, at = [], 0, i + 1
            if rows:
                yield made(batch.column("doc_id").slice(at, len(rows)), rows)

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")
