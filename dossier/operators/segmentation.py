"""Words of texts that are written without spaces: a sentence's dictionary words as a graph, and its likeliest path.

Each place of a run of ideographs is joined to the places where a word of the
lexicon that begins there ends, and to the next place, so that every run has a
path.  A word's weight is the logarithm of its share of all counts; a character
that is no word counts as one occurrence.  The path of the largest sum is found
from the end backwards, one place at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK_RUN, tokens

#: Words that a lexicon may have: it goes to every worker, some hundred bytes a word.
MOST_WORDS = 2_000_000
_IDEOGRAPHS = "一-鿿"  # the range of CJK_RUN
#: Characters of texts that are split at once; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20
#: Runs that go together; fewer long ones that are left go one by one.
MANY = 48
#: Entries of a table of steps that is kept whole (four bytes each); a larger lexicon's steps are looked up.
DENSE = 1 << 23
_PLAIN = "_plain_words"
_PARTS = re.compile(f"[{_IDEOGRAPHS}]+|[^\\W_{_IDEOGRAPHS}]+")


class Lexicon:
    """Words and how often they occur; picklable, so that it can be broadcast."""

    def __init__(self, counts: dict[str, int]):
        self.counts = {w: n for w, n in counts.items() if w and n > 0}
        # every beginning of a word: where none goes on, a search from a place can end
        self.beginnings = {w[:i] for w in self.counts for i in range(1, len(w))}
        self.log_total = math.log(max(1, sum(self.counts.values())))

    @classmethod
    def of(cls, words: DataFrame, most: int = MOST_WORDS) -> Lexicon:
        """From a table (word, n); more than `most` words are an error, as all workers hold them."""
        rows = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a lexicon of more than {most} words")
        return cls({r.word: r.n for r in rows})

    def ends(self, run: str, start: int) -> Iterator[int]:
        """Where words that begin at start end: the next place at least, in order."""
        yield start + 1
        for end in range(start + 1, len(run) + 1):
            piece = run[start:end]
            if end > start + 1 and piece in self.counts:
                yield end
            if piece not in self.beginnings:
                return

    def weight(self, word: str) -> float:
        return math.log(self.counts.get(word, 1)) - self.log_total

    def split(self, run: str) -> list[str]:
        """The words of the likeliest path; of equal ones that with the longest word first."""
        best, follow = [0.0] * (len(run) + 1), [0] * len(run)
        for start in range(len(run) - 1, -1, -1):
            best[start], follow[start] = max((self.weight(run[start:end]) + best[end], end) for end in self.ends(run, start))
        words, at = [], 0
        while at < len(run):
            words.append(run[at : follow[at]])
            at = follow[at]
        return words

    def terms(self, text: str | None) -> list[str]:
        """A text's terms: runs of ideographs by their words, other letters and digits as runs, lower-cased."""
        found = []
        for part in _PARTS.findall((text or "").lower()):
            found += self.split(part) if _IDEOGRAPHS[0] <= part[0] <= _IDEOGRAPHS[2] else [part]
        return found


class Splitter:
    """A lexicon's beginnings as numbered nodes in arrays, which split all texts of a block at once, as Lexicon.terms does one by one."""

    def __init__(self, lexicon: Lexicon):
        low, high = ord(_IDEOGRAPHS[0]), ord(_IDEOGRAPHS[2])
        words = sorted(w for w in lexicon.counts if all(low <= ord(c) <= high for c in w))
        node, steps = {"": 0}, []
        for word in words:
            for i in range(1, len(word) + 1):
                if word[:i] not in node:
                    node[word[:i]] = len(node)
                    steps.append((node[word[: i - 1]], ord(word[i - 1]), len(node) - 1))
        self.low, self.log_total = low, lexicon.log_total
        self.weights = np.full(len(node), np.nan)
        for word in words:
            self.weights[node[word]] = lexicon.weight(word)
        signs = sorted({c for _, c, _ in steps})
        self.sign = np.full(high - low + 1, -1, np.int32)
        self.sign[np.array(signs, np.int64) - low] = np.arange(len(signs))
        self.width = max(1, len(signs))
        keys = np.array([a * self.width + int(self.sign[c - low]) for a, c, _ in steps], np.int64)
        to = np.array([b for _, _, b in steps], np.int32)
        order = np.argsort(keys)
        self.keys, self.to, self.dense = keys[order], to[order], None
        if len(node) * self.width <= DENSE:
            self.dense = np.full(len(node) * self.width, -1, np.int32)
            self.dense[keys] = to
            self.keys = self.to = None

    def step(self, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The nodes after these by one more character each, -1 where no word goes on."""
        key = node.astype(np.int64) * self.width + np.maximum(sign, 0)
        if self.dense is not None:
            found = self.dense[key]
        elif not len(self.keys):
            return np.full(len(key), -1, np.int32)
        else:
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = np.where(self.keys[at] == key, self.to[at], -1)
        return np.where(sign < 0, -1, found)

    def starts(self, codes: np.ndarray, bounds: np.ndarray, written: np.ndarray) -> np.ndarray:
        """Where words begin in runs that follow each other (code points, the runs' bounds, and which consist of ideographs)."""
        size = np.diff(bounds)
        runs = np.flatnonzero(written)
        at = np.flatnonzero(np.repeat(written, size))
        sign = np.full(len(codes), -1, np.int32)
        sign[at] = self.sign[codes[at] - self.low]
        end = np.repeat(bounds[1:], size)
        one = np.full(len(codes), math.log(1) - self.log_total)
        node, n, edges = self.step(np.zeros(len(at), np.int32), sign[at]), 1, []
        while True:
            alive = node >= 0
            at, node = at[alive], node[alive]
            weight = self.weights[node]
            word = ~np.isnan(weight)
            if n == 1:
                one[at[word]] = weight[word]
            elif word.any():
                edges.append((at[word], np.full(int(word.sum()), n), weight[word]))
            more = at + n < end[at]
            at, node = at[more], node[more]
            if not len(at):
                break
            node = self.step(node, sign[at + n])
            n += 1
        first, length, weight = np.zeros(len(codes) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if edges:
            start, length, weight = (np.concatenate(x) for x in zip(*edges))
            order = np.argsort(start, kind="stable")  # of one start the shorter words come first
            length, weight = length[order], weight[order]
            first[1:] = np.cumsum(np.bincount(start, minlength=len(codes)))
        best, follow = np.zeros(len(codes) + 1), np.ones(len(codes), np.int64)
        runs = runs[np.argsort(-size[runs], kind="stable")]
        low, at = bounds[runs], bounds[runs + 1]
        after = np.zeros(len(runs))  # the sums from the places after these on
        some = np.diff(first)
        while True:  # one place of every run at a time, from the end backwards, while there are many
            at = at - 1
            going = int(np.searchsorted(low - at, 1))  # runs by falling length: those that end sooner are last
            at, low, after = at[:going], low[:going], after[:going]
            if going < MANY:
                break
            after = one[at] + after
            edge, left = first[at], some[at]
            own = np.flatnonzero(left)
            edge, left, k = edge[own], left[own], 0
            while len(own):
                other = weight[edge] + np.where(at[own] + length[edge] == end[at[own]], 0.0, best[at[own] + length[edge]])
                better = other >= after[own]  # of equal sums that of the longer word
                after[own[better]], follow[at[own[better]]] = other[better], length[edge[better]]
                k += 1
                more = left > k
                own, edge, left = own[more], edge[more] + 1, left[more]
            best[at] = after
        for begin, place, sum_ in zip(low.tolist(), at.tolist(), after.tolist()):  # long runs that are left, one by one
            self._rest(begin, place, sum_, int(end[place]), one, first, length, weight, best, follow)
        found, at, high = [], bounds[runs], bounds[runs + 1]
        while len(at) >= MANY:
            found.append(at)
            at = at + follow[at]
            going = at < high
            at, high = at[going], high[going]
        for place, stop in zip(at.tolist(), high.tolist()):
            steps, walked = follow[place:stop].tolist(), []
            at_ = 0
            while at_ < len(steps):
                walked.append(place + at_)
                at_ += steps[at_]
            found.append(np.array(walked, np.int64))
        return np.sort(np.concatenate([*found, bounds[:-1][~written]]))

    @staticmethod
    def _rest(low: int, place: int, sum_: float, high: int, one: np.ndarray, first: np.ndarray, length: np.ndarray, weight: np.ndarray, best: np.ndarray, follow: np.ndarray) -> None:
        """Goes on with one run from a place backwards to its beginning; places after it have their sums."""
        edges = first[low : place + 2].tolist()
        base = edges[0]
        lengths, weights = length[base : edges[-1]].tolist(), weight[base : edges[-1]].tolist()
        sums, singles, ahead = best[low:high].tolist() + [0.0], one[low : place + 1].tolist(), [1] * (place + 1 - low)
        last = edges[-1]
        for i in range(place - low, -1, -1):
            sum_ = singles[i] + sum_
            edge = edges[i]
            if edge != last:
                for j in range(edge - base, last - base):
                    other = weights[j] + sums[i + lengths[j]]
                    if other >= sum_:
                        sum_, ahead[i] = other, lengths[j]
                last = edge
            sums[i] = sum_
        follow[low : place + 1] = ahead

    def terms(self, texts: list[str]) -> pa.ListArray:
        """The terms of each text."""
        parts = [_PARTS.findall(t.lower()) for t in texts]
        flat = [x for p in parts for x in p]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64)
        held = "".join(flat)
        low, high = _IDEOGRAPHS[0], _IDEOGRAPHS[2]
        written = np.array([low <= x[0] <= high for x in flat], bool)
        codes = np.frombuffer(held.encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = self.starts(codes, bounds, written)
        data = held.encode()
        place = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(place[np.append(starts, len(codes))].tobytes()), pa.py_buffer(data))
        rows = bounds[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, rows).astype(np.int32)), words)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each block of a batch."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > BLOCK_CHARS:
            yield first, i - first
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes) - first


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """word and n of texts whose words are set apart by spaces, as a lexicon's table."""
    return texts.select(F.explode(tokens(F.lower(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _has_ideographs(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK_RUN), F.lit(False))


def with_words(rows: DataFrame, lexicon: Lexicon, text: str = "text", words: str = "words") -> DataFrame:
    """rows with an array of the text's terms; a null text has none.

    Texts without ideographs keep to built-in functions; the others are split by
    blocks in workers, each of which gets the lexicon once.  rows are made once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(Splitter(lexicon))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(text)
            for first, n in _slices([len(t or "") for t in texts.to_pylist()]):
                part = batch.slice(first, n)
                plain = part.column(_PLAIN)
                split = own.terms([t if alone else "" for t, alone in zip(part.column(text).to_pylist(), plain.is_null().to_pylist())])
                if plain.null_count < n:
                    split = pa.concat_arrays([split, plain.cast(split.type)]).take(pa.array(np.arange(n) + n * plain.is_valid().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], split], names=[*batch.schema.names[:-1], words])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{words}` array<string>"
    plain = F.when(~_has_ideographs(F.col(text)), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
    return rows.withColumn(_PLAIN, plain).mapInArrow(task, kinds)
