"""Document quality by a linear-chain conditional random field over lines.

Every line of a document gets features of its own and of its neighbours, and a
label: good or bad.  Unary weights and a transition matrix are fitted by the
conditional likelihood of lines that carry their document's label, on a
bounded sample of labelled documents.  A document's score is the mean of its
lines' forward-backward marginals, weighted by their length, put through a
logistic curve that is fitted on the same sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fit sees at most so many labelled documents (those whose ids hash lowest), and stops at so many of their lines.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 2000, 30_000
STEPS, RATE, DECAY = 100, 0.2, 1e-4
LINE_CHARS = 400  # longer lines are cut into lines of so many code points, so one line never is a text
_token = re.compile(r"\S+")
OWN = 12


def lines_of(text: str | None) -> list[str]:
    """The lines with something in them; long ones in parts."""
    out = []
    for line in (text or "").split("\n"):
        if line.strip():
            out += [line] if len(line) <= LINE_CHARS else [line[i : i + LINE_CHARS] for i in range(0, len(line), LINE_CHARS)]
    return out


def _line(line: str, seen: set[str], words_seen: set[str]) -> tuple[float, ...]:
    words = line.split()
    n, chars = len(words), len(line)
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    letters = sum(map(str.isalpha, line)) if not line.isascii() else len(line) - len(line.translate(_LETTERS))
    upper = sum(map(str.isupper, line))
    marks = sum(line.count(c) for c in ".,;:?'")
    odd = sum(line.count(c) for c in "#*$%&|<>!@^~=_{}[]\\/")
    mean = (chars - n + 1) / max(1, n)
    short = sum(len(w) <= 3 for w in words)
    known = sum(w in words_seen for w in words)
    repeat = line in seen
    seen.add(line)
    words_seen.update(words)
    return (min(n, 60) / 20, distinct / max(1, n), again / max(1, n), letters / chars, upper / max(1, letters), 8 * marks / chars, 5 * odd / chars, min(mean, 20) / 6, short / max(1, n), known / max(1, n), float(repeat), float(n <= 2))


_LETTERS = {c: None for c in range(128) if chr(c).isalpha()}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One row of features for each line, with the neighbours' beside its own, and the lines' lengths."""
    lines = lines_of(text)
    if not lines:
        return np.zeros((0, 3 * OWN + 3)), np.zeros(0)
    seen: set[str] = set()
    words: set[str] = set()
    own = np.array([_line(x, seen, words) for x in lines])
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[0], after[-1] = own[0], own[-1]
    n = len(own)
    edge = np.zeros((n, 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.concatenate([own, before, after, edge, np.ones((n, 1))], 1), np.array([len(x) for x in lines], float)


class Chain:
    """Weights (features by labels), transitions and the scale of the features."""

    def __init__(self, width: int = 3 * OWN + 3):
        self.unary, self.transition = np.zeros((width, 2)), np.zeros((2, 2))
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.slope, self.shift = 4.0, 0.0
        self.empty = 0.5

    def potentials(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.unary

    def marginals(self, potentials: list[np.ndarray]) -> list[np.ndarray]:
        """Label marginals of many chains at once: they step together, longest first."""
        return [m for m, _ in self.run(potentials)]

    def run(self, potentials: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        order = sorted(range(len(potentials)), key=lambda i: -len(potentials[i]))
        lengths = np.array([len(potentials[i]) for i in order])
        out: list = [(np.zeros((0, 2)), np.zeros((2, 2)))] * len(potentials)
        if not len(order) or not lengths[0]:
            return out
        m, t = int((lengths > 0).sum()), int(lengths[0])
        u = np.zeros((m, t, 2))
        for r in range(m):
            u[r, : lengths[r]] = potentials[order[r]]
        forward, backward = np.zeros((m, t, 2)), np.zeros((m, t, 2))
        forward[:, 0] = u[:, 0]
        alive = [int((lengths > k).sum()) for k in range(t)]
        w = self.transition
        for k in range(1, t):
            a = alive[k]
            s = forward[:a, k - 1, :, None] + w
            forward[:a, k] = np.logaddexp(s[:, 0], s[:, 1]) + u[:a, k]
        for k in range(t - 2, -1, -1):
            a = alive[k + 1]
            s = w + (backward[:a, k + 1] + u[:a, k + 1])[:, None, :]
            backward[:a, k] = np.logaddexp(s[:, :, 0], s[:, :, 1])
        for r in range(m):
            n = lengths[r]
            f, b = forward[r, :n], backward[r, :n]
            z = np.logaddexp(*f[-1])
            pair = np.zeros((2, 2))
            if n > 1:
                pair = np.exp(f[:-1, :, None] + w + (b[1:] + u[r, 1:n])[:, None, :] - z).sum(0)
            out[order[r]] = (np.exp(f + b - z), pair)
        return out

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Chain:
        """Conditional likelihood by gradient steps with momentum; documents count by class, so that both weigh alike."""
        xs = [x for x, _ in rows]
        whole = np.concatenate(xs)
        self.mean, self.scale = whole.mean(0), whole.std(0) + 1e-6
        self.mean[-1], self.scale[-1] = 0, 1
        z = [(x - self.mean) / self.scale for x in xs]
        share = np.array([1 / max(1, (labels == y).sum()) for y in (0, 1)])[labels] / 2
        per = [share[i] / max(1, len(x)) for i, x in enumerate(xs)]
        speed_u, speed_t = np.zeros_like(self.unary), np.zeros_like(self.transition)
        stacked, weights = np.concatenate(z), np.concatenate([np.full(len(x), p) for x, p in zip(xs, per)])
        truth = np.concatenate([np.eye(2)[np.full(len(x), y)] for x, y in zip(xs, labels)])
        for _ in range(STEPS):
            got = self.run([x @ self.unary for x in z])
            wrong = truth - np.concatenate([m for m, _ in got])
            g = stacked.T @ (wrong * weights[:, None]) - DECAY * self.unary
            h = sum(p * (np.eye(2)[y][:, None] * np.eye(2)[y] * max(0, len(x) - 1) - e) for (_, e), x, y, p in zip(got, xs, labels, per)) - DECAY * self.transition
            speed_u, speed_t = 0.9 * speed_u + g, 0.9 * speed_t + h
            self.unary += RATE * speed_u
            self.transition += RATE * speed_t
        means = np.array([self.mean_marginal(m, n) for (m, _), (_, n) in zip(self.run([x @ self.unary for x in z]), rows)])
        self._calibrate(means, labels)
        return self

    def mean_marginal(self, marginals: np.ndarray, lengths: np.ndarray) -> float:
        return float(marginals[:, 1] @ lengths / lengths.sum())

    def _calibrate(self, means: np.ndarray, labels: np.ndarray) -> None:
        """A logistic curve of the mean's log odds (Newton steps with a little shrinking)."""
        x = np.stack([_odds(means), np.ones(len(means))], 1)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            w = w + np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * (w - [1, 0]))
        self.slope, self.shift = float(w[0]), float(w[1])
        self.empty = float(labels.mean())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = [features(t) for t in texts]
        got = self.marginals([self.potentials(x) for x, _ in rows])
        return np.array([1 / (1 + np.exp(-np.clip(self.slope * _odds(self.mean_marginal(m, n)) + self.shift, -30, 30))) if len(n) else self.empty for m, (_, n) in zip(got, rows)])


def _odds(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Chain:
    """Fits a chain on at most `sample` labelled documents, those whose ids hash lowest; without both labels it says nothing (0.5)."""
    labelled = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).toArrow()
    rows, kept, held = [], [], 0
    for text, y in zip(found["text"].to_pylist(), found["quality"].to_pylist()):
        x, n = features(text)
        if len(n) and held < SAMPLE_LINES:
            rows.append((x, n))
            kept.append(y)
            held += len(n)
    chain = Chain()
    if len(set(kept)) < 2:
        chain.slope = 0.0
        return chain
    return chain.fit(rows, np.array(kept))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) for every row, from the text alone.

    A null text or one without a filled line gets the sample's share of label
    1.  Repeated rows come back as often; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, some, held = batch.column("text").to_pylist(), [], [], 0
            for t in texts:
                some.append(t)
                held += len(t or "")
                if held > 500_000:
                    out.append(shared.value.scores(some))
                    some, held = [], 0
            if some:
                out.append(shared.value.scores(some))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, score double")
