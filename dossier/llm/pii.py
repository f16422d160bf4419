"""Personal data: base patterns, then a skip-chain conditional random field over each document.

Nodes are mentions: stretches that look like numbers or addresses, whether or
not a base pattern takes them.  A mention that a base pattern takes has its
kind for certain; the others are open.  An open mention has potentials from its
number of digits, its separators and the word before.  Edges carry a weight for
agreement on a kind: NEAR between neighbours, and skip edges between mentions
anywhere in the text that repeat each other (SAME: the same digits, the same
last digits, the same address in another spelling) or are built alike (ALIKE:
as many digits and the same separators).  Loopy sum-product messages over all
edges give marginals; an open mention whose marginal for a kind passes
THRESHOLD is added as a span.  Like mentions are linked in a chain, each with
the next, so edges grow with mentions and not with their square.

All potentials are fitted by `fit` over every text: the base spans are the
labels, and what the base patterns test (sign, checksum, plus, parts up to 255)
is masked, so that open mentions can look like them.  Counts of features by
kind give the unary potentials, counts of agreement over edges between base
spans the weights of edges; a few observations (PRIOR, AGREED) are counted
beforehand, and MISSED is the share of entities that base patterns are taken to
miss.  A mention that has failed a base pattern thus needs a mention of that
kind elsewhere in the document, or a word before it that tells.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[0-9]")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Open mentions: numbers with separators, and addresses with the sign spelt out.
_number = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,3}[0-9])++(?![A-Za-z])")
_spelt = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63})(?: ?[\[(]at[\])] ?)([A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63})+)", re.I)
# Words that announce a kind.
CUES = {"email": "email", "e-mail": "email", "mail": "email", "ip": "ip", "host": "ip", "server": "ip", "card": "card", "visa": "card", "mastercard": "card", "phone": "phone", "tel": "phone", "telephone": "phone", "mobile": "phone", "call": "phone", "fax": "phone"}
OPEN = "none"
LABELS = (OPEN, *KINDS)
#: Observations counted beforehand: (label, digits, separators): how many.
PRIOR = {("email", "address", "at"): 4, ("ip", "quad", "."): 4, ("card", "16-19", ""): 2, ("card", "16-19", " "): 2, ("card", "16-19", "-"): 2, ("phone", "10-11", "("): 2, ("phone", "10-11", " "): 2, ("phone", "10-11", "-"): 2, ("phone", "12-15", " "): 2, ("phone", "7-9", "-"): 1, (OPEN, "7-9", ""): 2, (OPEN, "10-11", ""): 2, (OPEN, "16-19", ""): 2, (OPEN, "20-", ""): 2}
#: Pairs counted beforehand as agreeing, for one that does not.
AGREED = {"near": 1, "same": 50, "alike": 50}
MISSED, MOST, MOST_FORM = 0.05, 6.0, 1.4
ROUNDS, DAMPING, THRESHOLD, MIN_DIGITS, NEAR = 12, 0.3, 0.6, 7, 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind, in order."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        last = 0
        for m in _domain.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _local:
                start -= 1
            if start < at:
                found.append((0, start, m.end()))
                last = m.end()
    if _digit.search(text):
        found += [(1, m.start(), m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _card.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _phone.finditer(text) if 8 <= sum(map(str.isdecimal, m[0])) <= 15]
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _address(s: str) -> str:
    return re.sub(r" ?[\[(]dot[\])] ?", ".", re.sub(r" ?[\[(]at[\])] ?", "@", s.lower()))


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None]]:
    """(start, end, kind or None) of all nodes by place: base spans, and open mentions that meet none."""
    nodes: list[tuple[int, int, int | None]] = [(s, e, k) for k, s, e in base]
    opened = [m.span() for m in _number.finditer(text) if len(_digits(m[0])) >= MIN_DIGITS] if _digit.search(text) else []
    if "at)" in text.lower() or "at]" in text.lower():
        opened += [m.span() for m in _spelt.finditer(text)]
    nodes.sort()
    taken, k = [], 0
    for s, e in sorted(opened):
        while k < len(nodes) and nodes[k][1] <= s:
            k += 1
        if k == len(nodes) or nodes[k][0] >= e:
            taken.append((s, e, None))
    return sorted(nodes + taken, key=lambda n: (n[0], n[1]))


def features(text: str, start: int, end: int) -> tuple[str, str, str]:
    """How many digits a mention has, how they are separated, and the kind that the word before announces; nothing that a base pattern tests."""
    s = text[start:end]
    before = re.findall(r"[A-Za-z-]+", text[max(0, start - 24) : start])
    cue = CUES.get(before[-1].lower().strip("-"), "") if before else ""
    if not s[-1].isdigit() or "@" in s:
        return "address", "at", cue
    if s.count(".") == 3 and all(p.isdecimal() for p in s.split(".")):
        return "quad", ".", cue
    n = len(_digits(s))
    digits = next(name for most, name in ((9, "7-9"), (11, "10-11"), (15, "12-15"), (19, "16-19"), (n, "20-")) if n <= most)
    return digits, next((c for c in "(.- " if c in s), ""), cue


def edges(text: str, nodes: list[tuple[int, int, int | None]]) -> Iterator[tuple[int, int, str]]:
    """Pairs of nodes that share a potential, and which."""
    last: dict[tuple[str, ...], int] = {}
    for i, (s, e, kind) in enumerate(nodes):
        if i and s - nodes[i - 1][1] <= NEAR:
            yield i - 1, i, "near"
        part = text[s:e]
        if kind == 0 or (kind is None and not part[-1].isdigit()):
            keys = [("same", "a" + _address(part))]
        else:
            d = _digits(part)
            keys = [("same", "d" + d)] + [("same", f"{n}:{d[-n:]}") for n in (10, 7) if len(d) >= n and kind != 1]
            keys.append(("alike", str(len(d)), re.sub("[0-9]+", "", part.lstrip("+"))))
        linked = set()
        for key in keys:
            if key in last and last[key] not in linked:
                linked.add(last[key])
                yield last[key], i, key[0]
            last[key] = i


class Potentials:
    """Log potentials from counts of (what, ...): ("unary", label, digits, separators, cue) and ("edge", kind of edge, agreeing or not)."""

    def __init__(self, counts: dict[tuple[str, ...], int] | None = None):
        seen: list[dict[tuple[str, str], float]] = [defaultdict(float) for _ in range(3)]
        total: dict[str, float] = defaultdict(float)
        pairs = {name: [float(n), 1.0] for name, n in AGREED.items()}
        some = [(("unary", label, digits, separators, ""), n) for (label, digits, separators), n in PRIOR.items()]
        some += [(("unary", kind, digits, separators, kind), 4) for kind, digits, separators in PRIOR if kind != OPEN]
        for key, n in [*some, *(counts or {}).items()]:
            if key[0] == "edge":
                pairs[key[1]][key[2] != "agree"] += n
            else:
                total[key[1]] += n
                for k in range(3):
                    seen[k][key[1], key[2 + k]] += n
        kinds = (6, 5, 5)  # values that a feature can have
        self.seen, self.total, self.kinds = [dict(d) for d in seen], dict(total), kinds
        self.weight = {name: float(np.clip(np.log(a / b), 0, MOST)) for name, (a, b) in pairs.items()}

    def unary(self, found: tuple[str, str, str]) -> np.ndarray:
        """Of an open mention, for each of LABELS."""
        ratio = lambda label, k: np.log((self.seen[k].get((label, found[k]), 0.0) + 0.2) / (self.total[label] + 0.2 * self.kinds[k]))
        out = np.zeros(5)
        for at, label in enumerate(KINDS, 1):
            # a corpus without other numbers of this form is no proof that there are none
            form = min(MOST_FORM, sum(ratio(label, k) - ratio(OPEN, k) for k in (0, 1)))
            out[at] = np.log(MISSED * self.total[label] / self.total[OPEN]) + form + ratio(label, 2) - ratio(OPEN, 2)
        return out


def observed(text: str) -> Iterator[tuple[str, ...]]:
    """What a text adds to the counts of Potentials."""
    base = sorted(base_spans(text))
    nodes = mentions(text, base)
    for s, e, kind in nodes:
        found = features(text, s, e)
        if kind is not None or not found[2]:  # an open mention after a word that tells is no example of none
            yield "unary", OPEN if kind is None else KINDS[kind], *found
    for i, j, name in edges(text, nodes):
        a, b = nodes[i][2], nodes[j][2]
        if a is not None and b is not None:
            yield "edge", name, "agree" if a == b else "differ"


def fit(docs: DataFrame) -> Potentials:
    """Potentials from all texts of docs; a null text adds nothing.  The counts have some hundreds of different keys, whatever the table's size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and _any(text):
                    counts.update(observed(text))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in counts], pa.list_(pa.string())), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])

    rows = docs.select("text").mapInArrow(task, "key array<string>, n bigint").groupBy("key").sum("n").collect()
    return Potentials({tuple(r[0]): r[1] for r in rows})


def crf(text: str, base: list[tuple[int, int, int]], potentials: Potentials) -> list[tuple[int, int, int]]:
    """The spans that message passing adds."""
    nodes = mentions(text, base)
    if all(kind is not None for *_, kind in nodes):
        return []
    unary = np.full((len(nodes), 5), -30.0)
    for i, (s, e, kind) in enumerate(nodes):
        if kind is None:
            unary[i] = potentials.unary(features(text, s, e))
        else:
            unary[i, 1 + kind] = 0.0
    weights: dict[tuple[int, int], float] = {}
    for i, j, name in edges(text, nodes):
        weights[i, j] = max(weights.get((i, j), 0.0), potentials.weight[name])
    belief = unary
    if weights:
        pair = np.array(list(weights))
        source, target = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([pair[:, 1], pair[:, 0]])
        reverse = np.concatenate([np.arange(len(pair)) + len(pair), np.arange(len(pair))])
        gain = np.exp(np.tile(list(weights.values()), 2)[:, None] * np.ones(5)) - 1
        message = np.zeros((len(source), 5))
        for _ in range(ROUNDS):
            out = belief[source] - message[reverse]
            out -= out.max(1, keepdims=True)
            p = np.exp(out)
            # agreement on a label, none among them, is worth its weight
            new = np.log(p.sum(1, keepdims=True) + p * gain)
            new -= new.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
            belief = unary.copy()
            np.add.at(belief, target, message)
    return [(int(p[1:].argmax()), s, e) for (s, e, kind), p in zip(nodes, _softmax(belief)) if kind is None and p[1:].max() >= THRESHOLD]


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _any(text: str) -> bool:
    """Whether a text can have a mention."""
    if "@" in text or _digit.search(text):
        return True
    lower = text.lower()
    return "at)" in lower or "at]" in lower


def find(text: str | None, potentials: Potentials | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans of a text, ordered by kind and start; without potentials by those counted beforehand."""
    if not text or not _any(text):
        return [], []
    base = sorted(base_spans(text))
    return base, sorted(base + crf(text, base, potentials or Potentials()))


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """For every row doc_id, n_ and the kind (base spans of each), base (spans of the base patterns) and spans (all), as kind:start:end lists in code points.

    potentials: from `fit`; fitted on docs if not given.  A null or empty text
    has no spans.  Spans of different kinds may overlap.  Repeated rows come
    back as often, a null doc_id stays null, an empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(potentials or fit(docs))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, known.value) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(k == kind for k, *_ in base) for base, _ in found], pa.int64()) for kind in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(s) for _, s in found], pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string")


def redact(docs: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind; all other columns as they are, n_chars (if there) made anew.

    potentials: as for `scan`.  A null text stays null, an empty one empty, and
    its n_chars null and 0; repeated rows come back as often; columns of other
    names, n_ or base among them, are kept untouched.
    """
    known = docs.sparkSession.sparkContext.broadcast(potentials or fit(docs))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mask(t, find(t, known.value)[1]) for t in batch.column("text").to_pylist()]
            columns = {name: batch.column(name) for name in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(task, docs.schema)
