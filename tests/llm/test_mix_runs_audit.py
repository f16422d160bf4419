"""Mixing, periodic runs and the divergence audit on small tables, against plain restatements, and the runs over a whole table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from dossier.llm import divergence, mixing, queries, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, place bigint, weight string, term string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def plain_runs(w, least=24, periods=3):
    best, n = {}, len(w)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


# --- periodic runs
@pytest.mark.parametrize("least, periods", [(24, 3), (6, 3), (4, 2), (1, 2), (24, 2), (9, 4)])
def test_runs_as_by_all_periods(least, periods):
    r = random.Random(least + periods)
    found = 0
    for _ in range(60):
        n, k = r.randint(0, 120), r.choice([1, 2, 3, 5, 50])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            a, p = r.randrange(max(1, n)), r.randint(1, 14)
            for i in range(a, min(n, a + r.randint(1, 90))):
                w[i] = w[a + (i - a) % p]
        expected = plain_runs(w, least, periods)
        found += len(expected)
        assert runs.find_runs(w, least, periods) == expected
    assert found > 10
    with pytest.raises(ValueError):
        runs.find_runs(["a"] * 30, 5, 1)


def test_z_function():
    r = random.Random(3)
    for _ in range(50):
        s = [r.randrange(2) for _ in range(r.randint(0, 40))]
        expected = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs.z_function(s) == expected and runs.z_function(s, 5) == expected[:5]


def test_runs_of_odd_texts(spark):
    many = " ".join(f"w{i % 40000}" for i in range(130000))  # one very long text of one long period
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "so " * 24), (5, "so " * 23), (6, "a b\tc\n" * 8 + "a b"), (6, "a b\tc\n" * 8 + "a b"), (None, "x " * 30), (7, many), (8, "ä\u00a0ö " * 30 + "\u2003 ende")]
    got = defaultdict(list)
    for r in runs.detect(table(spark, [(i, t, "en", "s") for i, t in rows])).collect():
        got[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[4] == [(24, [(0, 24, 1)], "so")] and got[5] == [(23, [], " ".join(["so"] * 23))]
    assert got[6] == [(26, [(0, 26, 3)], "a b c")] * 2 and got[None] == [(30, [(0, 30, 1)], "x")]
    assert got[7] == [(130000, [(0, 130000, 40000)], " ".join(f"w{i}" for i in range(40000)))]
    assert got[8] == [(32, [(0, 30, 1)], "ä\u00a0ö \u2003 ende")]  # only ASCII white space parts words
    assert runs.detect(table(spark, [])).count() == 0


def test_runs_query(spark):
    """The whole smallest table against the contract restated plainly."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    planted = 0
    for r in got:
        w, h = WORDS.findall(texts[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [*w[:a], *[w[a + (i - a) % p] for i in range(a, len(w))]]
        expected = plain_runs(w)
        best = min(expected, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        dropped = {i for s, n, q in expected for i in range(s + q, s + n)}
        planted += bool(expected)
        assert r.n_runs == len(expected) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in expected).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest()
    assert planted > 5


# --- mixing
def plain_targets(size, weight, epochs):
    """Exact water-filling in fractions."""
    total, clamped = sum(size.values()), set()
    while True:
        rest = [s for s in size if s not in clamped]
        level = Fraction(total - sum(epochs * size[s] for s in clamped), sum(weight[s] for s in rest)) if rest else Fraction(0)
        more = {s for s in rest if epochs * size[s] <= weight[s] * level}
        if not more:
            return {s: min(Fraction(epochs * size[s]), weight[s] * level) if s in rest else Fraction(epochs * size[s]) for s in size}
        clamped |= more


@pytest.mark.parametrize("bins, few", [(12, 100_000), (1, 0)])
def test_mixing(spark, monkeypatch, bins, few):
    monkeypatch.setattr(mixing, "BIN_BITS", bins)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    r = random.Random(bins)
    rows = [(i, "w " * r.choice([0, 1, 5, 40, 300]), "en", r.choice(["a", "a", "a", "B", "é", "z", None, ""])) for i in range(300)]
    rows += [(1000, None, "en", "only null"), (1001, "x\ty z", "en", "tiny"), (1002, "w " * 5000, "en", "a")]
    rows += [rows[5]] * 3 + [(None, "one two", "en", None)]
    got = mixing.mix(table(spark, rows)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(table(spark, rows).repartition(7)).collect()))
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(WORDS.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target = plain_targets(size, weight, 3)
    assert len(got) == len(rows) and any(target[s] == 3 * size[s] > 0 for s in size) and any(0 < target[s] < 3 * size[s] for s in size)
    taken = Counter()
    for x in got:
        assert x.source_size == size[x.source] and abs(x.target - target[x.source]) < 1e-6 and 0 <= x.taken <= 3 * x["size"]
        taken[x.source] += x.taken
        assert x["size"] == 0 or abs(x.repetitions * x["size"] - x.taken) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 4 for s in size)
    assert len({(x.taken) for x in got if x.doc_id == rows[5][0]}) == 1


def test_mixing_edges(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    none = mixing.mix(table(spark, [(1, None, None, None), (2, " ", None, "s")])).collect()
    assert [(x["size"], x.source_size, x.target, x.taken) for x in none] == [(0, 0, 0.0, 0)] * 2
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(40)]
    given = spark.createDataFrame([("a", 1), ("c", 5)], "source string, weight int")
    got = mixing.mix(table(spark, rows), given, max_epochs=2).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    assert {x.source: x.t for x in got} == {"a": 400, "b": 0}
    one = {(x.doc_id, x.taken) for x in mixing.mix(table(spark, [*rows, *[(100 + i, "w " * 10, "en", "c") for i in range(30)]]), seed=1).collect()}
    other = {(x.doc_id, x.taken) for x in mixing.mix(table(spark, [*rows, *[(100 + i, "w " * 10, "en", "c") for i in range(30)]]), seed=2).collect()}
    assert one != other


# --- divergence audit
def plain_audit(rows, least, top):
    seen, count, groups = defaultdict(lambda: defaultdict(int)), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(FOLD) for t in TERMS.findall(text or "")]
        groups.add((lang, source))
        count[lang, source].update(terms)
        for t in set(terms):
            seen[lang][t] += 1
    out = []

    def shares(counts, kept):
        total = sum(counts[t] for t in kept)
        return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        whole = shares(sum((count[lang, s] for s in sources), Counter()), kept)
        own = {s: shares(count[lang, s], kept) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, own[s][t] - whole[t]) for t in kept if count[lang, s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_audit(spark):
    r = random.Random(8)
    words = [*(f"{a}{b}" for a in ("Ka", "ré", "É", "zu", "the") for b in ("n", "M", "ß", "")), "a'b", "x1y", "日本"]
    rows = [(i, " ".join(r.choice(words[: r.choice([4, 12, 23])]) for _ in range(r.choice([0, 5, 60]))), r.choice(["en", "en", "fr", None, ""]), r.choice(["s1", "S2", "é", None, "s10"])) for i in range(160)]
    rows += [(900, None, "en", "empty"), (901, "rare words", "xx", "b"), (902, "123 456", "xx", "a"), (903, "alone", "yy", "z")]
    rows += [rows[0]] * 4 + [(904, "Kan " * 20000 + "ÉM", "fr", "s1")]
    for least, top in ((8, 5), (1, 50), (10**6, 50)):
        got = divergence.audit(table(spark, rows), least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, least, top)
    assert divergence.audit(table(spark, [])).count() == 0


def test_shares_do_not_overflow(spark):
    wide = spark.createDataFrame([(9 * 10**17, 9 * 10**17, 1), (0, 10**18, 10**6)], "n bigint, total bigint, terms bigint")
    got = [x.p for x in wide.select(divergence.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()]
    assert got == [1 + 10**9 * (9 * 10**17 + 5) // (9 * 10**17 + 5), 1 + 10**9 * 5 // (10**18 + 5 * 10**6)]
