"""The ten operators on small tables, against plain restatements, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dossier.llm import attention, bpe, decontaminate, jaccard, kdtree, linecrf, pii, quality, suffixes, warc
from dossier.llm.queries import vocabulary

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, row bigint"


def sample(n=60, seed=5):
    """Texts with copies, near copies, shared passages, long and odd ones; ids are not in order."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["ab", "ka", "the", "of", "Ré", "zu"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 40, 120, 300]))]
        if i % 5 == 1:
            words[10:10] = passage[r.randint(0, 20) :]
        if i % 6 == 2 and texts:
            words = (texts[-1] or "").split() or words
            words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words[:50]) + "\n" + "\t".join(words[50:]))
        if i % 9 == 0:
            texts.append(texts[-1])
    texts += [None, "", " \n\t ", "one", "x" * 5000, "one", " ".join(passage * 30), "so " * 3000, "and so " + "so " * 700]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = sample()
    rows.append(rows[3])  # a repeated row
    frame = spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", 1, "clash", 9) for i, t in rows], SCHEMA).repartition(3).persist()
    yield rows, frame
    frame.unpersist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_components(docs, empty):
    rows, frame = docs
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    component = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
    got = jaccard.join(frame, 4, 85).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), component[i]) for i in sets}
    assert jaccard.join(empty).count() == 0


def test_jaccard_blocks(docs, monkeypatch):
    rows, frame = docs
    expected = {(r.doc_id, r.component_id) for r in jaccard.join(frame, 4, 85).collect()}
    monkeypatch.setattr(jaccard, "SHORT_LIST", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "CENTRE_ROUNDS", 1)
    assert {(r.doc_id, r.component_id) for r in jaccard.join(frame, 4, 85).collect()} == expected


def test_decontamination(docs, empty, spark):
    rows, frame = docs
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    long_ = next(t for i, t in rows if t and len(t.split()) > 200).split()
    items = [(1, " ".join(long_[20:45])), (2, "ONE"), (3, None), (4, ""), (10, "never, ever seen"), (5, " ".join(long_[20:32]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = split.findall((t or "").translate(FOLD))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    expected = set()
    for i, t in rows:
        w, hit, found = split.findall((t or "").translate(FOLD)), set(), set()
        for window, names in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= names
        expected.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    got = decontaminate.report(frame, bench, 10).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == expected
    assert any(e[-1] for e in expected) and not all(e[-1] for e in expected)
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(frame, bench.where("false")).where("contaminated").count() == 0


def test_substring_dedup(docs, empty):
    rows, frame = docs
    words, first = {i: WORDS.findall(t or "") for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    expected = set()
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        expected.add((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    for group in (suffixes.GROUP, 4):  # prefixes of some words only, and such of up to the whole window
        got = suffixes.dedup(frame, 13, group).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == expected
    assert suffixes.dedup(empty, 13).count() == 0


def test_warc(spark):
    pages = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c\r\nX: y", None), (4, "u", ""), (5, "v", "long " * 50_000), (None, "w", "x")]
    frame = spark.createDataFrame([(*p, 7) for p in pages], "page_id bigint, url string, html string, length int")
    got = {r.page_id: r for r in warc.roundtrip(frame).collect()}
    for i, url, html in pages:
        payload = (html or "").encode()
        assert got[i].payload_bytes == len(payload) and got[i].payload_digest == warc.digest32(payload) and got[i].url == url
    assert got[2].record_type == "revisit" and got[2].refers_to == 1 and got[4].refers_to == 3 and got[1].record_type == "response"
    assert bytes(got[5].payload) == b"long " * 50_000
    assert warc.roundtrip(frame.where("false")).count() == 0
    assert [g[:2] for g in warc.ranges([(0, 10), (10, 5), (10**6, 3)])] == [(0, 15), (10**6, 10**6 + 3)]


def test_pii_chain(spark, empty):
    text = "Call +1 (743) 555-3824 or (743) 555-3824; a.b@x.org, a.b [at] x [dot] org. 10.0.0.256; 10.0.0.25; 4111 1111 1111 1111"
    base, spans = pii.find(text)
    named = [(pii.KINDS[k], text[s:e]) for k, s, e in base]
    assert named == [("email", "a.b@x.org"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert {text[s:e] for k, s, e in set(spans) - set(base)} == {"(743) 555-3824", "a.b [at] x [dot] org"}
    # the same mentions by themselves are left alone, a word before may tell
    assert pii.find("the (743) 555-3824 alone")[1] == [] and pii.find("of 10.0.0.256 is")[1] == [] and pii.find(None) == ([], [])
    assert [k for k, *_ in pii.find("Email: JOHN (AT) EXAMPLE (DOT) COM")[1]] == [0]
    card = "paid by 4111111111111111 and then, many words later, by 4111111111111112"
    assert {card[s:e] for _, s, e in pii.find(card)[1]} == {"4111111111111111", "4111111111111112"} and pii.find("number 4111111111111112 " * 5)[1] == []
    frame = spark.createDataFrame([(1, text, 5, "x"), (2, None, None, "y"), (3, "", 0, None), (None, card, 1, "z"), (1, text, 5, "x")], "doc_id bigint, text string, n_chars bigint, base string")
    got = {r.doc_id: r for r in pii.redact(frame).collect()}
    assert "555" not in got[1].text and got[1].n_chars == len(got[1].text) and got[2].text is None and got[2].base == "y" and "4111" not in got[None].text
    assert pii.scan(frame).count() == 5 and pii.scan(frame.where("false")).count() == 0 and pii.scan(empty).count() == 0
    assert pii.fit(frame.where("false")).weight == pii.Potentials().weight


def test_pii_potentials_are_fitted(spark):
    """Weights follow what the corpus shows, and are the same however its rows are dealt."""
    pairs = [(i, f"first 4111 1111 1111 1111 then 5500 0000 0000 0004 at {i}") for i in range(30)]
    mixed = [(i, f"mail u{i}@x.org 10.0.0.{i} card 4111111111111111") for i in range(30)]
    weights = [pii.fit(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)).weight for rows in (pairs, mixed) for n in (1, 3)]
    assert weights[0] == weights[1] and weights[2] == weights[3]
    assert weights[0]["alike"] > weights[2]["alike"] and weights[0]["near"] > weights[2]["near"] == 0


def plain_base(text):
    """The contract's base patterns, by plain expressions."""
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


def test_pii_base_spans():
    r = random.Random(3)
    pool = ["a", "b.c", "@", "x", ".", "org", "1", "23", "256", "4111 1111 1111 1111", "+", "49", " ", "-", "(", ")", "\n", "é", "٣", "5500-0000-0000-0004", "10.0.0.1", "%", "+1 (743) 555-3824"]
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(1, 25)))
        assert [(pii.KINDS[k], s, e) for k, s, e in sorted(pii.base_spans(text))] == plain_base(text)


def test_quality_counts_and_verdict(docs, empty, spark):
    rows, frame = docs
    for r in quality.assess(frame).collect():
        text = next(t for i, t in rows if i == r.doc_id) or ""
        w = WORDS.findall(text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        repeated = len({k + j for k, g in enumerate(grams) if g in twice for j in range(3)})
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 50 or 100 * repeated > 50 * len(w))
    assert quality.assess(empty).count() == 0
    clean = [(i, " ".join(w for k in range(75) for w in (random.Random(97 * i + k).choice(["the", "of", "and", "to", "in"]), "".join(random.Random(31 * i + k).choice("abcdefghij") for _ in range(6)))) + ".", "en") for i in range(40)]
    noisy = [(99, " ".join(f"x{k}### $$|" for k in range(150)), "en")]
    got = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(clean + noisy, "doc_id bigint, text string, lang string")).select("doc_id", "kept").collect()}
    assert not got[99] and sum(got[i] for i in range(40)) == sum(not r.base_failed for r in quality.assess(spark.createDataFrame(clean, "doc_id bigint, text string, lang string")).collect())


def test_kd_tree(docs, empty, spark):
    rows, frame = docs
    texts = dict(rows)
    copies = [(5000 + k, "a copy " * (20 + k // 2), "en" if k % 3 else "de", "s", 1, "clash", 9) for k in range(40)]  # pairs with other metadata
    texts |= {c[0]: c[1] for c in copies}
    got = kdtree.shard(frame.unionByName(spark.createDataFrame(copies, SCHEMA)), leaves=4).collect()
    assert len(got) == len(rows) + len(copies)
    sizes, slots, shards, group = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in got:
        text = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
        sizes[r.shard] += r["size"]
        group[text] += r["size"]
        slots[r.shard].append(r.slot)
        shards[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) == {0, 1, 2, 3}
    assert all(len(s) == 1 for s in shards.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(group.values())
    assert kdtree.shard(empty, leaves=4).count() == 0


def test_kd_tree_cuts_only_groups_heavier_than_a_leaf(spark):
    rows = [(i, "one text " * 50) for i in range(300)] + [(1000 + i, f"text {i} " * 50) for i in range(100)]
    got = kdtree.shard(spark.createDataFrame(rows + rows[:1], "doc_id bigint, text string"), leaves=4).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 4 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert len({r.shard for r in got if r.doc_id == rows[0][0]}) == 1


BPE_POOL = ["the", "’s", "'re", "'s", "''", "x1", "é", "e\u0301", "漢字", "かな", "한", "\u1112\u1161\u11ab", "İ", "ΑΣ", "<|endoftext|>", "<|start", "oftext|>", " ", "  ", "\n", "a", "th", "123", "\u0316\u0301", "\U0001f600", "का", "\x85", "\x1c", "ß", "!!", "　", "ﬁ"]


def odd_texts(n, length, seed):
    r = random.Random(seed)
    for _ in range(n):
        some = r.sample(BPE_POOL, r.randint(1, 12))
        yield "".join(r.choice(some) for _ in range(r.randint(10, length)))


def test_bpe_joins_are_exact(monkeypatch):
    encoder = bpe.Encoder.get(vocabulary("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "LEAF", 40)
    monkeypatch.setattr(bpe, "FIRST_WINDOW", 8)
    texts = [*odd_texts(1500, 200, 1), "a" * 3000, "漢字" * 900, "e" + "\u0301" * 500, ""]
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder.ids(t) for t in texts] == expected
    # without the windows the torn tokens stay: it is they that give the result
    monkeypatch.setattr(bpe.Encoder, "join", lambda self, pairs: [bpe.Part(a.start, b.end, a.chunks + b.chunks) for _, a, b in pairs])
    assert [encoder.ids(t) for t in texts] != expected


@pytest.mark.parametrize("frequent", [8, 1 << 18])
def test_lm_base_scores(docs, empty, monkeypatch, frequent):
    rows, frame = docs
    monkeypatch.setattr(attention, "FREQUENT", frequent)
    monkeypatch.setattr(attention, "EPOCHS", 1)
    training = frame.where("doc_id % 7 <> 2").dropDuplicates(["doc_id"])
    tokens = {i: WORDS.findall((t or "").translate(FOLD)) + [None] for i, t in rows}
    count = Counter(w for i, w_ in tokens.items() if i % 7 != 2 for w in w_)
    n, v = sum(count.values()), len(count)
    got = attention.score(frame, training).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert -math.inf < r.score < 0
    assert attention.score(empty, empty).count() == 0


def test_lm_subwords_spell_their_words():
    import numpy as np
    import pyarrow as pa

    block = next(attention.blocks(pa.array(["The theory, Ünd x", None, "the " + "abcdefghij" * 30]), attention.WHITE, True))
    key = attention.word_keys(block)
    pieces = np.sort(attention.word_keys(next(attention.blocks(pa.array(["the ory abc"]), attention.WHITE, True))))
    subs = attention.Table(np.sort(key[3:4]), pieces)
    whole = np.arange(len(key)) == 3
    ids, bounds = subs.subwords(block, np.zeros(len(key), np.int64), whole)
    keys = np.concatenate([subs.words, subs.spelt, [0]])[ids]
    spelt = [b"x" if i == 0 else int(k & ((1 << 48) - 1)).to_bytes(6, "little")[: int(k >> 48) & 7] for i, k in zip(ids, keys) if i != subs.end]
    assert b"".join(spelt) == b"thetheory,\xc3\x9cndxthe" + b"abcdefghij" * 30
    assert spelt[:4] == [b"the", b"the", b"ory", b","] and (ids[bounds[1:] - 1] == subs.end).all() and bounds[2] == bounds[1] + 1


def test_lm_beats_counted_words(spark):
    """On texts of two made-up languages that were not learnt from, the model gives a token more than its count does."""
    r = random.Random(4)
    languages = [["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(300)] for letters in ("abcde", "vwxyz")]
    rows = [(i, " ".join(r.choices(languages[i % 2], weights=[1 / (k + 3) for k in range(300)], k=120))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = attention.score(frame, frame.where("doc_id % 7 <> 2")).where("doc_id % 7 = 2").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.95 * got["sum(base_score)"]


def test_attention_gradients():
    import numpy as np

    r = np.random.default_rng(1)
    model = attention.Model.new(np.full(attention.CLASSES, 1 / attention.CLASSES))
    x, y = r.integers(0, attention.ROWS, (3, attention.WIDTH)), r.integers(-1, attention.CLASSES, (3, attention.STRIDE))
    model.p = {k: z.astype(np.float64) for k, z in model.p.items()}
    loss, grads = model.step(x, y)
    for name in ("q", "v", "o", "near", "b"):
        at = tuple(0 for _ in model.p[name].shape)
        model.p[name][at] += 1e-4
        up = model.step(x, y)[0]
        model.p[name][at] -= 2e-4
        down = model.step(x, y)[0]
        model.p[name][at] += 1e-4
        assert math.isclose((up - down) / 2e-4, grads[name][at], rel_tol=0.05, abs_tol=1e-5)


def test_line_crf(spark, empty):
    r = random.Random(2)
    good = lambda: "\n".join(" ".join(r.choice(["river", "stone", "The", "of", "walks"]) for _ in range(12)) + "." for _ in range(5))
    bad = lambda: "\n".join("## $$ x " * 8 for _ in range(5))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(80)] + [(900, None, 1), (901, "", 0)]
    docs, labels = spark.createDataFrame([r_[:2] for r_ in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows if i < 40], "doc_id bigint, quality int")
    chain = linecrf.train(docs, labels)
    got = {x.doc_id: x.score for x in linecrf.score(docs, chain).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if 40 <= i < 900) and 0 <= got[900] <= 1 and 0 <= got[901] <= 1
    assert linecrf.score(docs, linecrf.train(docs, labels.where("false"))).where("score <> 0.5").where("doc_id < 900").count() == 0
    assert linecrf.score(empty, chain).count() == 0
