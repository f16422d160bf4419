"""The ten registered queries over whole tables: against SQL, or the contract restated plainly."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from dossier.llm import queries
from test_llm_operators import FOLD, WORDS, plain_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("select doc_id, text from documents").fetchall()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, spark, duck):
    expected = duck.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*expected.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall())) and len(got) > 0


def test_pii(spark, texts):
    got = queries.op2_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id])
        listed = [f"{k}:{s}:{e}" for k, s, e in base]
        n = Counter(k for k, *_ in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [n[k] for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(","))


def test_quality_rules(spark, texts):
    got = queries.op4_quality_rules(spark, SF).collect()
    assert len(got) == len(texts) and 0 < sum(r.kept for r in got) < len(got)
    for r in got:
        text = texts[r.doc_id]
        w = WORDS.findall(text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        repeated = len({k + j for k, g in enumerate(grams) if g in twice for j in range(3)})
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 50 or 100 * repeated > 50 * len(w)) and not (r.base_failed and r.kept)


def test_sharding(spark, texts):
    got = queries.op6_kd_tree(spark, SF).collect()
    assert len(got) == len(texts)
    sizes, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of_text[raw].add(r.shard)
    assert set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values()) and max(sizes.values()) < 1.6 * min(sizes.values())


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = queries.op8_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode(texts[r.doc_id], add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), own.decode(ids, skip_special_tokens=False))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *digests]


def test_lm_scores(spark, texts):
    got = queries.op9_lm_scoring(spark, SF).collect()
    tokens = {i: [*WORDS.findall(t.translate(FOLD)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    assert len(got) == len(texts)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9) and -math.inf < r.score < 0


def test_classifier(spark, duck, texts):
    got = queries.op10_quality_classifier(spark, SF).collect()
    labels = dict(duck.sql("select doc_id, quality from labels").fetchall())
    assert len(got) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    judged = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert sum(judged) >= 0.95 * len(judged) > 0
