"""Whole jobs of the training-data operators: texts that earlier rounds left out."""

import time

import numpy as np
import pyarrow as pa

from dossier.llm import attention, decontaminate, pii
from dossier.llm.words import WHITE, blocks


def test_attention_learns_from_all_texts(spark, monkeypatch):
    """From a text of over a million bytes, and with several shards from texts of all rounds."""
    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = attention.score(rows(["ab cd ef " * 20]), rows(["ab cd ef " * 120_000])).first()
    assert got.score / got.n_tokens > -0.3
    monkeypatch.setattr(attention, "SHARD_BYTES", 20_000)
    got = attention.score(rows(["ab cd ef " * 20]), rows(["ab cd ef " * 200] * 60)).first()
    assert got.score / got.n_tokens > -1


def test_spelt_addresses_in_capitals(spark):
    text = "Email: JOHN (AT) EXAMPLE (DOT) COM"
    assert pii.find(text)[1] == pii.find(text.lower())[1] == [(0, 7, len(text))]
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pii.redact(rows).first().text == "Email: [EMAIL]" and pii.scan(rows).first().spans == f"email:7:{len(text)}"


def test_pieces_spell_the_other_words(spark):
    """Pieces of words in the table are not counted, those of all others are."""
    rare = [f"{chr(97 + i % 26)}{i}z" for i in range(5000)]
    rows = spark.createDataFrame([(1, "often " * 5 + " ".join(rare))], "doc_id bigint, text string")
    (often,) = [attention.word_keys(block) for block in blocks(pa.array(["often"]), WHITE, True)]
    for words in (often, often[:0]):
        subs = attention.Table(words, np.empty(0, np.int64))
        n = attention.subword_counts(rows, subs, np.empty(0, np.int64), np.empty(0, np.int64)).sum(1)
        assert n[-1] == 1 and n.sum() == 1 + sum(map(len, rare)) + (5 if len(words) else 25)


def test_near_matches_past_repeated_words(spark):
    """Places (5, 1), (6, 2), (7, 2), (8, 3) have three offsets within slop, but no three neighbours have; and a short item."""
    words = ["pad"] * 12
    for diagonal, offset in ((5, 0), (6, 1), (7, 1), (8, 2)):
        words[diagonal + offset] = ["alpha", "beta", "gamma"][offset]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "alpha pad pad pad pad pad pad gamma beta"), (3, "delta pad epsilon")], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, "alpha beta gamma"), (11, "delta epsilon")], "item_id bigint, text string")
    got = {r.doc_id: (r.items, r.near) for r in decontaminate.search(docs, items, 3, 3).collect()}
    assert got == {1: ([], [10]), 2: ([], []), 3: ([], [11])}


def test_attention_fits_all_sizes_one_way(spark, monkeypatch):
    """What is fitted depends on the texts and the number of shards, not on which side of a shard's size their bytes lie."""
    rows = spark.createDataFrame([(i, f"ab cd ef gh{i % 3} " * 40) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    got = []
    for n in (1 << 24, rows.selectExpr("sum(octet_length(text))").first()[0] - 1):
        monkeypatch.setattr(attention, "SHARD_BYTES", n)
        got.append([r.score for r in attention.score(rows, rows).orderBy("doc_id").collect()])
    assert np.allclose(got[0], got[1], rtol=1e-6)


def test_places_by_hash():
    """Lookups by hash find what a search finds, keys that share a slot included."""
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 20_000):
        keys = np.unique(r.integers(-(1 << 63), (1 << 63) - 1, n))
        wanted = np.concatenate([keys, r.integers(-(1 << 63), (1 << 63) - 1, 500), np.zeros(1, np.int64)])
        places = attention.Places(keys)
        (at, there), (at_too, there_too) = places.find(wanted), attention.find(keys, wanted)
        assert (there == there_too).all() and (at[there] == at_too[there]).all() and there[: len(keys)].all()
    assert places.shared.any()


def test_scores_are_those_of_the_plain_model():
    """Tables, reused arrays and products over all windows change nothing: scores and losses are those of a softmax window by window."""
    r = np.random.default_rng(5)
    model = attention.Model.new(r.dirichlet(np.ones(attention.CLASSES)))
    model.p = {k: (v + 0.4 * r.standard_normal(v.shape)).astype(np.float32) for k, v in model.p.items()}
    x, y = r.integers(3, attention.ROWS, (150, attention.WIDTH)), r.integers(0, attention.CLASSES, (150, attention.STRIDE))
    x[::5, : attention.STRIDE], x[::5, attention.STRIDE], x[2::5, 27:], y[2::5, 11:] = attention.PAD, attention.BEGIN, attention.PAD, -1
    p, want = {k: v.astype(float) for k, v in model.p.items()}, np.zeros(y.shape)
    for i, row in enumerate(x):
        for j in range(attention.STRIDE):
            seen = [c for c in range(attention.STRIDE + j + 1) if row[c] != attention.PAD]
            if y[i, j] >= 0:
                own, e = p["e"][row[attention.STRIDE + j]], p["e"][row[seen]]
                a = np.exp((e @ p["k"]) @ (own @ p["q"]) / attention.DEPTH**0.5 + p["near"][attention.STRIDE + j - np.array(seen)])
                logits = a @ (e @ p["v"]) / a.sum() @ p["o"] + own @ p["h"] + p["b"]
                want[i, j] = logits[y[i, j]] - np.log(np.exp(logits).sum())
    got = model.log10(x, y, model.tables()) * np.log(10)
    assert np.allclose(got[y >= 0], want[y >= 0], atol=1e-4)
    assert np.isclose(model.step(x, y)[0], -want[y >= 0].mean(), atol=1e-4)
    assert model.log10(x[:7], y[:7], model.tables()).tolist() == model.log10(x, y, model.tables(), 7)[:7].tolist()
    fitted = attention.Fit(model, 0.01)
    first = model.step(x, y)[0]
    fitted.run(x, y)
    assert model.step(x, y)[0] < first and all(np.shares_memory(z, fitted.all) for z in model.p.values())


def test_short_words_are_packed_at_once():
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def byte_by_byte(block):
        length = block.end - block.start
        out = length.astype(np.int64) << 48
        for k in range(attention.SHORT):
            out |= np.where(length > k, lower[block.data[np.minimum(block.start + k, len(block.data) - 1)]], 0).astype(np.int64) << (8 * k)
        return out

    (block,) = blocks(pa.array(["Ab cde FGHIJ é zzzzzz " * 8_000, None, "x", "Zz9"]), WHITE, True)
    took = {byte_by_byte: [], attention.word_keys: []}
    for _ in range(7):
        for f, seconds in took.items():
            start = time.process_time()
            f(block)
            seconds.append(time.process_time() - start)
    assert (attention.word_keys(block) == byte_by_byte(block)).all()
    assert min(took[attention.word_keys]) < 0.7 * min(took[byte_by_byte])
