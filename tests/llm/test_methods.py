"""What the operators' methods say, held against enumeration, the library or a standard; and odd tables."""

import gzip
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import bpe, linecrf, quality, warc
from dossier.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, ids string, row string, piece int, lang string, source string"


# --- op10: sums over a chain
def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(5)
    chain = linecrf.Chain()
    chain.transition = r.normal(size=(2, 2))
    potentials = [r.normal(size=(n, 2)) for n in (1, 6, 3, 0, 8)]
    for u, (got, pairs) in zip(potentials, chain.run(potentials)):
        n = len(u)
        weights = {y: math.exp(sum(u[k, y[k]] for k in range(n)) + sum(chain.transition[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(weights.values())
        expected = np.array([[sum(w for y, w in weights.items() if y[k] == label) / total for label in (0, 1)] for k in range(n)]).reshape(n, 2)
        steps = np.array([[sum(w * sum((y[k], y[k + 1]) == (a, b) for k in range(n - 1)) for y, w in weights.items()) / total for b in (0, 1)] for a in (0, 1)])
        assert np.allclose(got, expected) and np.allclose(pairs, steps if n else 0)


def test_classifier_on_odd_tables(spark):
    rows = [(i, ("good line of words here\n" * 9 if i % 2 else "!! ?? ##\n" * 5), "c", "c", 1, None, None) for i in range(60)]
    rows += [(100, None, "c", "c", 1, None, None), (101, "", "c", "c", 1, None, None), (102, " \n ", "c", "c", 1, None, None), (103, "x" * 300_000, "c", "c", 1, None, None)] + [rows[0]] * 3
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1)], "doc_id bigint, quality int")
    chain = linecrf.train(frame, labels)
    got = linecrf.score(frame, chain).collect()
    score = {x.doc_id: x.score for x in got}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in score.values())
    assert all((score[i] >= 0.5) == bool(i % 2) for i in range(60)) and score[100] == score[101] == score[102]
    assert len({x.score for x in got if x.doc_id == 0}) == 1
    none = linecrf.train(frame, labels.where("false"))
    assert {x.score for x in linecrf.score(frame, none).collect()} == {0.5}
    assert linecrf.score(frame.where("false"), chain).count() == 0


# --- op8: the path over many tasks
def test_bpe_over_many_tasks_is_the_librarys(spark):
    r = random.Random(3)
    words = ["Straße", "the", "naïve", "x", "12,500", "don't", "日本語", "é", "ﬁ", "…", " ", "A" * 40]
    long = "".join(r.choice(words) + r.choice([" ", "", "\n", "  "]) for _ in range(40_000))
    texts = [long[:150_000], long[:65_537], long[:65_536], "a" * 70_000, " " * 70_000, "日" * 66_000, long[:150_000], None, "", "short"]
    rows = [(i if i != 5 else None, t, "clash", "clash", 3, None, None) for i, t in enumerate(texts)]
    rows.append((0, texts[1], "clash", "clash", 3, None, None))  # one id, another long text
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    own = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = []
    for i, t, *_ in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), own.decode(ids, skip_special_tokens=False))]))
    got = [tuple(x) for x in bpe.encode(frame, vocabulary("word_bpe_49k.json"), outputs="digests").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert bpe.encode(frame.where("false"), vocabulary("word_bpe_49k.json")).count() == 0


# --- op4: distances
def plain_distance(p, q):
    p, q = [np.array(x) / sum(x) for x in (p, q)]
    m = (p + q) / 2
    part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_distances(spark):
    r = random.Random(1)
    pairs = [([float(r.choice([0, 1, 5, 90])) + (k == 0) for k in range(6)], [float(r.choice([0, 2, 30])) + (k == 1) for k in range(6)]) for _ in range(40)]
    got = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(pairs)], "i int, p array<double>, q array<double>").select("i", quality.js_distance(F.col("p"), F.col("q")).alias("d")).collect()
    assert all(abs(x.d - plain_distance(*pairs[x.i])) < 1e-9 for x in got)
    assert plain_distance([1, 0], [0, 1]) == 1


# --- op1: the standard's mandatory fields
def test_archives_by_the_standard(spark, tmp_path):
    rows = [(5, "http://a/ä b", "<p>é</p>", 1), (5, "http://a", "<p>é</p>", 1), (9, None, "<p>é</p>", 1), (7, "u", None, 1), (8, "v", "", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, d int").repartition(2)
    index = warc.write(pages, f"file://{tmp_path}/warc", date="2024-05-06T07:08:09Z").withColumn("page", F.lit("clash"))
    held = 0
    for file in (tmp_path / "warc").glob("*.warc.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            assert version == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
            assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and not any(k.startswith("X-") for k in fields)
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data, held = rest[size + 4 :], held + 1
    assert held == len(rows)
    got = sorted((x.page_id, x.record_type, x.refers_to, x.payload_bytes) for x in warc.read(index, f"file://{tmp_path}/warc").collect())
    assert got == [(5, "response", None, 9), (5, "response", None, 9), (7, "response", None, 0), (8, "revisit", 7, 0), (9, "revisit", 5, 9)]
    bad = index.withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception):
        warc.read(bad, f"file://{tmp_path}/warc").collect()
