"""The whole pipeline over the smallest tables against a plain restatement of its stages; and odd tables."""

import re
from pathlib import Path

import duckdb
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from dossier.llm import pii, queries

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORDS.findall(text.translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_rows_of_run(spark):
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    texts = dict(c.sql("select doc_id, text from documents").fetchall())
    kept = {i for i, ok in c.sql(f"select doc_id, kept from ({queries.ORACLE_SQL['op4_quality_rules']})").fetchall() if ok}
    sets = {i: shingles(texts[i]) for i in kept}
    first = {i: i for i in kept}
    changed = True
    pairs = [(a, b) for a in kept for b in kept if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            least = min(first[a], first[b])
            changed |= first[a] != least or first[b] != least
            first[a] = first[b] = least
    single = {i for i in kept if first[i] == i}
    windows = set()
    for (text,) in c.sql("select text from benchmark").fetchall():
        w = LETTERS.findall((text or "").translate(FOLD))
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}
    held = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    clean = {i for i in single if not held(LETTERS.findall(texts[i].translate(FOLD)))}
    assert 0 < len(clean) < len(single) < len(kept) < len(texts)

    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert set(got) == clean
    own = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    masked = 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(sorted(clean)))
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, r in got.items():
        ids = own.encode(redacted[i], add_special_tokens=False).ids
        masked += redacted[i] != texts[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == own.decode(ids, skip_special_tokens=False)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", redacted[i])
    assert 0 < masked < len(got)


def test_stages_on_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, kept boolean, component_id bigint, contaminated boolean, stays string"
    body = " ".join(f"word{i % 97} and the of" for i in range(120))
    rows = [(1, body, "en", "s", 1), (1, body, "en", "s", 1), (2, body + " more", None, None, None), (3, None, "en", "s", None), (None, "short", "en", None, 1), (4, "", None, "s", 0), (5, "x" * 100_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "k", True, 9, False, "s") for r in rows], schema)
    for table in (docs, docs.where("false")):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns, name
            got = sorted((r.doc_id or -1, (r.text or "")[:9]) for r in out.collect())
            if table is not docs:
                assert not got
            elif name == "near_duplicates":  # the repeated row and the near copy go
                assert [i for i, _ in got] == [-1, 1, 3, 4, 5]
            elif name in ("benchmark_decontamination", "private_data"):
                assert len(got) == len(rows)
            else:  # null, empty and short texts fail the base
                assert {i for i, _ in got} <= {1, 2}
        assert P.STAGES[-1][1](spark, table, SF).count() == table.count()
