"""Whole jobs: rows and texts that earlier rounds left out."""

import difflib
import random

import numpy as np

from dossier.operators import graph, matching, retrieval
from dossier.plans import registry

SF = "/root/testdata/sf0.001"


def test_matching_is_difflib():
    r = random.Random(1)
    pairs = [("", ""), (None, "a"), ("a" * 900, "a" * 1300)]
    for _ in range(300):
        letters = r.choice(["a", "ab", "abcdefgh", "the of and \n金😀"])
        a, b = ("".join(r.choice(letters) for _ in range(r.choice([0, 3, 40, 150]))) for _ in range(2))
        pairs.append((a, r.choice([b, a, a[::-1], a[:30] + "x" + a[20:], a * 2])))
    expected = [difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in pairs]
    assert matching.ratios(pairs) == matching.ratios(pairs, 500) == expected


def test_shared_keys_are_numbered_by_one_sort():
    r = np.random.default_rng(5)
    for high in (12, 1 << 40, 1 << 62):  # small keys, and such as do not fit beside their places
        key = r.integers(0, 12, 300) * (high // 12)
        left = r.random(300) < 0.3
        some, number = matching._shared(key, left)
        both = sorted(set(key[left].tolist()) & set(key[~left].tolist()))
        assert some.tolist() == [k in both for k in key.tolist()] and number.tolist() == [both.index(k) for k in key[some].tolist()]
    assert [len(x) for x in matching._shared(np.empty(0, np.int64), np.empty(0, bool))] == [0, 0]


def test_disagreement_of_all_pairs(spark, tmp_path):
    texts = ["Amount 500,000 yuan", "x" * 700 + "the quick brown fox 12 " * 5, "the quick red fox 13 " * 60, "", "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.ratio for r in registry.QUERIES["disagreement_ratio"](spark, str(tmp_path)).collect()}
    norm = [t.replace(" ", "").replace("500,000", "500000") for t in texts]
    assert got == {i: round(1 - difflib.SequenceMatcher(None, norm[i], norm[i + 1], autojunk=False).ratio(), 4) for i in range(4)}


def test_closures_of_all_orders(spark):
    keys = {r.l_orderkey for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    assert max(keys) > 400
    got = [tuple(r) for r in registry.QUERIES["closure_check"](spark, SF).collect()]
    assert sorted(got) == sorted((k, "unparsable" if k % 5 == 0 else "mismatch") for k in keys if k % 3 == 0 or k % 5 == 0)


def test_links_of_all_customers(spark, tmp_path):
    """Customers above the old bounds of 300 and 500 have dead links and neighbours too."""
    for name in ("nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    customers = [(k, 3 if k >= 598 else 24) for k in (1, 2, 400, 598, 600)]
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    expected = {(f"c{k}", f"n{n + k % 4}") for k, n in customers if n + k % 4 > 24} | {(f"c{k}", f"Region {k % 7}") for k, _ in customers if k % 7 > 4}
    assert {(r.page, r.target) for r in run("dead_links")} == expected and any(page == "c600" for page, _ in expected)
    assert {r.stem for r in run("graph_neighbors")} >= {"c598", "c600"}


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "src string, dst string").coalesce(1)
    assert graph.shortest_path(edges, "n0", "n70").first().hops == 70


def test_whole_parents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").orderBy("doc_id").collect()
    first = {}
    for r in docs:
        first.setdefault((r.source, r.doc_id % 4), r.text)
    got = registry.QUERIES["hybrid_with_parents"](spark, SF).collect()
    assert got and all(r.parent_text == first[r.source, r.parent_ord] for r in got)
    assert {r.parent_ord for r in got} == {0, 1, 2, 3} and max(len(r.parent_text) for r in got) > 40
    hits = spark.createDataFrame([("s", 1, 0), ("s", 2, 9)], "source string, ord int, parent_ord int")
    parents = spark.createDataFrame([("s", 0, "x" * 100)], "source string, parent_ord int, text string")
    assert {r.ord: r.parent_text for r in retrieval.attach_parents(hits, parents).collect()} == {1: "x" * 100, 2: None}
