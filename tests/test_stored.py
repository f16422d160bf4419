"""Segmented postings, neighbours of many queries and word segmentation, against plain restatements."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import neighbours, retrieval, segmentation, segments
from dossier.plans import stored
from dossier.sources.commits import Taken

SF = "/root/testdata/sf0.001"


def chunks(spark, rows):
    return spark.createDataFrame(rows, "source string, ord int, text string")


def some_rows(n, seed):
    """Chunks of very different lengths, with ties, repeats of texts and empty ones."""
    r = random.Random(seed)
    words = ["river", "stone", "law", "contract", "the", "the", "the", "of", "of", "1999"]
    rows = [(f"s{r.randrange(6)}", seed * 10**6 + i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 8, 40, 200])))) for i in range(n)]
    return rows + [(f"s{i}", seed * 10**6 + n + i, rows[0][2]) for i in range(4)] + [("none", seed * 10**6 + n + 9, "")]


def same_hits(spark, path, rows, queries=(("stone law OF", 30),), **k):
    table = chunks(spark, rows)
    for query, most in queries:
        expected = [tuple(r) for r in retrieval.text_search(table, query, most, **k).select("source", "ord", "score").collect()]
        assert [tuple(r) for r in segments.search(spark, path, query, most, **k).collect()] == expected


# --- segmented postings
def test_segments_give_what_a_new_index_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    monkeypatch.setattr(segments, "FIRST", 3)
    path = f"file://{tmp_path}/index"
    assert segments.search(spark, path, "river").count() == 0
    one, two, three = some_rows(120, 1), some_rows(40, 2), some_rows(30, 3)
    assert segments.add(chunks(spark, one), path) == 1
    same_hits(spark, path, one, (("1999", 3), ("absent", 5)))
    assert segments.add(chunks(spark, two), path) == 2
    same_hits(spark, path, one + two, prefix="s1")
    # a source of both segments is replaced: two of its keys come back with other texts
    gone = [r for r in one + two if r[0] == "s2"]
    back = [(s, o, "river stone stone") for s, o, _ in gone[:2]]
    assert segments.add(chunks(spark, three + back), path, replaced=chunks(spark, gone)) == 3
    alive = [r for r in one + two if r[0] != "s2"] + three + back
    same_hits(spark, path, alive)
    # and one of those that came back goes for good
    segments.add(chunks(spark, []), path, replaced=chunks(spark, back[:1]))
    alive.remove(back[0])
    # the smaller segments are merged while the largest still holds replaced chunks
    assert segments.merge(spark, path, largest=60) == 5
    entry = segments._latest(spark, path)
    assert len(entry["segments"]) == 2 and entry["replaced"] and entry["segments"][1]["ghosts"]
    same_hits(spark, path, alive)
    assert segments.merge(spark, path) == 6
    entry = segments._latest(spark, path)
    assert len(entry["segments"]) == 1 and not entry["replaced"] and not entry["segments"][0]["ghosts"]
    assert entry["segments"][0]["n"] == len(alive) and segments.merge(spark, path) == 6
    same_hits(spark, path, alive, (("absent river", 10**6),))
    monkeypatch.setattr(segments, "NAMED", 0)  # chosen blocks by a join
    same_hits(spark, path, alive)
    with pytest.raises(ValueError):
        segments.add(spark.createDataFrame([("s", "x", "t")], "source string, ord string, text string"), path)


def test_blocks_are_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 16)
    monkeypatch.setattr(segments, "FIRST", 4)
    path = f"file://{tmp_path}/index"
    rows = some_rows(1500, 4)
    segments.add(chunks(spark, rows), path)
    found = segments.top(spark, path, "the river", 5)
    assert 0 < found.read < found.blocks / 2
    expected = retrieval.text_search(chunks(spark, rows), "the river", 5).select("source", "ord", "score").collect()
    assert [tuple(r) for r in found.hits.collect()] == [tuple(r) for r in expected]


def test_best_pairs(spark):
    r = random.Random(2)
    lists = [[(r.randint(1, 6), r.randint(1, 20)) for _ in range(r.randint(1, 30))] for _ in range(50)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, p array<struct<tf:int,dl:int>>")
    for i, got in frame.select("i", segments._best_pairs(F.col("p")).alias("b")).collect():
        best = {(t, d) for t, d in lists[i] if not any((u >= t and e <= d) and (u, e) != (t, d) for u, e in lists[i])}
        assert sorted(map(tuple, got)) == sorted(best)


def test_blocks_are_made_in_their_own_task_and_move_as_such(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    monkeypatch.setattr(segments, "TOKENS", 300)  # the longest chunks share no block, as the limit of tokens comes first
    rows = some_rows(150, 8)
    made = segments._blocked(chunks(spark, rows), ["source", "ord"], "text", None)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    held = made.where("slot IS NOT NULL").groupBy("block").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), F.max("slot").alias("last")).collect()
    assert sum(b.n for b in held) == len(rows) and all(b.n == b.last + 1 <= 8 and (b.n == 1 or b.dl <= 300) for b in held)
    best = made.where("slot IS NULL").select("posted", "best", "block").collect()
    length = {(r.block, r.slot): r.dl for r in made.where("slot IS NOT NULL").select("block", "slot", "dl").collect()}
    for r in best:
        every = {(x & 0xFFFFFFFF, length[r.block, x >> 32]) for x in r.posted}
        assert {(x >> 32, x & 0xFFFFFFFF) for x in r.best} == {(t, d) for t, d in every if not any((u >= t and e <= d) and (u, e) != (t, d) for u, e in every)}
    path, more = f"file://{tmp_path}/index", some_rows(3, 9)
    segments.add(chunks(spark, rows), path)
    segments.add(chunks(spark, more), path, replaced=chunks(spark, rows[:100]))
    segments.merge(spark, path)
    same_hits(spark, path, rows[100:] + more)
    left = segments._chunks(spark, path, segments._latest(spark, path)).groupBy("block").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), F.max("slot").alias("last")).collect()
    assert sum(b.n for b in left) == len(rows) - 100 + len(more) and all(b.n == b.last + 1 <= 8 for b in left)
    # what one old block has left joins another's: two blocks of a task that follow one another would not fit in one
    assert len(left) < len(held)


def test_a_writer_that_was_overtaken(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    segments.add(chunks(spark, some_rows(10, 5)), path)
    write = segments._write

    def meanwhile(*args):
        monkeypatch.setattr(segments, "_write", write)
        segments.add(chunks(spark, some_rows(10, 6)), path)
        write(*args)

    monkeypatch.setattr(segments, "_write", meanwhile)
    with pytest.raises(Taken):
        segments.add(chunks(spark, some_rows(10, 7)), path)
    same_hits(spark, path, some_rows(10, 5) + some_rows(10, 6))


# --- neighbours
def plain_neighbours(rows, k, floor=0.0):
    out = []
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v is not None and None not in v and np.linalg.norm(v)}
    for q in [i for i, _ in rows if i % 4 == 0 and i in unit]:
        scores = [(-float(F_round(unit[q] @ v)), i) for i, v in unit.items() if len(v) == len(unit[q])]
        for rank, (s, i) in enumerate(sorted(scores)[:k]):
            if -s >= floor or floor <= 0:
                out.append((q, i, -s, rank + 1))
    return sorted(out)


def F_round(x):
    return math.copysign(math.floor(abs(x) * 10_000 + 0.5), x) / 10_000


def test_neighbours(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [(300, [0.0] * 4), (304, None), (308, [1.0, 2.0]), (309, [2.0, 1.0]), (312, [1.0, None, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id int, vector array<float>").repartition(5)
    for block in (4_000_000, 40):  # one block of queries, and many
        monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", block)
        monkeypatch.setattr(neighbours, "AT_ONCE", 500)
        got = neighbours.neighbours(table.where("vec_id % 4 = 0"), table, 6).collect()
        assert sorted((x.query_id, x.vec_id, x.score, x["rank"]) for x in got) == plain_neighbours(rows, 6)
    assert sorted((x.query_id, x.vec_id, x.score, x["rank"]) for x in neighbours.neighbours(table.where("vec_id % 4 = 0"), table, 50, floor=0.4).collect()) == plain_neighbours(rows, 50, 0.4)
    assert neighbours.neighbours(table.where("vec_id < 0"), table).count() == 0 and neighbours.neighbours(table, table.where("vec_id < 0")).count() == 0


# --- word segmentation
def all_splits(run):
    for cuts in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        words, at = [], 0
        for i, cut in enumerate(cuts):
            if cut:
                words.append(run[at : i + 1])
                at = i + 1
        yield [*words, run[at:]] if run else []


def test_likeliest_of_all_splits():
    r = random.Random(4)
    signs = "一二三四五"
    for _ in range(120):
        lexicon = segmentation.Lexicon({"".join(r.choice(signs[: r.choice([2, 5])]) for _ in range(r.randint(1, 4))): r.choice([1, 1, 2, 50, 400]) for _ in range(r.randint(0, 12))})
        run = "".join(r.choice(signs) for _ in range(r.randint(0, 9)))

        def total(words):
            sum_ = 0.0
            for w in reversed(words):  # as the path adds up
                sum_ = lexicon.weight(w) + sum_
            return sum_

        known = [s for s in all_splits(run) if all(len(w) == 1 or w in lexicon.counts for w in s)]
        best = max(known, key=lambda s: (total(s), [len(w) for w in s]))
        assert lexicon.split(run) == best and "".join(lexicon.split(run)) == run


def test_words_of_mixed_texts(spark, tmp_path):
    lexicon = segmentation.Lexicon({"合同": 50, "借款": 40, "借款合同": 5, "本": 10, "金": 10, "本金": 30, "金额": 20, "额": 10, "": 9, "坏": 0})
    assert lexicon.split("借款合同本金额") == ["借款", "合同", "本金", "额"] and lexicon.split("未知") == ["未", "知"]
    rows = [("a", 1, "借款合同 No.7，本金500元"), ("b", 2, "Plain Text, 42"), ("c", 3, None), ("d", 4, ""), ("a", 5, "本金本金 合同")]
    got = {r.ord: r.words for r in segmentation.with_words(chunks(spark, rows), lexicon).collect()}
    assert got == {1: ["借款", "合同", "no", "7", "本金", "500", "元"], 2: ["plain", "text", "42"], 3: [], 4: [], 5: ["本金", "本金", "合同"]}
    table = segmentation.with_words(chunks(spark, rows), lexicon)
    path = f"file://{tmp_path}/words"
    segments.add(table, path, words="words")
    assert [r.ord for r in segments.search(spark, path, lexicon.terms("本金")).collect()] == [5, 1]
    assert segments.search(spark, path, lexicon.terms("金")).count() == 0  # no word of any text
    with pytest.raises(ValueError):
        segmentation.Lexicon.of(spark.createDataFrame([("a", 1), ("b", 1)], "word string, n int"), most=1)
    counted = segmentation.Lexicon.of(segmentation.word_counts(chunks(spark, [("a", 1, "x y X"), ("b", 2, None)])))
    assert counted.counts == {"x": 2, "y": 1}


def test_segmentation_query(spark):
    """Over the smallest table: every run's split is a best one, and words of the lexicon are found."""
    got = {r.doc_id: r.words for r in stored.word_segmentation(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {r.doc_id for r in docs}
    letters = {r.doc_id: sum(c in stored.LETTERS for c in r.text.lower()) for r in docs}
    assert all(got[i] <= n for i, n in letters.items()) and sum(got.values()) < 0.6 * sum(letters.values())


@pytest.mark.parametrize("dense, many", [(1 << 23, 48), (0, 1), (1 << 23, 3)])
def test_blocks_split_as_texts_do(monkeypatch, dense, many):
    """All texts of a block at once, whatever their runs, against one text after the other."""
    monkeypatch.setattr(segmentation, "DENSE", dense)
    monkeypatch.setattr(segmentation, "MANY", many)
    r, signs = random.Random(1), "一二三四五六鿿"
    for _ in range(60):
        lexicon = segmentation.Lexicon({"".join(r.choice(signs + "ab") for _ in range(r.randint(1, 5))): r.choice([1, 1, 2, 50, 400]) for _ in range(r.randint(0, 15))})
        texts = ["".join(r.choice(signs + "ab, éİ𝒳") for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 6))]
        assert segmentation.Splitter(lexicon).terms(texts).to_pylist() == [lexicon.terms(t) for t in texts]
