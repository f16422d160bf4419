"""Benchmark decontamination over a distributed positional inverted index.

1.  The corpus is counted for the test vocabulary only.
2.  For every window of a test item its rarest terms are chosen; postings
    (term, doc_id, positions) of the chosen terms are stored as a table.
3.  Posting lists are shifted by the terms' offsets in their item and
    intersected: places that agree on a diagonal (position minus offset) are
    grouped by (doc, item, diagonal), and windows need all their rarest terms.
4.  Texts on such a diagonal are compared word by word; runs of equal words of
    a window's length or more are the exact phrase matches.  Diagonals close
    together give the proximity matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Membership, store
from .words import NOT_ALNUM, blocks

RAREST = 3
#: Items are handled in parts of about so many bytes of text, so what is broadcast is bounded.
PART_BYTES = 16 << 20
#: Chosen (term, item, offset) rows are broadcast up to this many, else joined by shuffling.
BROADCAST_ROWS = 200_000


@dataclass
class Items:
    """Test items as word hashes, and for each item the words of a window."""

    ids: list
    words: list[np.ndarray]
    window: int

    @property
    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate([np.empty(0, np.uint64), *self.words]))

    def length(self, i: int) -> int:
        return min(self.window, len(self.words[i]))

    def windows(self, i: int) -> range:
        return range(len(self.words[i]) - self.length(i) + 1)


def load_items(items: DataFrame, window: int) -> Items:
    rows = items.select("item_id", "text").toArrow()
    words: list[np.ndarray] = []
    for block in blocks(rows["text"].combine_chunks(), NOT_ALNUM, True):
        words += [block.hash[block.words[r] : block.words[r + 1]].copy() for r in range(block.rows)]
    kept = [(i, w) for i, w in zip(rows["item_id"].to_pylist(), words) if len(w) and i is not None]
    return Items([i for i, _ in kept], [w for _, w in kept], window)


def _find(words: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are terms (a sorted array), and which."""
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(terms, words)
    at[at == len(terms)] = 0
    here = np.flatnonzero(terms[at] == words)
    return here, at[here]


def term_counts(docs: DataFrame, terms: Broadcast) -> np.ndarray:
    """How often each term occurs in the whole corpus."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = terms.value, np.zeros(len(terms.value), np.int64)
        for batch in batches:
            for block in blocks(batch.column("text"), NOT_ALNUM, True):
                total += np.bincount(_find(block.hash, known)[1], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    got = docs.select("text").mapInArrow(task, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(len(terms.value), np.int64)
    count[got["term"].to_numpy()] = got["n"].to_numpy()
    return count


def anchors(items: Items, terms: np.ndarray, count: np.ndarray) -> list[list[tuple[int, ...]]]:
    """For each item and window the offsets (in the item) of its rarest terms; earlier ones first where counts tie."""
    chosen = []
    for i, words in enumerate(items.words):
        rank = count[np.searchsorted(terms, words)]
        n = items.length(i)
        chosen.append([tuple(sorted((s + np.argsort(rank[s : s + n], kind="stable")[:RAREST]).tolist())) for s in items.windows(i)])
    return chosen


def build_index(docs: DataFrame, terms: Broadcast) -> DataFrame:
    """term, doc_id, key (of id and text together) and positions of all terms in all texts; term -1 holds the count of words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in batches:
            for block in blocks(batch.column("text"), NOT_ALNUM, True, 1 << 20):
                here, which = _find(block.hash, known)
                row = np.searchsorted(block.words, here, "right") - 1
                order = np.lexsort((here, which, row))
                here, which, row = here[order], which[order], row[order]
                head = np.ones(len(here), bool)
                head[1:] = (which[1:] != which[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(head)
                place = (here - block.words[row]).astype(np.int32)
                counts = np.diff(block.words).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, len(here) + np.arange(block.rows + 1)]).astype(np.int32)), pa.array(np.concatenate([place, counts])))
                owner = pa.array(block.first + np.concatenate([row[first], np.arange(block.rows)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([which[first], np.full(block.rows, -1)])), batch.column("doc_id").take(owner), batch.column("key").take(owner), lists], names=["term", "doc_id", "key", "positions"])

    return store(docs.select("doc_id", "key", "text").mapInArrow(task, "term bigint, doc_id bigint, key bigint, positions array<int>"), "positional-index")


def diagonals(index: DataFrame, items: Items, terms: np.ndarray, chosen: list, slop: int) -> DataFrame:
    """key and found (item, need and its places) of the texts in which enough of an item's chosen terms agree.

    Posting lists are shifted by each term's offset in its item and met by
    (text, item): places are (diagonal, offset), at most the text's postings.
    They are kept if as many as an exact window needs share a diagonal, or
    so many of them with different offsets lie within slop diagonals of a place.
    """
    spark = index.sparkSession
    rows = [(int(np.searchsorted(terms, items.words[i][o])), i, o, min(len(w) for w in per), (slop + 1) * len({o for w in per for o in w})) for i, per in enumerate(chosen) for o in sorted({o for w in per for o in w})]
    wanted = spark.createDataFrame(rows, "term bigint, item int, offset int, need int, reach int")
    if len(rows) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    moved = index.where("term >= 0").join(wanted, "term").select("key", "item", "need", "reach", "offset", F.explode("positions").alias("at")).select("key", "item", "need", "reach", F.struct((F.col("at") - F.col("offset")).alias("d"), F.col("offset").alias("o")).alias("place"))
    met = moved.groupBy("key", "item", "need", "reach").agg(F.sort_array(F.collect_set("place")).alias("s")).where(F.size("s") >= F.col("need"))
    same = F.filter("s", lambda x, i: F.coalesce(F.get("s", i + F.col("need") - 1)["d"] == x["d"], F.lit(False)))
    # places are different, so those within slop of one are at most `reach` in a row
    offsets = lambda x, i: F.array_distinct(F.transform(F.filter(F.slice("s", i + 1, F.col("reach")), lambda y: y["d"] <= x["d"] + slop), lambda y: y["o"]))
    close = F.filter("s", lambda x, i: F.size(offsets(x, i)) >= F.col("need"))
    judged = met.withColumn("exact", F.array_distinct(F.transform(same, lambda x: x["d"]))).withColumn("near", F.size(close) > 0).where((F.size("exact") > 0) | F.col("near"))
    places = F.filter("s", lambda x: F.array_contains("exact", x["d"]))
    return judged.groupBy("key").agg(F.collect_list(F.struct("item", "near", places.alias("places"))).alias("found"))


def _equal(words: np.ndarray, item: np.ndarray, diagonal: int, length: int) -> np.ndarray:
    """Offsets in the item of the words that lie in runs of equal words of that length on the diagonal."""
    low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
    if high - low < length:
        return np.empty(0, np.int64)
    same = np.concatenate([[False], words[low + diagonal : high + diagonal] == item[low:high], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    return np.concatenate([np.empty(0, np.int64), *[np.arange(i, j) for i, j in zip(edge[::2], edge[1::2]) if j - i >= length]]) + low


def search(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 3) -> DataFrame:
    """doc_id, n_words, hits (word positions inside matched windows), items (ids with an exact match) and near (ids with their rarest terms within slop) for every row.

    Words are runs of digits, letters and non-ASCII characters, lower-cased
    (A-Z).  A null text has no words and no hits; items without words or id
    match nothing; an item shorter than a window is one window.  Rows with
    one doc_id are judged on their own.  Other columns are not read.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    rows = None
    for part in range(parts):
        chunk = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        index, found = _search(keyed, load_items(chunk, window), slop)
        if rows is None:
            none = [F.array().cast(kind).alias(c) for c, kind in (("hits", "array<int>"), ("items", "array<bigint>"), ("near", "array<bigint>"))]
            rows = index.where("term = -1").select("doc_id", "key", F.col("positions")[0].alias("n_words"), *none)
        more = found.toDF("key", *[f"more_{c}" for c in ("hits", "items", "near")])
        rows = rows.join(more, "key", "left").select("doc_id", "key", "n_words", *[F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.array_union(c, f"more_{c}")).alias(c) for c in ("hits", "items", "near")])
    return rows.drop("key")


def _search(docs: DataFrame, items: Items, slop: int) -> tuple[DataFrame, DataFrame]:
    """The index, and key, hits, items and near of the texts that have any."""
    sc = docs.sparkSession.sparkContext
    terms = items.vocabulary
    counted = term_counts(docs, sc.broadcast(terms)) if len(terms) else np.zeros(0, np.int64)
    chosen = anchors(items, terms, counted)
    picked = np.unique(np.concatenate([np.empty(0, np.uint64), *[w[sorted({o for win in per for o in win})] for w, per in zip(items.words, chosen)]]))
    index = build_index(docs, sc.broadcast(picked))
    by_text = store(diagonals(index, items, picked, chosen, slop), "diagonals")
    shared = sc.broadcast((items, chosen))
    member = Membership(by_text, "key", 20)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(member.has(batch.column("key").to_numpy())))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, windows = shared.value
        for batch in batches:
            out, found = [], batch.column("found").to_pylist()
            for block in blocks(batch.column("text"), NOT_ALNUM, True):
                for r in range(block.rows):
                    words, hits, names = block.hash[block.words[r] : block.words[r + 1]], [np.empty(0, np.int64)], set()
                    for f in found[block.first + r]:
                        i, agree = f["item"], {}
                        for p in f["places"]:
                            agree.setdefault(p["d"], set()).add(p["o"])
                        for d, have in agree.items():
                            if any(have.issuperset(w) for w in windows[i]):
                                same = _equal(words, own.words[i], d, own.length(i))
                                if len(same):
                                    hits.append(same + d)
                                    names.add(own.ids[i])
                    close_by = sorted({own.ids[f["item"]] for f in found[block.first + r] if f["near"]})
                    out.append((np.unique(np.concatenate(hits)).astype(np.int32), sorted(names), close_by))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["key", "hits", "items", "near"])

    texts = docs.select("key", "text").mapInArrow(possible, "key bigint, text string").dropDuplicates(["key"]).join(by_text, "key")
    return index, store(texts.select("key", "text", "found").mapInArrow(task, "key bigint, hits array<int>, items array<bigint>, near array<bigint>"), "phrase-hits")


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row."""
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return search(docs, items, window).select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
