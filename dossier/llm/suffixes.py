"""Substring deduplication by prefix-partitioned suffix trees.

Every place in a text is a suffix, and suffixes are dealt to trees by a prefix
taken from the words that follow.  The prefix has SEED_WORDS words; prefixes
with more than GROUP suffixes are lengthened (by as many words as their count
asks for, up to the whole window), so that a tree's distinct suffixes fit into
memory.  A task reads the suffixes of one prefix after the other in order of
doc_id, sorts those of a tree by their words, takes the common prefixes of
neighbours, and so visits the tree's internal nodes from the deepest to those
`window` words deep: a leaf below such a node that has a leaf of a smaller text
too repeats it, over as many words as the deepest such node is deep.  Stretches
that meet or overlap give the maximal repeats of a text.

What is sent is thinned.  A window's prefix is its smallest SEED_WORDS-word
stretch, the same wherever the window occurs; if that occurs in one text only,
no suffix of the window repeats.  Windows in a row that share the stretch go as
one row with all their words.  A task keeps, of equal windows, those of its
smallest text; the others are known to be repeats at once.  So a passage in a
third of all texts sends a suffix a task.  Equal texts are one leaf each: all
but that with the smallest doc_id go whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Membership, salted_join, store
from .words import GRAM_FACTORS, WHITE, Block, blocks, mix

SEED_WORDS = 5
#: Suffixes of a prefix beyond which it is lengthened, and that a task sorts at once.
GROUP = 1 << 17
#: Bytes of a word's hash that are sent.
WORD_BYTES = 6
SUFFIX = "prefix bigint, doc_id bigint, pos int, n int, words binary"


def texts(docs: DataFrame) -> DataFrame:
    """For every row doc_id, n_words and the SHA-256 of its words joined by one space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, prints = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()  # bytes split at ASCII white space
                counts.append(len(words))
                prints.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "n_words", "whole"])

    return store(docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, n_words bigint, whole binary"), "dedup-texts")


def _seeds(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside a row its hash and its smallest SEED_WORDS-word stretch; the word it begins at and the rows' bounds."""
    whole, at, bounds = block.grams(window)
    if not len(at):
        return whole, whole, at, bounds
    k = min(SEED_WORDS, window)
    small = np.zeros(len(block.hash) - k + 1, np.uint64)
    for j in range(k):
        small += block.hash[j : j + len(small)] * GRAM_FACTORS[j]
    small = mix(small, k)
    least = small[: len(small) - (window - k)].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, small[j : j + len(least)], out=least)
    return whole, least[at], at, bounds


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values in all columns begins."""
    head = np.zeros(len(columns[0]), bool)
    head[:1] = True
    for c in columns:
        head[1:] |= c[1:] != c[:-1]
    return head


def shared_seeds(docs: DataFrame, window: int) -> DataFrame:
    """seed and n, the rows that it will send at most, of the stretches in two different texts at least (copies count as one text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), WHITE, False, 1 << 21):
                _, seeds, _, bounds = _seeds(block, window)
                if not len(seeds):
                    continue
                row = np.repeat(np.arange(block.rows), np.diff(bounds))
                first = _heads(seeds, row)  # a seed lasts for some windows: one row for each stay
                weighed = mix(block.hash + np.uint64(1)) * mix(np.arange(len(block.hash), dtype=np.uint64) - np.repeat(block.words[:-1], np.diff(block.words)).astype(np.uint64), 7)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)])
                text = mix(total[block.words[1:]] - total[block.words[:-1]], 9)
                yield pa.RecordBatch.from_arrays([pa.array(seeds[first].view(np.int64)), pa.array(text[row[first]].view(np.int64))], names=["seed", "text"])

    found = docs.select("text").mapInArrow(task, "seed bigint, text bigint")
    counted = found.groupBy("seed").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count("*").alias("n"))
    return store(counted.where("low <> high").select("seed", "n"), "dedup-seeds")


def suffixes(docs: DataFrame, member: Membership, heavy: dict[int, int], window: int) -> DataFrame:
    """The suffixes that may repeat: prefix, doc_id, and n windows in a row from pos on with all their words.

    Without words: windows that a smaller text in the same task has too.
    heavy: seeds that are lengthened, and to how many words.
    """
    spark = docs.sparkSession
    order = sorted(heavy)
    table = spark.sparkContext.broadcast((np.array(order, np.int64), np.array([heavy[k] for k in order], np.int64)))

    def rows(prefix, doc, pos, n, words) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), words], names=["prefix", "doc_id", "pos", "n", "words"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths = table.value
        for batch in batches:
            ids = batch.column("doc_id")
            valid = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            kept: list[tuple[np.ndarray, ...]] = []
            hashes: list[np.ndarray] = []
            held = 0
            for block in blocks(batch.column("text"), WHITE, False):
                whole, seeds, at, bounds = _seeds(block, window)
                row = np.repeat(np.arange(block.rows), np.diff(bounds))
                some = member.has(seeds) & valid[block.first + row]
                if some.any():
                    at, row = at[some], row[some]
                    kept.append((whole[some], seeds[some], ids[block.first + row], block.first + row, at - block.words[row], at + held))
                    hashes.append(block.hash)
                    held += len(block.hash)
            if not kept:
                continue
            whole, seed, doc, row, pos, at = (np.concatenate(c) for c in zip(*kept))
            word = np.concatenate(hashes)
            by = np.lexsort((doc, whole))
            head = _heads(whole[by])
            known = np.empty(len(by), bool)
            known[by] = doc[by] > doc[by][np.flatnonzero(head)[np.cumsum(head) - 1]]
            gap = np.append(True, np.diff(at) != 1) | _heads(row, known, seed)
            sure = np.flatnonzero(gap & known)
            ends = np.append(np.flatnonzero(gap), len(at))
            yield rows(mix(seed[sure] ^ row[sure].astype(np.uint64)), doc[sure], pos[sure], np.diff(ends)[known[ends[:-1]]], pa.nulls(len(sure), pa.binary()))
            # a window of a lengthened prefix goes by itself, of others at most `window` go together
            length = np.zeros(len(seed), np.int64)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, seed.view(np.int64)), len(keys) - 1)
                length = np.where(keys[place] == seed.view(np.int64), lengths[place], 0)
            start = np.flatnonzero(gap)[np.cumsum(gap) - 1]
            gap |= (length > 0) | ((np.arange(len(at)) - start) % window == 0)
            first = np.flatnonzero(gap & ~known)
            ends = np.append(np.flatnonzero(gap), len(at))
            n = np.diff(ends)[~known[ends[:-1]]]
            prefix = seed[first].copy()
            for size in np.unique(length[first]):
                if size:
                    which = length[first] == size
                    prefix[which] = mix(sum((word[at[first[which]] + k] * GRAM_FACTORS[k] for k in range(size)), prefix[which]), 50)
            count = n + window - 1
            stop = np.cumsum(count)
            sent = word[np.repeat(at[first] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
            data = np.ascontiguousarray(sent.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
            offsets = np.concatenate([[0], WORD_BYTES * stop]).astype(np.int32)
            yield rows(prefix, doc[first], pos[first], n, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))

    return docs.select("doc_id", "text").mapInArrow(task, SUFFIX)


def tree(doc: np.ndarray, pos: np.ndarray, count: np.ndarray, word: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Repeats in the suffixes of rows (doc, pos, count words each in word): doc, pos and depth of each leaf below a deep node with a smaller text; and which rows have a leaf that is none."""
    n = count - window + 1
    base = np.cumsum(count) - count
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + i
    whole = np.zeros(len(at), np.uint64)
    for k in range(window):
        whole += word[at + k] * GRAM_FACTORS[k]
    by = np.argsort(whole, kind="stable")
    head = _heads(whole[by])
    twice = np.zeros(len(by), bool)
    twice[by] = np.diff(np.append(np.flatnonzero(head), len(by)))[np.cumsum(head) - 1] > 1
    some = np.flatnonzero(twice)  # the others have no node so deep above them
    depth = np.zeros(len(at), np.int64)
    if len(some):
        left = count[row[some]] - i[some]
        deepest = int(left.max())
        reach = np.arange(deepest)
        words = np.where(reach < left[:, None], word[np.minimum(at[some][:, None] + reach, len(word) - 1)], np.uint64(0))
        order = np.lexsort([words[:, k] for k in range(deepest - 1, -1, -1)])
        words, left, some = words[order], left[order], some[order]
        differ = np.concatenate([words[1:] != words[:-1], np.ones((len(some) - 1, 1), bool)], axis=1).argmax(1)
        common = np.concatenate([[0], np.minimum(differ, np.minimum(left[1:], left[:-1]))])
        owner, found = doc[row[some]], np.zeros(len(some), np.int64)
        for level in range(deepest, window - 1, -1):
            if level == window or (common == level).any():
                node = np.flatnonzero(common < level)
                least = np.repeat(np.minimum.reduceat(owner, node), np.diff(np.append(node, len(owner))))
                found[(found == 0) & (owner > least)] = level
        depth[some] = found
    hit = depth > 0
    first = np.zeros(len(n), bool)
    first[row[~hit]] = True
    return doc[row[hit]], pos[row[hit]] + i[hit], depth[hit], first


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Stretches of each text, those that meet or overlap as one."""
    by = np.lexsort((start, doc))
    doc, start, stop = doc[by], start[by], stop[by]
    rank = np.cumsum(_heads(doc)) << 33
    end = np.maximum.accumulate(rank + stop)
    head = _heads(rank)
    head[1:] |= rank[1:] + start[1:] > end[:-1]
    last = np.append(np.flatnonzero(head), len(doc))[1:] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(start[head].astype(np.int32)), pa.array((end - rank)[last].astype(np.int32))], names=["doc_id", "start", "stop"])


def deep_nodes(rows: DataFrame, window: int, group: int) -> DataFrame:
    """doc_id, start and stop of stretches that a smaller text has too, from the deep nodes of all trees."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def grown(some) -> tuple[pa.RecordBatch, np.ndarray]:
            _, doc, pos, count, words = some
            word = np.zeros((len(words) // WORD_BYTES, 8), np.uint8)
            word[:, :WORD_BYTES] = words.reshape(-1, WORD_BYTES)
            doc, at, depth, first = tree(doc, pos, count, word.view(np.uint64).ravel(), window)
            return _merged(doc, at, at + depth), first

        def cut(some, rows):
            prefix, doc, pos, count, words = some
            which = np.zeros(len(prefix), bool)
            which[rows] = True
            return prefix[which], doc[which], pos[which], count[which], words[np.repeat(which, count * WORD_BYTES)]

        for batch in batches:
            sure = np.asarray(batch.column("words").is_null())
            if sure.any():
                known = batch.filter(pa.array(sure))
                doc, pos, n = (known.column(c).to_numpy() for c in ("doc_id", "pos", "n"))
                yield _merged(doc, pos, pos + n + window - 1)
                batch = batch.filter(pa.array(~sure))
            if not batch.num_rows:
                continue
            prefix, doc, pos, n = (batch.column(c).to_numpy() for c in ("prefix", "doc_id", "pos", "n"))
            column = batch.column("words")
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
            held.append((prefix, doc, pos.astype(np.int64), n.astype(np.int64) + window - 1, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]))
            size += int(n.sum())
            if size < group:
                continue
            # all trees but the last are whole
            some = tuple(np.concatenate(c) for c in zip(*held))
            others = np.flatnonzero(some[0] != some[0][-1])
            last = int(others[-1]) + 1 if len(others) else 0
            if last:
                yield grown(cut(some, slice(0, last)))[0]
                some = cut(some, slice(last, None))
            if int((some[3] - window + 1).sum()) >= group:
                # rows come by doc_id: of a large tree only suffixes that are new so far are needed further on
                found, first = grown(some)
                yield found
                some = cut(some, first)
            held, size = [some], int((some[3] - window + 1).sum())
        if held:
            yield grown(tuple(np.concatenate(c) for c in zip(*held)))[0]

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "prefix").sortWithinPartitions("prefix", "doc_id").mapInArrow(task, "doc_id bigint, start int, stop int")


def spans(stretches: DataFrame) -> DataFrame:
    """For each text its maximal stretches, those that meet or overlap as one: doc_id, start and stop (exclusive) as arrays in order."""
    end = F.col("stop").cast("int")
    found = stretches.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", end.alias("stop")))).alias("s"))
    # a stretch begins where it lies behind all before it; the last stop before the next beginning ends it
    reach = F.expr("aggregate(s, cast(array() as array<struct<start: int, stop: int>>), (acc, x) -> CASE WHEN size(acc) > 0 AND acc[size(acc) - 1].stop >= x.start THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'stop', greatest(acc[size(acc) - 1].stop, x.stop)))) ELSE concat(acc, array(x)) END)")
    return found.select("doc_id", reach.alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))


def repeats(docs: DataFrame, window: int = 50, group: int = GROUP) -> DataFrame:
    """doc_id, start and stop: the maximal stretches of every text that repeat, over a window at least, texts with a smaller doc_id."""
    seeds = shared_seeds(docs, window)
    bits = min(28, max(20, (16 * max(1, seeds.count()) - 1).bit_length()))  # 32 MB at most
    # there are at most as many heavy prefixes as all suffixes fill groups
    heavy = {r.seed: min(window, SEED_WORDS + 1 + int(r.n // group).bit_length()) for r in seeds.where(F.col("n") > group).collect()}
    return store(spans(deep_nodes(suffixes(docs, Membership(seeds, "seed", bits), heavy, window), window, group)), "dedup-spans")


def dedup(docs: DataFrame, window: int = 50, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space; null if whole) and kept_sha256 for every row.

    Words are split at ASCII white space and compared as they are.  Removed is
    every word of a window of `window` words that also begins in a text with a
    smaller doc_id, judged on the input.  A null text has no words; shorter
    texts lose nothing; a copy of a text with a smaller doc_id loses all.
    Repeated rows are treated alike; different texts under one doc_id never
    remove each other's words, and share the places that are removed.  Rows
    without a doc_id neither lose nor remove any.  Other columns are not read.
    """
    whole = texts(docs)
    # copies: the smallest doc_id of equal texts keeps what it has for itself
    first = whole.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = store(salted_join(whole, first, ["whole"], "doc_id", "inner").where("doc_id > first").select("doc_id", "whole").distinct(), "dedup-copies")
    cut = repeats(docs, window, group)
    member = Membership(cut.select(F.xxhash64("doc_id").alias("key")), "key")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(member.has(batch.column("key").to_numpy())))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, start, stop in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "start", "stop")]):
                words = (text or "").encode().split()
                before, left, at = hashlib.sha256(b" ".join(words)).digest(), [], 0
                for i, j in zip(start, stop):
                    left += words[at:i]
                    at = max(at, j)
                left = b" ".join(left + words[at:]) if at <= len(words) else b" ".join(left)
                out.append((doc, before, len(words), left.decode(), hashlib.sha256(left).hexdigest()))
            if out:
                counts = [o[2] - (o[3].count(" ") + 1 if o[3] else 0) for o in out]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array(counts, pa.int64()), pa.array([o[3] for o in out], pa.string()), pa.array([o[4] for o in out], pa.string())], names=["doc_id", "whole", "n_removed", "kept", "kept_sha256"])

    parts = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInArrow(possible, "doc_id bigint, text string").join(cut, "doc_id")
    changed = parts.select("doc_id", "text", "start", "stop").mapInArrow(task, "doc_id bigint, whole binary, n_removed bigint, kept string, kept_sha256 string").dropDuplicates(["doc_id", "whole"])
    empty = hashlib.sha256(b"").hexdigest()
    marked = whole.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "whole"], "left").join(changed, ["doc_id", "whole"], "left")
    return marked.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("whole")))).alias("kept_sha256"),
    )
