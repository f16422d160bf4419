"""Segmented postings for BM25: batches are indexed apart and merged later, and a query reads only the blocks that can hold one of its top hits.

A segment numbers the chunks of each task in the order of their length and cuts
them into blocks, the same blocks for all terms.  A chunk is a slot of its
block, where its keys and length are kept once.  A term's postings in a block,
slots and counts, are one row, beside the pairs of count and length that no
other pair of the block beats: whatever the statistics are at the time of a
query, the block's highest part of a score is that of one of them.  The sum over a query's terms bounds
the score of every chunk of the block.  A query scores the blocks of the
highest bounds first; the k-th best score found there rules out all blocks
whose bound is lower, and their postings are never read.

A log lists the segments.  Adding a batch writes its own postings only.  Chunks
that it replaces are recorded beside it: their keys, which hide older postings,
and how often each term was in them, which is taken off the statistics.  So
scores are at every time those of an index built anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.commits import CommitLog, Files, fresh_name
from ..sources.scratch import materialise
from .retrieval import B, K1, prefix_filter

#: Chunks a block, buckets of terms, and the blocks that are scored first.
BLOCK, BUCKETS, FIRST = 128, 64, 16
#: A block of so many tokens takes no further chunk.
TOKENS = 1 << 21
#: So many chosen blocks at most are named in the filter of a scan; more are joined.
NAMED = 2000


@dataclass
class Search:
    """The hits of a query, and how many of the blocks with its terms were read for them."""

    hits: DataFrame
    blocks: int
    read: int


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _words(chunks: DataFrame, keys: list[str], text: str, words: str | None) -> DataFrame:
    """keys and the tokens of every chunk (none for a null text) as _t."""
    return chunks.select(*keys, F.coalesce(tokens(F.col(text)) if words is None else F.col(words), F.array().cast("array<string>")).alias("_t"))


def _cuts(sizes: np.ndarray, most: int, limit: int) -> Iterator[tuple[int, int]]:
    """First row and end of each block: `most` rows and `limit` tokens at most, or one row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, "right"))
        end = min(max(first + 1, last), first + most)
        yield first, end
        first = end


#: A slot, or a count, in the upper half of a number, and a count, or a length, in the lower.
HALF = 32
#: One term's row of a block: how many postings and tokens, the pairs of tf and dl that no other beats, and the postings as pairs of slot and tf.
POSTED = "block bigint, term string, n int, tokens bigint, best array<bigint>, posted array<bigint>"
_POSTED = [c.split()[0] for c in POSTED.split(", ")]


def _high(pair: Column) -> Column:
    return F.shiftright(pair, HALF).cast("int")


def _low(pair: Column) -> Column:
    return pair.bitwiseAND((1 << HALF) - 1).cast("int")


def _by_term(block: int, terms: pa.Array, code: np.ndarray, slot: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> list[pa.Array]:
    """Columns of POSTED of one block's postings, which are in the order of their terms' codes."""
    if not len(code):
        return [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
    new = np.append(True, code[1:] != code[:-1])
    first = np.flatnonzero(new)
    bounds = np.append(first, len(code))
    # by length, of equal ones the highest count first: a pair is kept that has more than all before it of its term
    order = np.lexsort((-tf, dl, code))
    above = (np.cumsum(new) - 1) * (int(tf.max()) + 1) + tf[order]
    kept = np.append(True, above[1:] > np.maximum.accumulate(above)[:-1])
    ends = np.append(0, np.cumsum(kept))[bounds]
    lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((x.astype(np.int64) << HALF) | y)) for at, x, y in ((ends, tf[order][kept], dl[order][kept]), (bounds, slot, tf))]
    return [pa.array(np.full(len(first), block)), terms.take(pa.array(code[first])), pa.array(np.diff(bounds).astype(np.int32)), pa.array(np.add.reduceat(tf, first).astype(np.int64)), *lists]


def _blocked(chunks: DataFrame, keys: list[str], text: str, words: str | None) -> DataFrame:
    """Of each task's chunks, by length, BLOCK a block: a row a chunk (keys, dl, block, slot), and a row a term and block (POSTED), whose slot is null.

    A block is made whole in the task that has its chunks, so postings are
    grouped without a shuffle.
    """
    most, limit, kinds = BLOCK, TOKENS, dict(chunks.dtypes)
    names = [*keys, "dl", "slot", *_POSTED]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("_t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end in _cuts(sizes, most, limit):
                part, n = batch.slice(first, end - first), end - first
                order = np.argsort(sizes[first:end], kind="stable")
                dl, slot_of = sizes[first:end][order], np.empty(n, np.int64)
                slot_of[order] = np.arange(n)
                words = part.column("_t").flatten().dictionary_encode()
                slot = np.repeat(slot_of, sizes[first:end])
                pair, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + slot, return_counts=True)
                columns = _by_term(number, words.dictionary, pair // n, pair % n, tf, dl[pair % n])
                m, at = len(columns[0]), pa.array(order)
                types = [part.column(k).type for k in keys] + [pa.int32(), pa.int32()]
                own = [part.column(k).take(at) for k in keys] + [pa.array(dl.astype(np.int32)), pa.array(np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, number)), *[pa.nulls(n, c.type) for c in columns[1:]]], names=names)
                if m:
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(m, t) for t in types], *columns], names=names)
                number += 1

    size = F.length(text) if words is None else F.size(words)
    dealt = chunks.select(*keys, text if words is None else words).sortWithinPartitions(size, *keys)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", dl int, slot int, {POSTED}"
    return _words(dealt, keys, text, words).mapInArrow(task, schema)


def _built(rows: DataFrame, place: str) -> DataFrame:
    """Numbered rows, stored so that all that is made of them has the same numbers."""
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def _best_pairs(postings: Column) -> Column:
    """The pairs of tf and dl that no posting beats by more tf in no more dl, or as much tf in less dl; what _by_term finds for a block's terms at once, for one list."""
    ordered = F.array_sort(F.transform(postings, lambda x: F.struct(x["dl"].alias("dl"), (-x["tf"]).alias("less"))))
    start = F.array().cast("array<struct<tf:int,dl:int>>")
    return F.aggregate(ordered, start, lambda best, x: F.when((F.size(best) == 0) | (F.element_at(best, -1)["tf"] < -x["less"]), F.concat(best, F.array(F.struct((-x["less"]).alias("tf"), x["dl"].alias("dl"))))).otherwise(best))


def _write(rows: DataFrame, path: str, name: str) -> None:
    """Stores rows of chunks (keys, dl, block, slot) and of terms (POSTED) in one pass; chunks are a bucket of their own."""
    # a bucket's blocks go to more tasks the more there are, so a frequent term is no one's alone
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    placed = rows.withColumn("bucket", F.when(F.col("slot").isNull(), _bucket(F.col("term"))).otherwise(F.lit(BUCKETS)))
    dealt = placed.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(spread))).sortWithinPartitions("bucket", "term", "block")
    # small groups of rows, so that a scan for some blocks of a term passes over the others
    dealt.write.partitionBy("bucket").option("parquet.block.size", 4 << 20).option("parquet.page.row.count.limit", 1000).parquet(f"{path}/rows/segment={name}")


def _segments(spark: SparkSession, path: str, entry: dict, schema: str) -> DataFrame:
    """Rows of the listed segments, with the number of the commit that wrote each."""
    names = [s["name"] for s in entry["segments"]]
    if not names:
        return spark.createDataFrame([], schema).withColumn("number", F.lit(0))
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/segment={n}" for n in names])
    numbers = F.create_map(*[F.lit(x) for s in entry["segments"] for x in (s["name"], s["number"])])
    return rows.withColumn("number", numbers[F.col("segment")])


def _blocks(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    return _segments(spark, path, entry, f"{POSTED}, segment string, bucket int").where(F.col("bucket") < BUCKETS)


def _chunks(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    kinds = ", ".join(f"`{k}` {t}" for k, t in entry["keys"] or [["source", "string"], ["ord", "bigint"]])
    return _segments(spark, path, entry, f"{kinds}, dl int, block bigint, slot int, segment string, bucket int").where(F.col("bucket") == BUCKETS).drop("bucket")


def _postings(blocks: DataFrame) -> DataFrame:
    """segment, block, slot, term and tf of rows of blocks."""
    return blocks.select("segment", "block", "term", F.explode("posted").alias("p")).select("segment", "block", _high(F.col("p")).alias("slot"), "term", _low(F.col("p")).alias("tf"))


def _dead(spark: SparkSession, path: str, entry: dict) -> DataFrame | None:
    """The keys of replaced chunks, with the commit since which older postings of them do not count."""
    kinds = ", ".join(f"`{k}` {t}" for k, t in entry["keys"])
    gone = [spark.read.schema(kinds).parquet(f"{path}/replaced/{x['name']}/keys").withColumn("since", F.lit(x["number"])) for x in entry["replaced"]]
    return reduce(DataFrame.unionByName, gone) if gone else None


def _alive(chunks: DataFrame, dead: DataFrame | None, keys: list[str]) -> DataFrame:
    """chunks (keys, number) without those that a later commit replaced."""
    if dead is None:
        return chunks
    gone = dead.select(*[F.col(k).alias(f"_{k}") for k in keys], "since")
    return chunks.join(gone, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) & (F.col("since") > F.col("number")), "left_anti")


def _latest(spark: SparkSession, path: str) -> dict:
    return CommitLog(spark, path).latest() or {"number": 0, "segments": [], "replaced": [], "keys": []}


def add(chunks: DataFrame, path: str, keys: tuple[str, ...] = ("source", "ord"), text: str = "text", replaced: DataFrame | None = None, words: str | None = None) -> int:
    """Indexes a batch as a segment of its own and returns the number of its commit.

    keys name a chunk and are not null; words names a column of terms to index
    in place of the text's tokens; replaced has the chunks (keys and text
    or words as they were indexed) that from now on do not count, in full.  A chunk
    without tokens has no postings but counts in the statistics.  A batch that
    another writer's commit overtakes raises Taken.
    """
    spark, path = chunks.sparkSession, path.rstrip("/")
    before, name = _latest(spark, path), f"s{fresh_name()}"
    kinds = dict(chunks.dtypes)
    listed = [[k, kinds[k]] for k in keys]
    if before["keys"] and before["keys"] != listed:
        raise ValueError(f"the index has the keys {before['keys']}, the batch {listed}")
    _write(_blocked(chunks, list(keys), text, words), path, name)
    totals = _chunks(spark, path, {"keys": listed, "segments": [{"name": name, "number": 0}]}).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    segment = {"name": name, "number": before["number"] + 1, "n": totals.n, "tokens": totals.tokens, "ghosts": False}
    gone = []
    if replaced is not None:
        place = f"{path}/replaced/{name}"
        counted = materialise(_words(replaced, list(keys), text, words).select(*keys, F.size("_t").alias("dl"), F.array_distinct("_t").alias("terms")))
        counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{place}/terms")
        counted.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys]).write.parquet(f"{place}/keys")
        off = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        gone = [{"name": name, "number": segment["number"], "n": off.n, "tokens": off.tokens}]
    return CommitLog(spark, path).append(before["number"], {"keys": listed, "segments": [*before["segments"], segment], "replaced": [*before["replaced"], *gone]})


def _packed(chunks: DataFrame) -> DataFrame:
    """number, was_block, block and before (the slot that its first chunk gets) of every old block with chunks (number, was_block, dl): blocks of like lengths share a new one as far as BLOCK and TOKENS let them."""
    most, limit = BLOCK, TOKENS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            block, before = [], []
            for n, many in zip(batch.column("n").to_pylist(), batch.column("tokens").to_pylist()):
                if held and (held + n > most or size + many > limit):
                    number, held, size = number + 1, 0, 0
                block.append(number)
                before.append(held)
                held, size = held + n, size + many
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("was_block"), pa.array(block, pa.int64()), pa.array(before, pa.int32())], names=["number", "was_block", "block", "before"])

    each = chunks.groupBy("number", "was_block").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"), F.min("dl").alias("least"))
    return each.sortWithinPartitions("least", "number", "was_block").mapInArrow(task, "number int, was_block bigint, block bigint, before int")


def _moved(postings: pa.Table, chunks: pa.Table) -> pa.Table:
    """POSTED of a new block, from the rows of the old blocks in it (number, was_block, term, posted) and its chunks (number, was_block, was_slot, slot, dl); postings of other chunks are dropped."""
    olds = list(zip(chunks["number"].to_pylist(), chunks["was_block"].to_pylist()))
    nth = {old: i for i, old in enumerate(dict.fromkeys(olds))}
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    posted = flat(postings["posted"])
    pair = posted.flatten().to_numpy(zero_copy_only=False)
    was, tf = pair >> HALF, pair & ((1 << HALF) - 1)
    from_slot = chunks["was_slot"].to_numpy()
    width = 1 + max(int(was.max(initial=0)), int(from_slot.max(initial=0)))
    at = np.array([nth[old] for old in olds], np.int64) * width + from_slot
    to, length = np.full(len(nth) * width, -1, np.int64), np.zeros(len(nth) * width, np.int64)
    to[at], length[at] = chunks["slot"].to_numpy(), chunks["dl"].to_numpy()
    own = np.array([nth[old] for old in zip(postings["number"].to_pylist(), postings["was_block"].to_pylist())], np.int64)
    n = pc.list_value_length(posted).to_numpy(zero_copy_only=False)
    place = np.repeat(own, n) * width + was
    terms = flat(postings["term"]).dictionary_encode()
    code, slot = np.repeat(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), n), to[place]
    some = np.flatnonzero(slot >= 0)
    some = some[np.lexsort((slot[some], code[some]))]
    block = chunks["block"][0].as_py() if len(chunks) else 0
    return pa.Table.from_arrays(_by_term(block, terms.dictionary, code[some], slot[some], tf[some], length[place[some]]), names=_POSTED)


def merge(spark: SparkSession, path: str, largest: int | None = None) -> int:
    """Writes all segments of `largest` chunks at most (None: all) as one, without replaced postings; returns the commit's number.

    Postings that were dropped but whose terms are still to be taken off are
    recorded beside the segment, so that statistics stay right while larger
    segments hold other replaced chunks; once all are merged nothing is left
    to take off.
    """
    path = path.rstrip("/")
    entry = _latest(spark, path)
    keys = [k for k, _ in entry["keys"]]
    chosen = [s for s in entry["segments"] if largest is None or s["n"] <= largest]
    if len(chosen) < 2 and not (len(chosen) == len(entry["segments"]) == 1 and entry["replaced"]):
        return entry["number"]
    name = f"s{fresh_name()}"
    held = _alive(_chunks(spark, path, entry | {"segments": chosen}), _dead(spark, path, entry), keys)
    place = f"{path}/building/{name}"
    slots = Window.partitionBy("number", "was_block").orderBy("was_slot")
    old = held.select(*keys, "dl", "number", F.col("block").alias("was_block"), F.col("slot").alias("was_slot"))
    placed = materialise(_packed(old))
    built = _built(old.join(placed, ["number", "was_block"]).withColumn("slot", F.col("before") + F.row_number().over(slots) - 1).drop("before"), place)
    rows = _blocks(spark, path, entry | {"segments": chosen}).withColumnRenamed("block", "was_block").select("number", "was_block", "term", "posted")
    moving = rows.join(placed.select("number", "was_block", "block"), ["number", "was_block"])
    moved = moving.groupBy("block").cogroup(built.select("block", "number", "was_block", "was_slot", "slot", "dl").groupBy("block")).applyInArrow(_moved, POSTED)
    _write(built.select(*keys, "dl", "block", "slot").unionByName(moved, True), path, name)
    whole = len(chosen) == len(entry["segments"])
    n, size = sum(s["n"] for s in chosen), sum(s["tokens"] for s in chosen)
    if whole:
        n, size = n - sum(r["n"] for r in entry["replaced"]), size - sum(r["tokens"] for r in entry["replaced"])
    else:
        were = _blocks(spark, path, entry | {"segments": chosen}).groupBy("term").agg(F.sum("n").alias("n"))
        now = _blocks(spark, path, entry | {"segments": [{"name": name, "number": 0}]}).groupBy("term").agg((-F.sum("n")).alias("n"))
        ghosts = [were, now, *[spark.read.parquet(f"{path}/ghosts/{s['name']}") for s in chosen if s["ghosts"]]]
        reduce(DataFrame.unionByName, ghosts).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0").write.parquet(f"{path}/ghosts/{name}")
    Files(spark, path).delete(f"building/{name}")
    segment = {"name": name, "number": entry["number"] + 1, "n": n, "tokens": size, "ghosts": not whole}
    rest = [s for s in entry["segments"] if s not in chosen]
    return CommitLog(spark, path).append(entry["number"], {"keys": entry["keys"], "segments": [*rest, segment], "replaced": [] if whole else entry["replaced"]})


def top(spark: SparkSession, path: str, query: str | list[str], k: int = 5, prefix: str | None = None) -> Search:
    """The k chunks of highest BM25 (keys and score of 4 decimals, ties by keys), the same as from an index built anew, and what was read.

    query is a text, or a list of terms for an index of words of one's own.
    Statistics are the whole index's, also under a prefix of the first key.  A
    query without terms, or an index without segments, has no hits.
    """
    path = path.rstrip("/")
    entry = _latest(spark, path)
    keys = [key for key, _ in entry["keys"]]
    terms = sorted({r[0] for r in spark.range(1).select(F.explode(tokens(F.lit(query)))).collect()} if isinstance(query, str) else set(query))
    if not terms or not entry["segments"]:
        return Search(_chunks(spark, path, entry).select(*(keys or ["source", "ord"]), F.lit(0.0).alias("score")).limit(0), 0, 0)
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    own = _blocks(spark, path, entry).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    # statistics: from the log, and a row a term of the query
    n = sum(s["n"] for s in entry["segments"]) - sum(r["n"] for r in entry["replaced"])
    size = sum(s["tokens"] for s in entry["segments"]) - sum(r["tokens"] for r in entry["replaced"])
    average = size / n if n else 0.0
    off = [(F.lit(-1), f"replaced/{r['name']}/terms") for r in entry["replaced"]] + [(F.lit(1), f"ghosts/{s['name']}") for s in entry["segments"] if s["ghosts"]]
    counts = reduce(DataFrame.unionByName, [own.select("term", F.col("n").cast("bigint").alias("n")), *[spark.read.schema("term string, n bigint").parquet(f"{path}/{p}").where(F.col("term").isin(terms)).select("term", (sign * F.col("n")).alias("n")) for sign, p in off]])
    df = {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = F.coalesce(*[F.when(F.col("term") == t, F.log(F.lit(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))) for t in sorted(df)], F.lit(0.0))
    part = lambda tf, dl: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(average or 1.0))))

    highest = F.array_max(F.transform("best", lambda x: part(_high(x), _low(x))))
    bounds = materialise(own.select("segment", "block", highest.alias("bound")).groupBy("segment", "block").agg(F.sum("bound").alias("bound"), F.count("*").alias("rows")))
    total = bounds.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    chunks = prefix_filter(_alive(_chunks(spark, path, entry), _dead(spark, path, entry), keys), prefix, keys[0])

    def scored(chosen: DataFrame, count: int) -> DataFrame:
        if count <= NAMED:
            some = chosen.select("segment", "block").collect()
            named = reduce(Column.__or__, [(F.col("segment") == s) & F.col("block").isin([r.block for r in some if r.segment == s]) for s in sorted({r.segment for r in some})], F.lit(False))
            pick = lambda t: t.where(named)
        else:
            pick = lambda t: t.join(chosen.select("segment", "block"), ["segment", "block"], "left_semi")
        found = _postings(pick(own)).join(pick(chunks).select(*keys, "dl", "segment", "block", "slot"), ["segment", "block", "slot"])
        parts = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("term", part(F.col("tf"), F.col("dl")).alias("p")))).alias("p"))
        # terms are added in their order, so that sums come out alike however rows are dealt
        return parts.select(*keys, F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["p"]), 4).alias("score"))

    first = scored(bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST), FIRST).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = first.least if first.n >= k else 0.0
    # scores are rounded and their sums too: a bound may lie that much lower and still be met
    left = bounds.where(F.col("bound") >= F.lit(least - 0.0001))
    counted = left.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    return Search(scored(left, counted.blocks).orderBy(F.desc("score"), *keys).limit(k), total, counted.rows)


def search(spark: SparkSession, path: str, query: str | list[str], k: int = 5, prefix: str | None = None) -> DataFrame:
    """The hits of top."""
    return top(spark, path, query, k, prefix).hits
