"""Exact nearest neighbours of many queries: blocks of queries against blocks of vectors, the best of each task merged in two steps.

Queries go to the workers in blocks of a fixed size, one pass over the vectors
a block.  A task multiplies the block with each batch of its vectors and keeps
k hits a query; hits of some tasks are merged before those of all, so no task
sees k hits of every other one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers in a block of queries (8 bytes each), scores worked out at once, and how many groups of tasks are merged apart.
BLOCK_NUMBERS, AT_ONCE, GROUPS = 4_000_000, 4_000_000, 32


def _unit(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have that width and a length, and these rows scaled to length one."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    fits = np.flatnonzero(lengths == width)
    flat = vectors.take(pa.array(fits)).flatten()
    rows = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(fits), width)
    norm = np.sqrt((rows * rows).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return fits[good], rows[good] / norm[good, None]


def _whole(scores: np.ndarray) -> np.ndarray:
    """Cosines in whole ten-thousandths, halves away from zero."""
    return (np.sign(scores) * np.floor(np.abs(scores) * 10_000 + 0.5)).astype(np.int64)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query, ties by id."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], score[keep], ids[keep]


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "vector", floor: float = 0.0) -> DataFrame:
    """query_id, key, score (cosine, 4 decimals) and rank (from 1) of each query's k nearest vectors; ties by key.

    Both tables have key (a whole number) and vector; a query finds itself if
    it is among the vectors.  Vectors of another width than the query, without
    length or with a null in them are no hits, queries like that have none;
    hits below the floor are dropped after ranking.  Repeated rows are hits as
    often as they come.  The query table passes through the driver block by
    block, never whole.
    """
    spark = vectors.sparkSession
    schema = f"query_id bigint, {key} bigint, units bigint, part int"
    usable = queries.select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where("query_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sizes = {r.width: r["count"] for r in usable.groupBy(F.size("v").alias("width")).count().collect()}  # a row a width
    found = []
    for width, count in sorted(sizes.items()):
        blocks = max(1, -(-count * width // BLOCK_NUMBERS))
        own = usable.where(F.size("v") == width)
        for block in range(blocks):
            some = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
            at, unit = _unit(some["v"].combine_chunks(), width)
            if len(at):
                found.append(_pass(vectors, key, vector, spark.sparkContext.broadcast((some["query_id"].to_numpy()[at], unit)), width, k, schema))
    if not found:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, score double, rank int")
    hits = reduce(DataFrame.unionByName, found)
    order = [F.desc("units"), key]
    some = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", F.col("part") % GROUPS).orderBy(*order))).where(F.col("nth") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    scored = ranked.select("query_id", key, (F.col("units") / 10_000).alias("score"), "rank")
    return scored.where(F.col("score") >= floor) if floor > 0 else scored


def _pass(vectors: DataFrame, key: str, vector: str, block, width: int, k: int, schema: str) -> DataFrame:
    """The k best of each task for a block of queries."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        query_ids, unit = block.value
        query, score, ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        least = np.full(len(query_ids), -(1 << 62))
        step = max(1, AT_ONCE // len(query_ids))
        for batch in batches:
            at, rows = _unit(batch.column(1), width)
            names = np.asarray(batch.column(0))[at]
            for first in range(0, len(rows), step):
                units = _whole(unit @ rows[first : first + step].T)
                q, v = np.nonzero(units >= least[:, None])
                query, score, ids = _best(np.concatenate([query, q]), np.concatenate([score, units[q, v]]), np.concatenate([ids, names[first + v]]), k)
                full = np.flatnonzero(np.bincount(query, minlength=len(least)) >= k)
                ends = np.searchsorted(query, full, "right") - 1
                least[full] = score[ends]
        part = np.full(len(query), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(ids), pa.array(score), pa.array(part)], names=["query_id", key, "units", "part"])

    rows = vectors.select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("v")).where(F.col(key).isNotNull())
    return rows.mapInArrow(task, schema)
