"""Ingestion that knows what it has taken: a stream of versions, of which only changed sources reach the table.

Of each source the time and hash of the version that was taken last are known.
A version that is older, or has the same content, is skipped; any other one
replaces the source.  What is known lies in layers beside the stream's
progress, one a batch, and a batch meets them in a join.  So a restart goes on
where the last run ended, and a batch that is run again reads the layers before
its own and commits the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots
from ..sources.commits import Files

VERSION = "source string, modified timestamp, text string"
KNOWN = "source string, modified timestamp, hash string"
#: Layers of what is known before they are written as one.
LAYERS = 16


def changed(versions: DataFrame, known: DataFrame | None) -> DataFrame:
    """Of versions (source, modified, text) the last of each source that is later than the known one (source, modified, hash), with its hash and whether that differs (fresh).

    Of versions of one time the one with the larger hash counts; a null text
    is a version without content; versions without a source or a time are left
    out.
    """
    rows = versions.where("source IS NOT NULL AND modified IS NOT NULL").select("source", "modified", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    mark = F.struct("modified", "hash")
    last = rows.groupBy("source").agg(F.max_by(F.struct("modified", "hash", "text"), mark).alias("v")).select("source", "v.*")
    if known is None:
        return last.withColumn("fresh", F.lit(True))
    before = known.groupBy("source").agg(F.max(mark).alias("was"))
    met = last.join(before, "source", "left")
    return met.where(F.col("was").isNull() | (mark > F.col("was"))).withColumn("fresh", ~F.col("was.hash").eqNullSafe(F.col("hash"))).drop("was")


def _known(spark: SparkSession, checkpoint: str, number: int) -> DataFrame | None:
    """What the batches before a number have left, all layers of it."""
    place = f"{checkpoint.rstrip('/')}/known"
    there = sorted(int(n) for n in Files(spark, place).names("") if n.isdigit() and int(n) < number)
    whole = [n for n in there if n % LAYERS == LAYERS - 1]  # such a layer has all that was known
    used = [n for n in there if not whole or n >= whole[-1]]
    return spark.read.schema(KNOWN).parquet(*[f"{place}/{n}" for n in used]) if used else None


def _as_one_chunk(rows: DataFrame) -> DataFrame:
    return rows.select("source", F.lit(0).alias("ord"), "text")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = _as_one_chunk, buckets: int = snapshots.BUCKETS, files_a_batch: int | None = None) -> int:
    """Takes the Parquet files of versions in folder that were not taken before, and commits what changed; returns how many batches changed the table.

    prepare makes chunks (with a column source) of changed versions; a source
    of which it makes none is deleted.  Each batch is one snapshot.
    """
    changes = 0

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal changes
        known = _known(spark, checkpoint, number)
        last = changed(rows, known).persist()  # read for the table and for the layer, made once
        try:
            taken = last.where("fresh").select("source", "modified", "text")
            if not taken.isEmpty():
                chunks = prepare(taken)
                gone = taken.select("source") if snapshots.latest(spark, target) is not None else None
                snapshots.commit(chunks, target, deleted=gone, buckets=buckets, operation=f"batch {number}")
                changes += 1
            layer = last.select("source", "modified", "hash")
            if number % LAYERS == LAYERS - 1 and known is not None:
                layer = layer.unionByName(known).groupBy("source").agg(F.max(F.struct("modified", "hash")).alias("v")).select("source", "v.*")
            layer.write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}/known/{number}")
        finally:
            last.unpersist()

    stream = spark.readStream.schema(VERSION)
    if files_a_batch:
        stream = stream.option("maxFilesPerTrigger", files_a_batch)
    run = stream.parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return changes
