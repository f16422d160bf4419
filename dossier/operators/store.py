"""Maintenance of a chunk table: replacing sources, manifests, drift and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.scratch import materialise

BUCKETS = 64


def upsert(chunks: DataFrame, fresh: DataFrame, key: str = "source") -> DataFrame:
    """chunks with every source of fresh replaced as a whole; both have the same columns."""
    return chunks.join(fresh.select(key).distinct(), key, "left_anti").select(*fresh.columns).unionByName(fresh)


def delete_source(chunks: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    return chunks.join(sources.select(key).distinct(), key, "left_anti")


def write_sources(fresh: DataFrame, path: str, key: str = "source", buckets: int = BUCKETS) -> None:
    """Replaces the sources of fresh in a stored table, rewriting in place only the buckets that they fall in; snapshots.commit does so without touching what readers have open."""
    spark = fresh.sparkSession
    bucketed = fresh.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        old = spark.read.parquet(path)
        touched = bucketed.select("bucket").distinct()
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(bucketed.select(key).distinct(), key, "left_anti")
        bucketed = materialise(kept.select(*bucketed.columns).unionByName(bucketed))  # the table cannot be read and overwritten at once
    bucketed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_meta(file: Column, chunk: Column) -> Column:
    """A file's and a chunk's fields as one map; where both have a field the chunk's counts, and null is an empty map."""
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(chunk, none)
    return bind(own, lambda c: F.map_concat(F.map_filter(F.coalesce(file, none), lambda k, v: ~F.map_contains_key(c, k)), c))


def check_width(vectors: DataFrame, width: int, vector: str = "vector") -> DataFrame:
    """The rows, with an error at run time for a vector of another width."""
    return vectors.withColumn(vector, F.when(F.size(vector) == width, F.col(vector)).otherwise(F.raise_error(F.format_string("vector has width %d, the table %d", F.size(vector), F.lit(width)))))


def manifest(chunks: DataFrame, key: str = "source") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"))


def drift(recorded: DataFrame, actual: DataFrame, key: str = "source") -> DataFrame:
    """Sources whose recorded count is not the actual one; null stands for absent."""
    both = recorded.select(key, F.col("chunks").alias("recorded")).join(actual.select(key, F.col("chunks").alias("actual")), key, "full_outer")
    return both.where(~F.col("recorded").eqNullSafe(F.col("actual")))


def doctor(recorded: DataFrame, chunks: DataFrame, key: str = "source") -> DataFrame:
    """One row: in_sync, and sources and chunks as recorded and as they are."""
    both = recorded.select(key, F.col("chunks").alias("r")).join(manifest(chunks, key).select(key, F.col("chunks").alias("a")), key, "full_outer")
    return both.agg(
        F.coalesce(F.bool_and(F.col("r").eqNullSafe(F.col("a"))), F.lit(True)).alias("in_sync"),
        F.count("r").alias("recorded_sources"), F.coalesce(F.sum("r"), F.lit(0)).alias("recorded_chunks"),
        F.count("a").alias("actual_sources"), F.coalesce(F.sum("a"), F.lit(0)).alias("actual_chunks"),
    )


def stats(chunks: DataFrame, index_model: str | None, query_model: str, key: str = "source") -> DataFrame:
    return chunks.agg(F.count_distinct(key).alias("documents"), F.count("*").alias("chunks")).withColumn("index_model", F.lit(index_model)).withColumn("query_model", F.lit(query_model)).withColumn("usable", F.lit(index_model is not None and index_model == query_model))
