"""Queries over tables that the engine keeps itself: snapshots, segmented postings, streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import neighbours, segmentation, segments, snapshots
from ..sources import archives
from ..sources.scratch import folder
from ..streaming import changes, incremental
from .documents import K, QUERY, _bm25_sql, table


def _place(spark, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid4().hex}"


def snapshot_versions(spark, d):
    """Three writes to one table, each read back from its own snapshot: all but src3; src1 and src4 replaced by half of their rows; src2 deleted and src3 new."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), "text")
    path = _place(spark, "snapshots")
    changed = docs.where("source IN ('src1', 'src4') AND ord % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    gone = spark.createDataFrame([("src2",)], "source string")
    numbers = [
        snapshots.commit(docs.where("source <> 'src3'"), path, buckets=16),
        snapshots.commit(changed, path),
        snapshots.commit(docs.where("source = 'src3'"), path, deleted=gone),
    ]
    versions = []
    for n in numbers:
        rows, counted = snapshots.read(spark, path, n), snapshots.manifest(spark, path, n)
        versions.append(rows.join(F.broadcast(counted), "source").select(F.lit(n).cast("bigint").alias("version"), "source", "ord", F.md5("text").alias("hash"), F.col("chunks").alias("recorded")))
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


_VERSIONS = """
WITH a AS (SELECT source, doc_id AS ord, text FROM documents WHERE source <> 'src3'),
n AS (SELECT source, doc_id AS ord, 'new ' || text AS text FROM documents WHERE source IN ('src1', 'src4') AND doc_id % 2 = 0),
b AS (SELECT * FROM a WHERE source NOT IN (SELECT source FROM n) UNION ALL SELECT * FROM n),
c AS (SELECT * FROM b WHERE source <> 'src2' UNION ALL SELECT source, doc_id, text FROM documents WHERE source = 'src3'),
v AS (SELECT 1 AS version, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM c)
SELECT CAST(version AS BIGINT) AS version, source, ord, md5(text) AS hash, count(*) OVER (PARTITION BY version, source) AS recorded FROM v"""


def _segmented(spark, d):
    """An index of all documents in three batches: the second replaces what the first had of src1, the two smaller ones are merged."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), "text")
    path = _place(spark, "segments")
    old = docs.where("source = 'src1'").withColumn("text", F.concat(F.lit("the 555 quarterly "), "text"))
    segments.add(docs.where("ord % 3 = 0 AND source <> 'src1'").unionByName(old), path)
    segments.add(docs.where("ord % 3 = 1 OR source = 'src1'"), path, replaced=old)
    segments.add(docs.where("ord % 3 = 2 AND source <> 'src1'"), path)
    return path


def bm25_segments_topk(spark, d):
    """The same as bm25_topk from segmented postings, of which only blocks that can hold a hit are read."""
    return segments.search(spark, _segmented(spark, d), QUERY, K).select("source", "ord", "score")


def bm25_merged_topk(spark, d):
    """The same again after all segments were merged, under a prefix."""
    path = _segmented(spark, d)
    segments.merge(spark, path)
    return segments.search(spark, path, QUERY, K, prefix="src1").select("source", "ord", "score")


def cosine_topk_many(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 20, among all."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = neighbours.neighbours(vectors.where("vec_id % 20 = 0"), vectors, 10)
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


_NEAREST = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
 (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""

#: Ideographs that stand for letters, in a row: texts in them have no spaces.
_FIRST_IDEOGRAPH = 0x4E00
LETTERS = "abcdefghijklmnopqrstuvwxyz"
IDEOGRAPHS = "".join(chr(_FIRST_IDEOGRAPH + i) for i in range(len(LETTERS)))


def word_segmentation(spark, d):
    """The words of all documents, written in ideographs without spaces, found again by a lexicon of the benchmark's words."""
    written = F.translate(F.regexp_replace(F.lower("text"), "[^a-z\n]+", ""), LETTERS, IDEOGRAPHS)
    items = table(spark, d, "benchmark").select(F.translate(F.lower("text"), LETTERS, IDEOGRAPHS).alias("text"))
    apart = items.select(F.explode(F.regexp_extract_all("text", F.lit("[\\x{4E00}-\\x{9FFF}]+"), F.lit(0))).alias("word"))
    lexicon = segmentation.Lexicon.of(apart.groupBy("word").agg(F.count("*").alias("n")))
    docs = table(spark, d, "documents").select("doc_id", written.alias("text"))
    found = segmentation.with_words(docs, lexicon)
    return found.select("doc_id", F.size("words").cast("bigint").alias("words"), F.md5(F.array_join("words", " ")).alias("hash"))


def stream_changes(spark, d):
    """Three drops of versions of all documents, taken by two runs of a stream: the second repeats half of them unchanged and changes every fourth, the third is older than both."""
    root = _place(spark, "versions")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text", "doc_id")
    drop = lambda rows, at, name: rows.select("source", F.lit(at).cast("timestamp").alias("modified"), "text").write.parquet(f"{root}/in/{name}")
    drop(docs, "2024-01-02 00:00:00", "drop=1")
    first = changes.ingest(spark, f"{root}/in", f"{root}/table", f"{root}/checkpoint")
    drop(docs.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("changed "), "text")).otherwise(F.col("text"))), "2024-01-03 00:00:00", "drop=2")
    drop(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("too old")), "2024-01-01 00:00:00", "drop=3")
    second = changes.ingest(spark, f"{root}/in", f"{root}/table", f"{root}/checkpoint")
    return snapshots.read(spark, f"{root}/table").select("source", F.md5("text").alias("hash"), F.lit(first + second).cast("bigint").alias("batches"))


def stream_windows(spark, d):
    """Hourly counts of events by type, of the windows that a stream with a watermark of a day has closed, taken in two runs."""
    root = _place(spark, "windows")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    half = events.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2)).first()[0] or 0
    found = None
    for name, part in (("drop=1", F.col("event_id") <= half), ("drop=2", F.col("event_id") > half)):
        events.where(part).coalesce(4).write.parquet(f"{root}/in/{name}")
        found = incremental.windowed_counts(spark, f"{root}/in", schema, f"{root}/out", f"{root}/checkpoint")
    return found.select(F.col("window_start").cast("string").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


_WINDOWS = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"""


def zip_members(spark, d):
    """All documents written as members of zip archives, beside some that would leave their destination, and read back by slices."""
    root = _place(spark, "archives")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    name = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("../"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("case/"), F.col("doc_id").cast("string"), F.lit(".md")))
    archives.write_archives(docs.select(name.alias("rel"), "content"), root, 2000).agg(F.sum("members")).collect()
    found = archives.members(spark, root, ".md")
    return found.select(F.regexp_extract("rel", "([0-9]+)", 1).cast("bigint").alias("doc_id"), "size", F.md5("content").alias("hash"))


CATALOGUE = {
    "zip_members": (zip_members, "SELECT doc_id, octet_length(encode(text)) AS size, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 3"),
    "stream_changes": (stream_changes, "SELECT CAST(doc_id AS VARCHAR) AS source, md5(CASE WHEN doc_id % 4 = 0 THEN 'changed ' || text ELSE text END) AS hash, CAST(2 AS BIGINT) AS batches FROM documents"),
    "stream_windows": (stream_windows, _WINDOWS),
    "bm25_segments_topk": (bm25_segments_topk, _bm25_sql()),
    "bm25_merged_topk": (bm25_merged_topk, _bm25_sql("AND starts_with(c.source, 'src1')")),
    "cosine_topk_many": (cosine_topk_many, _NEAREST),
    "word_segmentation": (word_segmentation, None),
    "snapshot_versions": (snapshot_versions, _VERSIONS),
}
