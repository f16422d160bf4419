"""A stored inverted index for BM25: postings by term, rebuilt once a batch, of which a query reads its own terms only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import B, K1, prefix_filter

BUCKETS = 64
#: Tokens that are counted at once; a longer chunk is counted alone.
TOKENS = 1 << 20


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """First row and end of stretches of rows with TOKENS tokens at most, or of one row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOKENS, "right")))
        yield first, end
        first = end


def posted(counted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, dl, term and tf of chunks (keys, dl and their tokens as _t), counted in the chunk's own task: nothing is shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("_t")), 0).to_numpy(zero_copy_only=False)
            for first, end in _parts(sizes):
                part = batch.slice(first, end - first)
                terms = part.column("_t").flatten().dictionary_encode()
                if not len(terms):
                    continue
                many = len(terms.dictionary)
                row = np.repeat(np.arange(end - first, dtype=np.int64), sizes[first:end])
                pair, tf = np.unique(row * many + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at = pa.array(pair // many)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in keys], part.column("dl").take(at), terms.dictionary.take(pa.array(pair % many)), pa.array(tf.astype(np.int32))], names=[*keys, "dl", "term", "tf"])

    kinds = dict(counted.dtypes)
    return counted.select(*keys, "dl", "_t").mapInArrow(task, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", dl int, term string, tf int")


def build(chunks: DataFrame, path: str, keys: tuple[str, ...] = ("source", "ord"), text: str = "text") -> None:
    """Writes postings (term, tf, keys, dl) by buckets of terms, sorted within files, and one row of statistics.

    dl is the chunk's number of tokens; a chunk without tokens has no posting
    but counts in the statistics.  keys name one chunk each.  A frequent term's postings may fill several
    files: they are dealt by term and key.
    """
    counted = chunks.select(*keys, tokens(F.col(text)).alias("_t")).select(*keys, "_t", F.size("_t").alias("dl"))
    dealt = posted(counted, keys).select("term", *keys, "tf", "dl").withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(4)))
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    counted.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.greatest("dl", F.lit(0))), F.lit(0.0)).alias("avg")).write.mode("overwrite").parquet(f"{path}/statistics")


def search(spark: SparkSession, path: str, query: str, k: int = 5, keys: tuple[str, ...] = ("source", "ord"), prefix: str | None = None) -> DataFrame:
    """keys and score (4 decimals) of the k chunks of highest BM25, ties by keys; statistics are the whole index's, also under a prefix."""
    terms = sorted({r[0] for r in spark.range(1).select(F.explode(tokens(F.lit(query)))).collect()})
    postings = spark.read.parquet(f"{path}/postings")
    if not terms:
        return postings.select(*keys, F.lit(0.0).alias("score")).limit(0)
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    own = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    stats = spark.read.parquet(f"{path}/statistics").first()
    df = {r.term: r["count"] for r in own.groupBy("term").count().collect()}  # a row a term of the query
    idf = F.coalesce(*[F.when(F.col("term") == t, F.log(F.lit(1 + (stats.n - df[t] + 0.5) / (df[t] + 0.5)))) for t in sorted(df)], F.lit(0.0))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(stats.avg or 1.0))))
    # terms are added in their order, so that sums come out alike however rows are dealt
    scored = prefix_filter(own, prefix, keys[0]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("term", part.alias("p")))).alias("p"))
    score = F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["p"]), 4)
    return scored.select(*keys, score.alias("score")).orderBy(F.desc("score"), *keys).limit(k)
