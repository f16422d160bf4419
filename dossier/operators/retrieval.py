"""Retrieval over chunks: exact cosine, BM25, reciprocal-rank fusion, floors and parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens

K1, B, RRF_K, CANDIDATES = 1.2, 0.75, 60, 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a literal query; null for zero vectors or another width."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(dot(vector, vector)) * F.lit(float(sum(x * x for x in query)) ** 0.5)
    return F.when(F.size(vector) == len(query), dot(vector, q) / F.nullif(norm, F.lit(0.0)))


def prefix_filter(chunks: DataFrame, prefix: str | None, source: str = "source") -> DataFrame:
    """Keeps sources under a literal prefix, before any ranking; blank means all."""
    return chunks.where(F.col(source).startswith(F.lit(prefix))) if prefix and prefix.strip() else chunks


def vector_search(chunks: DataFrame, query: list[float], k: int = 5, keys: tuple[str, ...] = ("source", "ord"), prefix: str | None = None, floor: float = 0.0, vector: str = "vector") -> DataFrame:
    """The k chunks of highest cosine (4 decimals, ties by keys), those under the floor dropped after ranking."""
    hits = prefix_filter(chunks, prefix).withColumn("score", F.round(cosine(F.col(vector), query), 4)).where("score is not null")
    hits = hits.orderBy(F.desc("score"), *keys).limit(k)
    return hits.where(F.col("score") >= floor) if floor > 0 else hits


def text_search(chunks: DataFrame, query: str, k: int = 5, keys: tuple[str, ...] = ("source", "ord"), prefix: str | None = None, text: str = "text") -> DataFrame:
    """The k chunks of highest BM25 (4 decimals, ties by keys); statistics are the whole table's.

    Only the query's terms are counted, by array lookups in each row; corpus
    statistics are one row of sums, so no postings are shuffled.
    """
    terms = sorted(set(r[0] for r in chunks.sparkSession.range(1).select(F.explode(tokens(F.lit(query)))).collect()))
    if not terms:
        return chunks.limit(0).withColumn("score", F.lit(0.0))
    counted = chunks.withColumn("_t", tokens(F.col(text)))
    counted = counted.select(*chunks.columns, F.size("_t").alias("_dl"), *[(F.size("_t") - F.size(F.array_remove("_t", t))).alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("_dl").alias("avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (stats.n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        tf = F.col(f"_tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.lit(float(stats.avg or 1.0))))
    found = F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    hits = prefix_filter(counted, prefix).where(found).withColumn("score", F.round(score, 4))
    return hits.select(*chunks.columns, "score").orderBy(F.desc("score"), *keys).limit(k)


def ranked(hits: DataFrame, keys: tuple[str, ...] = ("source", "ord")) -> DataFrame:
    """Adds rank from 0; hits are a channel's few top rows."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *keys)) - 1)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int = 5, keys: tuple[str, ...] = ("source", "ord"), rrf_k: int = RRF_K) -> DataFrame:
    """Sums 1 / (rrf_k + rank) of both channels; ties keep the vector channel's order, then the text channel's.

    The vector hit's columns stand for both.  Without text hits the vector
    hits come back with their cosine; score_kind says which it is.
    """
    v = ranked(vector_hits, keys).withColumn("channel", F.lit(0))
    t = ranked(text_hits, keys).withColumn("channel", F.lit(1))
    rest = [c for c in vector_hits.columns if c not in (*keys, "score")]
    both = v.unionByName(t, allowMissingColumns=True)
    merged = both.groupBy(*keys).agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("rrf"),
        F.max(F.when(F.col("channel") == 0, F.col("score"))).alias("cosine"),
        F.min(F.when(F.col("channel") == 0, F.col("rank"))).alias("vec_rank"),
        F.min(F.when(F.col("channel") == 1, F.col("rank"))).alias("text_rank"),
        *[F.min_by(F.col(c), F.col("channel")).alias(c) for c in rest],
    )
    fused = F.max(F.col("text_rank").isNotNull()).over(Window.partitionBy())
    scored = merged.withColumn("fused", fused).withColumn("raw", F.when(F.col("fused"), F.col("rrf")).otherwise(F.col("cosine")))
    top = scored.orderBy(F.desc("raw"), F.asc_nulls_last("vec_rank"), "text_rank").limit(k)
    return top.select(*keys, *rest, F.round("raw", 6).alias("score"), F.when(F.col("fused"), "rrf").otherwise("cosine").alias("score_kind"), "vec_rank", "text_rank")


def rerank(hits: DataFrame, score: Callable[[Column], Column], k: int) -> DataFrame:
    """Orders hits anew by a scoring expression (a built-in one, or a Pandas UDF that loads its model once a worker)."""
    return hits.withColumn("score", F.round(score(F.col("text")), 6)).orderBy(F.desc("score"), F.asc_nulls_last("vec_rank"), "text_rank").limit(k).withColumn("score_kind", F.lit("rerank"))


def hybrid_search(chunks: DataFrame, query: str, vector: list[float] | None, k: int = 5, keys: tuple[str, ...] = ("source", "ord"), hybrid: bool = True, prefix: str | None = None, floor: float = 0.0, candidates: int = CANDIDATES, rrf_k: int = RRF_K, parents: DataFrame | None = None, reranker=None, index: str | None = None) -> DataFrame:
    """A blank query finds nothing; otherwise vector hits, fused with text hits where asked, reranked and with parents where given.

    index: where postings of the chunks are stored; without it the texts are counted.
    """
    if not query.strip():
        return chunks.limit(0)
    pool = max(k, candidates) if hybrid else k
    hits = vector_search(chunks, vector, pool, keys, prefix, floor)
    if hybrid:
        text_hits = text_search(chunks, query, pool, keys, prefix) if index is None else indexed_hits(chunks, index, query, pool, keys, prefix)
        hits = fuse(hits, text_hits, pool if reranker else k, keys, rrf_k)
    if reranker is not None:
        from .embedding import rerank as by_model

        hits = by_model(hits, reranker, query, k, keys)
    return attach_parents(hits, parents) if parents is not None else hits


def indexed_hits(chunks: DataFrame, index: str, query: str, k: int, keys: tuple[str, ...], prefix: str | None) -> DataFrame:
    """Hits from stored postings, segmented ones or not, with all columns of their chunks; the hits, k at most, are what is broadcast."""
    from ..sources.commits import CommitLog
    from . import postings, segments

    spark = chunks.sparkSession
    segmented = CommitLog(spark, index).latest() is not None
    found = segments.search(spark, index, query, k, prefix) if segmented else postings.search(spark, index, query, k, keys, prefix)
    return chunks.join(F.broadcast(found), list(keys)).select(*chunks.columns, "score")


def gather(question: str, terms: list[str], lines: DataFrame, outlines: DataFrame, search: Callable[[], DataFrame]) -> dict:
    """Three ways to evidence: rag (hits, or why it is not available), grep of exact terms, and outlines.

    search plans the retrieval; if planning or a first look fails, the other
    two ways come back all the same.
    """
    try:
        hits = search()
        hits.limit(1).collect()
        rag = {"available": True, "hits": hits, "reason": ""}
    except Exception as e:  # a channel that fails must not take the others with it
        rag = {"available": False, "hits": None, "reason": f"{type(e).__name__}: {e}"}
    return {"question": question, "rag": rag, "grep": grep_terms(lines, terms), "outline": outlines}


def attach_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds parent_text by (source, parent_ord); null where there is none.  Hits are few, so they are what is broadcast."""
    wanted = hits.select("source", "parent_ord").distinct()
    found = parents.join(F.broadcast(wanted), ["source", "parent_ord"], "left_semi").withColumnRenamed("text", "parent_text")
    return hits.join(found, ["source", "parent_ord"], "left")


def enrich(hits: DataFrame) -> DataFrame:
    """hits (source, text[, heading_path, quality]) with the anchor of their text on one line and whether it is unverified.

    A first paragraph that is the hit's breadcrumb is no part of the source's
    running text, so it is left out of the anchor; text stays as it is.
    """
    from ..functions.text import anchor, bind, single_line

    none = F.lit(None).cast("string")
    heading = F.col("heading_path") if "heading_path" in hits.columns else none
    quality = F.col("quality") if "quality" in hits.columns else none
    folded = lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    led = lambda p: F.coalesce((heading != "") & (F.size(p) == 2) & (folded(p[0]) == heading), F.lit(False))
    body = bind(F.split("text", r"(?U)\n\s*\n", 2), lambda p: F.when(led(p), F.get(p, F.lit(1))).otherwise(F.col("text")))
    return hits.select(*hits.columns, anchor(F.col("source"), single_line(body), quality).alias("anchor"), quality.eqNullSafe(F.lit("suspect")).alias("unverified"))


def index_usable(index_model: str | None, query_model: str) -> tuple[bool, str]:
    """Whether a query's vectors can be compared with the index's, and why not."""
    if index_model is None:
        return False, "the index has never been built"
    if index_model != query_model:
        return False, f"the index was built with {index_model}, queries use {query_model}"
    return True, ""


def grep_terms(lines: DataFrame, terms: list[str], cap: int = 20) -> dict[str, DataFrame]:
    """hits (term, source, line_no, line), not_found and truncated terms, by contained normalised text.

    lines has source, line_no and line; terms are a short list from the caller.
    Each term's first `cap` hits in order of place are kept.
    """
    from ..functions.text import evidence_norm

    spark = lines.sparkSession
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "term_no int, term string").withColumn("norm", evidence_norm(F.col("term")))
    found = lines.withColumn("_n", evidence_norm(F.col("line"))).join(F.broadcast(wanted.where("norm <> ''")), F.expr("contains(_n, norm)"))
    place = Window.partitionBy("term").orderBy("source", "line_no")
    first = found.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= cap + 1)
    return {
        "hits": first.where(F.col("nth") <= cap).select("term", "source", "line_no", "line"),
        "not_found": wanted.join(first.select("term").distinct(), "term", "left_anti").select("term"),
        "truncated": first.where(F.col("nth") == cap + 1).select("term"),
    }
