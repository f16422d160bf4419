"""Indexing a folder: files to texts, chunks, vectors, a stored table, parents and postings, with a reason for each file that is left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import encode_meta, frontmatter_map, select_fields, strip
from ..sources import files
from ..sources.scratch import materialise
from . import chunking, postings, segments, snapshots, store
from .convert import html_to_text
from .embedding import Embedder, embed

NO_TEXT = "no extractable text (scanned image without OCR?)"
Extract = Callable[[str, bytes], str]


def plain_text(name: str, content: bytes) -> str:
    """The default extraction: text files as they are, HTML as its text; other kinds need an extractor of the caller's."""
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix in ("html", "htm"):
        return html_to_text(content.decode("utf-8", "replace"))
    if suffix in ("md", "markdown", "txt", "csv", "json"):
        return content.decode("utf-8", "replace")
    raise ValueError(f"no extractor for .{suffix}")


def extracted(found: DataFrame, extract: Extract = plain_text) -> DataFrame:
    """source, text and error of files (source, content): a file whose extraction raises has the type and message as its error."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(source: str, content: bytes) -> tuple[str | None, str | None]:
            try:
                return extract(source, bytes(content)), None
            except Exception as e:  # one bad file is that file's failure
                return None, f"{type(e).__name__}: {e}"

        for frame in frames:
            pairs = [one(s, c) for s, c in zip(frame["source"], frame["content"])]
            yield pd.DataFrame({"source": frame["source"], "text": [p[0] for p in pairs], "error": [p[1] for p in pairs]})

    return found.select("source", "content").mapInPandas(task, "source string, text string, error string")


def relative_source(path: Column, root: str | None) -> Column:
    """A file's name below root, with slashes; without root its whole path.  A path outside of root is an error at run time."""
    plain = F.regexp_replace(path, "^file:/*", "/")
    if root is None:
        return plain
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    return F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).otherwise(F.raise_error(F.concat(plain, F.lit(f" is not below {base}"))))


def index_path(spark: SparkSession, path: str, out: str, embedder: Embedder, *, recursive: bool = True, root: str | None = None, exclude: tuple[str, ...] = (), budget: int = 800, overlap: int = 100, strategy: str = "structure", parent_budget: int | None = None, fields: tuple[str, ...] = (), extract: Extract = plain_text, keep: bool = False) -> dict:
    """Indexes a file or a folder into out: chunks, parents, postings, model and manifest tables.

    A source that is indexed again is replaced whole.  Every failure of one
    file (extraction, embedding) makes that file skipped with its reason; an
    embedder that fails at once on a probe ends the run before anything is
    written.  Model and postings are written once a run, if any file was
    indexed.  With keep, chunks and parents are snapshots and postings segments:
    a run writes what its own files need, and readers keep what they opened;
    without it these tables are replaced in place.  An index stays of the kind
    that it was begun as.  Returns files_seen, files_indexed, files_skipped, total_chunks
    and skipped (source and reason, in order).
    """
    width = len(embedder.embed_query("probe"))
    found = files.scan(spark, path, recursive, exclude).select(relative_source(F.col("path"), root).alias("source"), "content")
    texts = materialise(extracted(found, extract))
    docs = texts.where("error IS NULL").withColumn("text", strip(F.col("text"))).where("text <> ''")
    pieces = chunking.chunk(docs, budget, overlap, strategy, parent_budget)
    composed = pieces.withColumn("chunk", F.col("text")).withColumn("text", chunking.composed(F.col("heading_path"), F.col("text")))
    made = materialise(embed(composed, embedder, error="error"))
    failed = made.where("error IS NOT NULL").groupBy("source").agg(F.min_by("error", "ord").alias("error"))
    meta = docs.select("source", encode_meta(select_fields(frontmatter_map(F.col("text")), list(fields))).alias("meta"))
    good = made.join(failed.select("source"), "source", "left_anti").join(meta, "source").select("source", "ord", "heading_path", "parent_ord", "text", "vector", "meta")
    outcome = texts.select("source", F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(strip(F.col("text")), F.lit("")) == "", F.lit(NO_TEXT)).alias("early")).join(failed, "source", "left")
    outcome = materialise(outcome.select("source", F.coalesce("early", "error").alias("reason")).join(store.manifest(good), "source", "left"))
    totals = outcome.agg(F.count("*").alias("seen"), F.count_if(F.col("reason").isNull()).alias("indexed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")).first()
    if totals.indexed:
        kept = docs.join(failed.select("source"), "source", "left_anti")
        parents = chunking.parents(kept, parent_budget, strategy) if parent_budget else None
        if keep:
            _keep(out, materialise(store.check_width(good, width)), parents)
        else:
            store.write_sources(store.check_width(good, width), f"{out}/chunks")
            if parents is not None:
                store.write_sources(parents, f"{out}/parents")
            held = spark.read.parquet(f"{out}/chunks")
            postings.build(held, f"{out}/index")
            store.manifest(held).write.mode("overwrite").parquet(f"{out}/manifest")
        spark.createDataFrame([(embedder.name, width)], "model string, width int").write.mode("overwrite").parquet(f"{out}/model")
    skipped = [(r.source, r.reason) for r in outcome.where("reason IS NOT NULL").orderBy("source").select("source", "reason").collect()]  # the report itself
    return {"files_seen": totals.seen, "files_indexed": totals.indexed, "files_skipped": totals.seen - totals.indexed, "total_chunks": totals.chunks, "skipped": skipped}


def _keep(out: str, good: DataFrame, parents: DataFrame | None) -> None:
    """Commits chunks as a snapshot and their postings as a segment, which takes off what the sources had before.

    The segment is added last; should that fail, the sources keep their older
    postings until the index is built anew from the chunks.
    """
    spark, table = good.sparkSession, f"{out}/chunks"
    posted = good.select("source", "ord", "text")
    old = None
    if snapshots.latest(spark, table) is not None:
        before = snapshots.read(spark, table).join(good.select("source").distinct(), "source", "left_semi").select("source", "ord", "text")
        old = materialise(before) if not before.isEmpty() else None
    if parents is not None:
        snapshots.commit(parents, f"{out}/parents")
    snapshots.commit(good, table)
    segments.add(posted, f"{out}/index", replaced=old)


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of an index as they are now, of either kind."""
    return snapshots.read(spark, f"{out}/chunks") if snapshots.latest(spark, f"{out}/chunks") is not None else spark.read.parquet(f"{out}/chunks")


def index_file(spark: SparkSession, path: str, out: str, embedder: Embedder, **options) -> dict:
    """Indexes one file: its source, whether it was indexed, its chunks, and otherwise the reason, whatever went wrong.  options are those of index_path."""
    source = relative_path(path, options.get("root"))
    try:
        said = index_path(spark, path, out, embedder, **options)
    except Exception as e:  # one file's failure is its result
        return {"source": source, "indexed": False, "chunks": 0, "reason": f"{type(e).__name__}: {e}"}
    if said["skipped"]:
        return {"source": source, "indexed": False, "chunks": 0, "reason": said["skipped"][0][1]}
    return {"source": source, "indexed": True, "chunks": said["total_chunks"]}


def relative_path(path: str, root: str | None) -> str:
    """What relative_source says of one path."""
    plain = "/" + path.removeprefix("file:").lstrip("/")
    base = "/" + root.removeprefix("file:").strip("/") + "/" if root else ""
    if root and not plain.startswith(base):
        raise ValueError(f"{plain} is not below {base}")
    return plain.removeprefix(base)


def index_model(spark: SparkSession, out: str) -> str | None:
    """The model that an index was built with, or None if there is no index."""
    try:
        row = spark.read.parquet(f"{out}/model").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return row.model if row else None


def sources(spark: SparkSession, out: str) -> DataFrame:
    """source and chunks of everything indexed, in order."""
    return store.manifest(chunks(spark, out)).orderBy("source")


def repair(spark: SparkSession, out: str) -> DataFrame:
    """Compares the recorded manifest with the chunks and records it anew; what doctor said before."""
    held = chunks(spark, out)
    if snapshots.latest(spark, f"{out}/chunks") is not None:
        said = materialise(store.doctor(snapshots.manifest(spark, f"{out}/chunks"), held))
        snapshots.record(spark, f"{out}/chunks")
        return said
    said = materialise(store.doctor(spark.read.parquet(f"{out}/manifest"), held))
    materialise(store.manifest(held)).write.mode("overwrite").parquet(f"{out}/manifest")
    return said
