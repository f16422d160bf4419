"""Files as tables, and tables as files."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.convert import JUNK, safe_asset
from .commits import Files

# Suffixes that are indexed.
SUFFIXES = ["pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "html", "htm", "md", "markdown", "txt", "csv", "json", "epub"]


def scan(spark: SparkSession, root: str, recursive: bool = True, exclude: tuple[str, ...] = (), suffixes: list[str] | None = SUFFIXES) -> DataFrame:
    """path, rel, modificationTime, length and content of files under root, junk and excluded names left out; content is only read if used.

    A root that is a file is that one file, whatever its suffix or name; one
    that is not there raises FileNotFoundError.
    """
    place = Files(spark, root)
    if not place.system.exists(place.path("")):
        raise FileNotFoundError(f"there is no {root}")
    one = place.system.getFileStatus(place.path("")).isFile()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    if one:
        return found.withColumn("rel", F.regexp_extract("path", r"([^/]*)$", 1))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    keep = ~name.isin(JUNK)
    if suffixes is not None:
        keep = keep & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(suffixes)
    for glob in exclude:
        keep = keep & ~name.rlike(translate(glob))
    # the root as its file system names it, so that nothing in it is read as a pattern
    base = place.system.makeQualified(place.path("")).toUri().getPath().rstrip("/") + "/"
    rel = F.substr("path", F.locate(base, F.col("path")) + F.lit(len(base)))
    return found.where(keep).withColumn("rel", rel)


def texts(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path and text of whole text files."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """turn, role and text of a JSONL transcript; lines that do not parse are skipped, text blocks are joined."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("turn"), F.try_parse_json("value").alias("v")).where("v is not null")
    plain = F.expr("try_variant_get(v, '$.message.content', 'string')")
    blocks = F.expr("try_variant_get(v, '$.message.content', 'array<struct<type:string,text:string>>')")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return lines.select("turn", F.expr("try_variant_get(v, '$.type', 'string')").alias("role"), F.coalesce(joined, plain).alias("text"))


def concatenated(files: DataFrame) -> DataFrame:
    """One row: the texts of files (path, text) in path order, a blank line between."""
    return files.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def safe_members(members: DataFrame) -> DataFrame:
    """Archive members that stay inside their destination."""
    return members.where(safe_asset(F.col("rel")))


def json_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_files(outputs: DataFrame, root: str) -> DataFrame:
    """Writes each row (rel, text, assets: map of names to bytes) as a file below root with its assets beside it; rel and written, the files of the row.

    Tasks write through the file system that root names, to a temporary name
    first, so a reader never sees half a file and a repeated task does no harm.
    Names that leave the folder are not written.
    """
    from collections.abc import Iterator

    import pandas as pd

    assets = "assets" if "assets" in outputs.columns else F.create_map().cast("map<string,binary>").alias("assets")
    rows = outputs.select("rel", "text", assets).where(safe_asset(F.col("rel")))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")

        def put(rel: str, data: bytes) -> None:
            place = posixpath.join(base, rel)
            system.create_dir(posixpath.dirname(place), recursive=True)
            part = posixpath.join(posixpath.dirname(place), f".{posixpath.basename(place)}.{uuid.uuid4().hex}.tmp")
            with system.open_output_stream(part) as out:
                out.write(data)
            system.move(part, place)

        def safe(rel: str) -> bool:
            return bool(rel) and not rel.startswith(("/", "\\")) and ":" not in rel and ".." not in rel.replace("\\", "/").split("/")

        for frame in frames:
            written = []
            for rel, text, beside in zip(frame["rel"], frame["text"], frame["assets"]):
                put(rel, (text or "").encode())
                names = [rel]
                for name, data in dict(beside or {}).items():
                    if safe(name):
                        put(posixpath.join(posixpath.dirname(rel), name), bytes(data))
                        names.append(posixpath.join(posixpath.dirname(rel), name))
                written.append(names)
            yield pd.DataFrame({"rel": frame["rel"], "written": written})

    return rows.mapInPandas(task, "rel string, written array<string>")
