"""Zip archives as a Spark data source: a partition for each slice of members, read where the partition runs."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Uncompressed bytes of the members that one partition reads.
SLICE_BYTES = 16 << 20
MEMBER = "archive string, rel string, size bigint, content binary"


def safe_member(name: str) -> bool:
    """Whether a member's name stays inside its destination: relative, no drive, no step upwards, and not a folder."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ":" not in parts[0] and ".." not in parts and parts[-1] != ""


def _opened(archive: str) -> zipfile.ZipFile:
    system, path = fs.FileSystem.from_uri(archive)
    return zipfile.ZipFile(system.open_input_file(path))


@dataclass
class Members(InputPartition):
    """Some members of one archive, in the order in which they lie there."""

    archive: str
    names: list[str]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.slice_bytes = int(options.get("slicebytes", SLICE_BYTES))
        self.suffix = options.get("suffix", "")

    def archives(self) -> list[str]:
        """The archive that the path names, or all of a folder, by name."""
        where = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        system, path = fs.FileSystem.from_uri(where)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [path] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))
        root = where[: len(where) - len(path.lstrip("/"))] if where.rstrip("/").endswith(path.strip("/")) else "file:///"
        return [root + f.lstrip("/") for f in found]

    def partitions(self) -> list[Members]:
        """Only the archives' tables of contents are read here; an archive set without a member that may be read is an error."""
        out: list[Members] = []
        for archive in self.archives():
            with _opened(archive) as held:
                some, size = [], 0
                for member in sorted(held.infolist(), key=lambda m: m.header_offset):
                    if not safe_member(member.filename) or not member.filename.endswith(self.suffix):
                        continue
                    if some and size + member.file_size > self.slice_bytes:
                        out.append(Members(archive, some))
                        some, size = [], 0
                    some.append(member.filename)
                    size += member.file_size
                if some:
                    out.append(Members(archive, some))
        if not out:
            raise ValueError(f"no archive member to read in {self.path}")
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        with _opened(partition.archive) as held:
            for name in partition.names:
                content = held.read(name)  # checked against the member's checksum
                yield partition.archive, name.replace("\\", "/"), len(content), content


class ZipDataSource(DataSource):
    """format("zip_members"): load a .zip file or a folder of them; options suffix and sliceBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def members(spark: SparkSession, path: str, suffix: str = "", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """archive, rel, size and content of the members of a zip file or of all in a folder, members that would leave their destination left out.

    Members of one name come as often as they are listed, the last one's
    content each time, as archives are read by name.
    """
    spark.dataSource.register(ZipDataSource)
    return spark.read.format("zip_members").option("suffix", suffix).option("sliceBytes", slice_bytes).load(path)


def write_archives(rows: DataFrame, folder: str, per_archive: int = 10_000) -> DataFrame:
    """Writes rows (rel, content) as zip archives below folder, one or more a task, and returns archive and members of each; a repeated task's archive replaces its earlier one."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root, recursive=True)
        number = 0
        held: list[tuple[str, bytes]] = []

        def written() -> pa.RecordBatch:
            nonlocal held, number
            path = f"{root}/{TaskContext.get().partitionId():06d}-{number:04d}.zip"
            with system.open_output_stream(f"{path}.part") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
                for rel, content in held:
                    made.writestr(zipfile.ZipInfo(rel), content, zipfile.ZIP_DEFLATED)
            system.move(f"{path}.part", path)
            number, count, held = number + 1, len(held), []
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["archive", "members"])

        for batch in batches:
            for rel, content in zip(batch.column("rel").to_pylist(), batch.column("content").to_pylist()):
                held.append((rel, content or b""))
                if len(held) == per_archive:
                    yield written()
        if held:
            yield written()

    return rows.select("rel", F.col("content").cast("binary").alias("content")).mapInArrow(task, "archive string, members bigint")
