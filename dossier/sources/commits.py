"""A log of commits beside stored files: who opens an entry keeps what it lists, and a write counts from the moment its entry is there.

An entry is one small JSON file named by its number.  It is written under
another name first and then renamed, which fails if the number is there
already: of two writers one takes it and the other finds it taken, and no
reader sees half an entry.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_commits"


class Taken(RuntimeError):
    """Another writer has committed under this number."""


class Files:
    """What a log and its tables need of the file system that a path names, whichever it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.root, self.conf = root.rstrip("/"), spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> dict[str, int]:
        """Names in a folder and when each was last changed (milliseconds); none if there is no such folder."""
        place = self.path(folder)
        if not self.system.exists(place):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self.system.listStatus(place)}

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Puts a whole file under a name that no file has; FileExistsError if one has it."""
        part = self.path(f"{name}.{fresh_name()}.tmp")
        stream = self.system.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop
        kind = getattr(hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.NONE
        place = self.system.makeQualified(self.path(name))
        try:
            hadoop.fs.FileContext.getFileContext(place.toUri(), self.conf).rename(self.system.makeQualified(part), place, how)
        except Exception as e:
            self.system.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(name) from e
            raise

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def fresh_name() -> str:
    return uuid.uuid4().hex


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(FOLDER) if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def entry(self, number: int) -> dict | None:
        name = f"{FOLDER}/{number:012d}.json"
        return json.loads(self.files.read(name)) if self.files.system.exists(self.files.path(name)) else None

    def latest(self) -> dict | None:
        numbers = self.numbers()
        return self.entry(numbers[-1]) if numbers else None

    def append(self, after: int, content: dict) -> int:
        """Commits content as the entry that follows `after` (0: none); raises Taken if there is one already."""
        number = after + 1
        try:
            self.files.create(f"{FOLDER}/{number:012d}.json", json.dumps(content | {"number": number, "parent": after}))
        except FileExistsError as e:
            raise Taken(f"entry {number} is another writer's") from e
        return number
