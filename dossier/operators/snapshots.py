"""A chunk table kept as snapshots: a write adds files and one log entry, and a reader keeps the snapshot that it opened.

Rows lie in buckets of their source.  A write stores the new rows in a folder
of its own; only buckets that hold an older row of a replaced or deleted source
are written anew, without those rows, and the old files stay as they are.  The
log entry then says which folders each bucket has.  So a failed write leaves
nothing that a reader sees, a reader that opened an earlier snapshot goes on
reading it, and two writers collide only if both change the same bucket.

With each write the counts of its sources are recorded; the manifest is the
last record of each source, kept apart from the rows so that both can be
compared.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.commits import CommitLog, Files, Taken, fresh_name

BUCKETS, BUCKET = 64, "_bucket"
#: So often is a commit tried again after others, as long as they changed other buckets.
RETRIES = 20
#: Layers of recorded counts before they are written as one.
MANIFEST_LAYERS = 16


class Conflict(RuntimeError):
    """Another writer changed a bucket that this write is about."""


@dataclass(frozen=True)
class Snapshot:
    """What one log entry lists: for each bucket the folders that hold its rows, in the order of writing."""

    number: int
    schema: str
    key: str
    buckets: int
    places: dict[int, list[str]] = field(default_factory=dict)
    manifest: list[str] = field(default_factory=list)
    operation: str = "write"

    def content(self) -> dict:
        return {"schema": self.schema, "key": self.key, "buckets": self.buckets, "places": {str(b): f for b, f in sorted(self.places.items()) if f}, "manifest": self.manifest, "operation": self.operation}


def _snapshot(entry: dict) -> Snapshot:
    return Snapshot(entry["number"], entry["schema"], entry["key"], entry["buckets"], {int(b): f for b, f in entry["places"].items()}, entry["manifest"], entry["operation"])


def latest(spark: SparkSession, path: str, number: int | None = None) -> Snapshot | None:
    """The last snapshot of a table, or that of a number; None if there is none."""
    log = CommitLog(spark, path)
    entry = log.latest() if number is None else log.entry(number)
    return None if entry is None else _snapshot(entry)


def _required(spark: SparkSession, path: str, number: int | None) -> Snapshot:
    found = latest(spark, path, number)
    if found is None:
        raise ValueError(f"{path} has no snapshot{'' if number is None else f' {number}'}")
    return found


def history(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """number, operation and buckets with rows of each snapshot that is still listed."""
    log = CommitLog(spark, path)
    return [(n, s.operation, len(s.places)) for n in log.numbers() for s in [_snapshot(log.entry(n))]]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _open(spark: SparkSession, path: str, snapshot: Snapshot, buckets: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(snapshot.schema))
    places = [f"{path.rstrip('/')}/data/{f}/{BUCKET}={b}" for b, folders in sorted(snapshot.places.items()) if buckets is None or b in buckets for f in folders]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None, sources: list | None = None) -> DataFrame:
    """All rows of the last snapshot, or of that of a number; of some sources only their buckets are opened."""
    snapshot = _required(spark, path, number)
    if sources is None:
        return _open(spark, path, snapshot)
    kind = StructType.fromJson(json.loads(snapshot.schema))[snapshot.key].dataType
    wanted = spark.createDataFrame([(s,) for s in sources], StructType().add(snapshot.key, kind))
    buckets = {r[0] for r in wanted.select(_bucket(snapshot.key, snapshot.buckets)).distinct().collect()}
    return _open(spark, path, snapshot, buckets).where(F.col(snapshot.key).isin(sources))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """source and chunks as recorded by the writes up to a snapshot."""
    snapshot = _required(spark, path, number)
    kind = StructType.fromJson(json.loads(snapshot.schema))[snapshot.key].dataType
    schema = StructType().add(snapshot.key, kind).add("chunks", "long").add("layer", "integer")
    if not snapshot.manifest:
        return spark.createDataFrame([], schema).drop("layer")
    layers = [spark.read.schema(schema).parquet(f"{path.rstrip('/')}/data/{name}").withColumn("layer", F.lit(i)) for i, name in enumerate(snapshot.manifest)]
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    return every.groupBy(snapshot.key).agg(F.max_by("chunks", "layer").alias("chunks")).where("chunks > 0")


def _write(rows: DataFrame, path: str, name: str, key: str, buckets: int) -> dict[int, str]:
    """Stores rows by bucket in a new folder; a bucket that outgrows a task is written by several.  Returns the buckets that have rows."""
    dealt = rows.withColumn(BUCKET, _bucket(key, buckets)).hint("rebalance", BUCKET)
    dealt.write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/data/{name}")
    there = Files(rows.sparkSession, path).names(f"data/{name}")
    return {int(n.split("=")[1]): name for n in there if n.startswith(f"{BUCKET}=")}


def commit(fresh: DataFrame | None, path: str, key: str = "source", deleted: DataFrame | None = None, buckets: int = BUCKETS, operation: str | None = None) -> int:
    """Replaces every source of fresh as a whole and deletes those of deleted (its column named key); returns the snapshot's number.

    fresh must have the columns of the table; without a table it begins one,
    with that many buckets.  A source in both is replaced.  An empty fresh
    changes nothing.  Only buckets with an older row of such a source are
    rewritten, so what is new costs its own size.  A null source is a source
    like any other.  Raises Conflict if another writer has changed one of the
    buckets since this write looked at the table.
    """
    given = fresh if fresh is not None else deleted
    if given is None:
        raise ValueError("nothing to write")
    spark, log = given.sparkSession, CommitLog(given.sparkSession, path)
    base = latest(spark, path)
    if base is None:
        if fresh is None:
            raise ValueError(f"{path} has no snapshot")
        base = Snapshot(0, fresh.schema.json(), key, buckets)
    elif fresh is not None:
        have, want = StructType.fromJson(json.loads(base.schema)), fresh.schema
        if sorted((f.name, f.dataType.simpleString()) for f in have) != sorted((f.name, f.dataType.simpleString()) for f in want):
            raise ValueError(f"the table has the columns {have.simpleString()}, the rows {want.simpleString()}")
    key, own = base.key, fresh_name()
    columns = StructType.fromJson(json.loads(base.schema)).names
    new = _write(fresh.select(*columns), path, f"{own}-new", key, base.buckets) if fresh is not None else {}
    stored = spark.read.schema(StructType.fromJson(json.loads(base.schema))).parquet(*[f"{path.rstrip('/')}/data/{n}/{BUCKET}={b}" for b, n in sorted(new.items())]) if new else None
    keys = [t.select(F.col(key).alias("_gone")) for t in (stored, deleted) if t is not None]
    if not keys:
        return base.number
    gone = (keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])).distinct()

    touched = set(new) | ({r[0] for r in deleted.select(_bucket(key, base.buckets)).distinct().collect()} if deleted is not None else set())
    older = _open(spark, path, base, touched).withColumn(BUCKET, _bucket(key, base.buckets))
    same = F.col(key).eqNullSafe(F.col("_gone"))
    hit = {r[0] for r in older.select(key, BUCKET).join(gone, same, "left_semi").select(BUCKET).distinct().collect()}
    kept = _write(_open(spark, path, base, hit).join(gone, same, "left_anti"), path, f"{own}-kept", key, base.buckets) if hit else {}
    counted = _counts(spark, path, base, stored, deleted, own)
    kind = operation or ("delete" if fresh is None else "write")

    for _ in range(RETRIES):
        now = latest(spark, path) or Snapshot(0, base.schema, key, base.buckets)
        if now.number != base.number and any(now.places.get(b) != base.places.get(b) for b in touched):
            raise Conflict(f"snapshot {now.number} of {path} has changed what this write is about")
        places = dict(now.places)
        for b in touched:
            before = ([kept[b]] if b in kept else []) if b in hit else places.get(b, [])
            places[b] = before + ([new[b]] if b in new else [])
        try:
            return log.append(now.number, Snapshot(0, base.schema, key, base.buckets, places, [*now.manifest, counted], kind).content())
        except Taken:
            continue
    raise Conflict(f"{path} is changed too often by others")


def _counts(spark: SparkSession, path: str, base: Snapshot, stored: DataFrame | None, deleted: DataFrame | None, own: str) -> str:
    """Records what this write says of its sources: their counts, 0 for those deleted."""
    key = base.key
    said = [t for t in (
        stored.groupBy(key).agg(F.count("*").alias("chunks")) if stored is not None else None,
        deleted.select(key).distinct().withColumn("chunks", F.lit(0).cast("bigint")) if deleted is not None else None,
    ) if t is not None]
    both = said[0] if len(said) == 1 else said[0].unionByName(said[1])
    both.groupBy(key).agg(F.max("chunks").alias("chunks")).write.parquet(f"{path.rstrip('/')}/data/{own}-counts")
    return f"{own}-counts"


def compact(spark: SparkSession, path: str, layers: int = 1) -> int:
    """Writes each bucket that lies in more folders than layers as one folder, and the recorded counts as one layer; rows stay the same."""
    base = _required(spark, path, None)
    many = {b for b, folders in base.places.items() if len(folders) > layers}
    if not many and len(base.manifest) <= MANIFEST_LAYERS:
        return base.number
    own = fresh_name()
    new = _write(_open(spark, path, base, many), path, f"{own}-kept", base.key, base.buckets) if many else {}
    manifest(spark, path, base.number).write.parquet(f"{path.rstrip('/')}/data/{own}-counts")
    places = {b: [new[b]] if b in new else folders for b, folders in base.places.items()}
    try:
        return CommitLog(spark, path).append(base.number, Snapshot(0, base.schema, base.key, base.buckets, places, [f"{own}-counts"], "compact").content())
    except Taken as e:
        raise Conflict(str(e)) from e


def record(spark: SparkSession, path: str) -> int:
    """Counts the sources of the last snapshot anew and records that in place of what the writes said."""
    base, own = _required(spark, path, None), fresh_name()
    _open(spark, path, base).groupBy(base.key).agg(F.count("*").alias("chunks")).write.parquet(f"{path.rstrip('/')}/data/{own}-counts")
    try:
        return CommitLog(spark, path).append(base.number, Snapshot(0, base.schema, base.key, base.buckets, base.places, [f"{own}-counts"], "record").content())
    except Taken as e:
        raise Conflict(str(e)) from e


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 7 * 86400) -> int:
    """Deletes folders that none of the last `keep` snapshots lists and that were last changed longer ago than older_than seconds, which spares writes under way; returns how many."""
    log = CommitLog(spark, path)
    entries = [log.entry(n) for n in log.numbers()[-max(1, keep):]]
    used = {f for e in entries for folders in e["places"].values() for f in folders} | {f for e in entries for f in e["manifest"]}
    limit = (time.time() - older_than) * 1000
    old = [n for n, changed in log.files.names("data").items() if n not in used and changed <= limit]
    for name in old:
        log.files.delete(f"data/{name}")
    for number in log.numbers():
        if entries and number < entries[0]["number"]:
            log.files.delete(f"_commits/{number:012d}.json")
    return len(old)
