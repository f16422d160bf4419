"""Storage shared by driver and executors, and fixed-size membership filters."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (tests, one machine) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="shared-"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and losing executors costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again, not even a repeated task."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Membership:
    """A Bloom filter of a fixed number of bits, so its broadcast has a proven size.

    It only saves work: whatever passes is checked exactly afterwards, and a
    full filter lets everything pass.
    """

    def __init__(self, keys: DataFrame, column: str, log2_bits: int = 23):
        self.log2_bits = log2_bits
        mask = (1 << log2_bits) - 1
        h = F.col(column)
        bit = F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - log2_bits)))
        cells = (
            keys.where(h.isNotNull())
            .select(bit.alias("bit"))
            .groupBy(F.shiftright("bit", 5).alias("cell"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("bits"))
        )
        got = cells.toArrow()
        table = np.zeros(1 << (log2_bits - 5), np.uint32)
        table[got["cell"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def __getstate__(self):
        return {"log2_bits": self.log2_bits, "table": self.table}

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of these 64-bit keys may be members."""
        keys, table = keys.view(np.uint64), self.table.value
        found = np.ones(len(keys), bool)
        for bit in (keys & np.uint64((1 << self.log2_bits) - 1), keys >> np.uint64(64 - self.log2_bits)):
            found &= (table[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
        return found


def mixed(column: Column | str) -> Column:
    """A 64-bit key for Membership from any column."""
    return F.xxhash64(column)


def let(value: Column, body) -> Column:
    """Binds a column expression to a lambda variable, so that it is computed once a row."""
    return F.transform(F.array(value), body)[0]


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, how: str, salts: int = 16) -> DataFrame:
    """rows joined with a table that has each key once: rows of a key are dealt to `salts` tasks by the column spread, and the table's rows go to each."""
    salt = "salt_of_join"
    many = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [*keys, salt], how).drop(salt)


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Numbers rows from 0 in an order without gathering them: they are sorted by ranges, and a row's number is its place in its range plus the rows before."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = store(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "numbered")
    base, before = {}, 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("part").collect():  # a row a partition
        base[r.part] = before - r.first
        before += r.n
    starts = rows.sparkSession.createDataFrame(sorted(base.items()), "part int, base bigint")
    return placed.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("place") + F.col("base")).alias("number"))
