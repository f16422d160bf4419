"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task sorts: those of a text column, and of whatever else is in a row.
TASK_BYTES, ROW_BYTES = 1 << 25, 128
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests, one machine) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named.rstrip("/") if named else _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="dossier-"))


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table and reads it back, so that iterations do not pile up plans and survive lost executors."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_size(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """df dealt by keys to the session's number of tasks, or to more where one would sort over TASK_BYTES: tables that grow make more tasks, not larger ones."""
    n = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES).cast("bigint"))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n // TASK_BYTES)), *keys)
