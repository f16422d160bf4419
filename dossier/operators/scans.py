"""Scans in the order of a whole table that carry a state, without putting the table into one task.

Rows are dealt by ranges of their order.  What each range would hand on is one
small row; those rows are folded in order, and each range then begins with what
the ranges before it hand on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialise


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialise(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def _carry(rows: DataFrame, summary: Column, kind: str, fold, start):
    """rows with _carry: what all ranges before a row's own hand on."""
    held, said = start, []
    for r in rows.groupBy("_part").agg(summary.alias("s")).orderBy("_part").collect():  # a row a range
        said.append((r["_part"], held))
        held = fold(held, r["s"])
    table = rows.sparkSession.createDataFrame(said, f"_part int, _carry {kind}")
    return rows.join(F.broadcast(table), "_part")


def last_known(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the last value, in order, that is not null, up to and with the row; null before the first.

    order has columns that tell all rows apart.
    """
    dealt = _ranged(rows, order)
    kind = dict(rows.dtypes)[value]
    last = F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(*order)))
    carried = _carry(dealt, last, kind, lambda held, own: held if own is None else own, None)
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(upto), F.col("_carry"))).select(*rows.columns, name)


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the sum of a whole-number value, in order, up to and with the row; null counts as 0."""
    dealt = _ranged(rows, order)
    carried = _carry(dealt, F.sum(F.coalesce(value, F.lit(0)).cast("bigint")), "bigint", lambda held, own: held + (own or 0), 0)
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.coalesce(value, F.lit(0)).cast("bigint")).over(upto)
    return carried.withColumn(name, own + F.col("_carry")).select(*rows.columns, name)
