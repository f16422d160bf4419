"""K-d tree sharding: weighted median splits along the widest metadata dimension.

Every row is a point (log size, language, source) with its size as weight.  A
node is split at the weighted median of the dimension in which it is widest,
until leaves have at most the target bytes.  Medians come from distributed
histograms: a node's rows are counted by bits of a 63-bit key (24 bits of the
dimension, 39 of the text's hash); the bin that holds the median is refined
until what it weighs no longer matters, or it is one text.  So no node is
sorted or gathered.  Equal texts have equal keys and stay together, unless
they outweigh a leaf: such a group is cut in two in the same way by the hash
of the id.  All of it is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, salted_join, store

BIN_BITS, KEY_BITS, TEXT_BITS, TOLERANCE = 12, 63, 39, 0.002
DIMENSIONS = 3


@dataclass
class Search:
    """Where the median of one node lies so far."""

    total: int
    before: int = 0
    prefix: int = 0
    threshold: int | None = None
    weight: int = 0  # of the bin in which the search ended


def _pick(values: list, node: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (node + 1).cast("int"))


def _key(dimension: list[int], node: Column) -> Column:
    chosen = F.element_at(F.array("d0", "d1", "d2"), _pick([d + 1 for d in dimension], node, "int"))
    return F.shiftleft(chosen, TEXT_BITS).bitwiseOR(F.col("text_key"))


def _medians(rows: DataFrame, key: Column, search: dict[int, Search], goals: dict[int, float]) -> None:
    """Finds for each node the key at which its weight is cut most evenly; threshold stays open where one key weighs too much, and prefix is that key."""
    shift, open_ = KEY_BITS, set(search)
    while open_ and shift:
        last, shift = shift, max(0, shift - BIN_BITS)
        nodes = max(search) + 1
        prefix = [search[n].prefix if n in open_ else -1 for n in range(nodes)]
        counted = (
            rows.withColumn("key", key)
            .where(F.shiftright("key", last) == _pick(prefix, F.col("node"), "bigint") if last < KEY_BITS else F.col("node").isin(sorted(open_)))
            .groupBy("node", F.shiftright("key", shift).alias("bin"))
            .agg(F.sum("size").alias("weight"))
            .collect()  # at most 2 ** BIN_BITS rows a node
        )
        for n in sorted(open_):
            s, seen = search[n], search[n].before
            s.weight = 0
            for bin_, weight in sorted((r.bin, r.weight) for r in counted if r.node == n):
                if seen + weight >= goals[n]:
                    s.prefix, s.before, s.weight = bin_, seen, weight
                    if weight <= TOLERANCE * s.total:
                        s.threshold = (bin_ if goals[n] - seen <= seen + weight - goals[n] else bin_ + 1) << shift
                        open_.discard(n)
                    break
                seen += weight
            else:
                s.threshold = (1 << KEY_BITS) - 1
                open_.discard(n)


def shard(docs: DataFrame, leaves: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """Assigns every row to a leaf: doc_id, size, text_crc32, shard and slot.

    leaves: how many, a power of two; else target_bytes decides: nodes are
    split while the mean leaf is heavier.  A null text has no bytes and counts
    as size 1; null language or source is a value of its own.  Equal texts get
    one shard, unless together they outweigh a leaf; rows with equal ids and
    texts always do.  An empty table gives no rows.  Other columns, whatever
    their names, are not read.
    """
    text = F.coalesce("text", F.lit(""))
    spread = lambda c: F.shiftright(F.coalesce(F.crc32(F.col(c).cast("string")), F.lit(0)), 8)
    raw = (
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.least(F.floor(F.log2(F.octet_length(text) + 1.0) * (1 << 19)), F.lit((1 << 24) - 1)).cast("bigint").alias("d0"),
            (spread("lang") if "lang" in docs.columns else F.lit(0)).cast("bigint").alias("d1"),
            (spread("source") if "source" in docs.columns else F.lit(0)).cast("bigint").alias("d2"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS).alias("text_key"),
            F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("id_key"),
        )
    )
    # copies take the metadata of one of them, so that they are one point; few groups differ in it
    group = raw.groupBy("text_key").agg(*[f(d).alias(f"{n}_{d}") for d in ("d1", "d2") for n, f in (("least", F.min), ("most", F.max))])
    mixed = group.where("least_d1 < most_d1 OR least_d2 < most_d2").select("text_key", "least_d1", "least_d2")
    joined = salted_join(raw, mixed, ["text_key"], "id_key", "left")
    points = store(joined.select("doc_id", "size", "text_crc32", "d0", F.coalesce("least_d1", "d1").alias("d1"), F.coalesce("least_d2", "d2").alias("d2"), "text_key", "id_key"), "kd-points")
    rows, depth, level = points.withColumn("node", F.lit(0).cast("bigint")), None, 0
    while True:
        stats = rows.groupBy("node").agg(F.sum("size").alias("total"), *[f(f"d{i}").alias(f"{f.__name__}{i}") for i in range(DIMENSIONS) for f in (F.min, F.max)]).collect()
        if depth is None:
            total = stats[0].total if stats else 0
            wanted = leaves or max(1, -(-total // target_bytes))
            depth = (wanted - 1).bit_length()
            whole = [max(1, stats[0][f"max{i}"] - stats[0][f"min{i}"]) if stats else 1 for i in range(DIMENSIONS)]
        if level == depth or not stats:
            break
        count = max(r.node for r in stats) + 1
        dimension = [0] * count
        for r in stats:
            dimension[r.node] = max(range(DIMENSIONS), key=lambda i: ((r[f"max{i}"] - r[f"min{i}"]) / whole[i], -i))
        key = _key(dimension, F.col("node"))
        search = {r.node: Search(r.total) for r in stats}
        _medians(rows, key, search, {r.node: r.total / 2 for r in stats})
        # a text that holds the median goes to one side whole, or is cut by id where it outweighs a leaf
        second = {}
        for n, s in search.items():
            if s.threshold is None:
                goal = s.total / 2 - s.before
                if s.weight > total / 2**depth:
                    second[n] = Search(s.weight), goal
                else:
                    s.threshold = s.prefix + (2 * goal > s.weight)
        if second:
            held = rows.withColumn("key", key).where(F.col("key") == _pick([search[n].prefix if n in second else -1 for n in range(count)], F.col("node"), "bigint"))
            _medians(held, F.col("id_key"), {n: s for n, (s, _) in second.items()}, {n: g for n, (_, g) in second.items()})
        ways = []
        for n in range(count):
            s, by_id = search.get(n), 0
            if n in second:
                by_id = second[n][0].threshold if second[n][0].threshold is not None else second[n][0].prefix + 1
            at = 0 if s is None else s.prefix if n in second else s.threshold
            ways.append(F.struct(F.lit(dimension[n] + 1).alias("d"), F.lit(at).cast("bigint").alias("at"), F.lit(by_id).cast("bigint").alias("by_id")))
        # each value is bound once, or the expression would double with every level
        right = lambda way: let(F.shiftleft(F.element_at(F.array("d0", "d1", "d2"), way["d"]), TEXT_BITS).bitwiseOR(F.col("text_key")), lambda k: (k > way["at"]) | ((k == way["at"]) & (F.col("id_key") >= way["by_id"])))
        rows = rows.withColumn("node", let(F.col("node"), lambda n: n * 2 + let(F.element_at(F.array(*ways), (n + 1).cast("int")), right).cast("bigint")))
        level += 1
    return with_slots(rows.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard")))


def with_slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0 without gathering a shard in one task.

    Rows are sorted by ranges; a row's slot is its place in its partition's
    part of the shard plus the sizes of the parts before it.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, "shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32")
    placed = store(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "kd-placed")
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()  # shards + partitions rows at most
    base, offset = {}, {}
    for r in sorted(parts, key=lambda r: (r.shard, r.part)):
        base[r.shard, r.part] = offset.get(r.shard, 0) - r.first
        offset[r.shard] = offset.get(r.shard, 0) + r.n
    spark = rows.sparkSession
    starts = spark.createDataFrame([(s, p, b) for (s, p), b in base.items()], "shard int, part int, base bigint")
    return placed.join(F.broadcast(starts), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("base")).alias("slot"))
