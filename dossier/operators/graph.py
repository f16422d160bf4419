"""Links between entity pages as a graph, and heading outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_lines, strip
from ..sources.scratch import materialise

# Page types that are nodes.
ENTITY_TYPES = ["案件主体", "法律关系", "法律事实"]
OUTLINE_HEADING = r"^(#{1,6})\s+(.*)$"


def build(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (stem, type), edges (src, dst, both ways) and alias (name, stem).

    pages has path, stem, page_type and aliases; links has stem and target.
    Of pages with one stem the last path counts, of equal aliases the last too.
    """
    entities = pages.where(F.col("page_type").isin(ENTITY_TYPES))
    nodes = entities.groupBy("stem").agg(F.max_by("page_type", "path").alias("type"))
    names = entities.select("path", "stem", F.posexplode(F.concat(F.array("stem"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("i", "name"))
    alias = names.groupBy("name").agg(F.max_by("stem", F.struct("path", "i")).alias("stem"))
    found = links.join(nodes.select("stem"), "stem").join(alias.select(F.col("name").alias("target"), F.col("stem").alias("dst")), "target").select(F.col("stem").alias("src"), "dst").where("src <> dst")
    return nodes, found.union(found.select("dst", "src")).distinct(), alias


def neighbors(edges: DataFrame, nodes: DataFrame, alias: DataFrame, name: str) -> DataFrame:
    """stem and type of all neighbours of a name or alias."""
    stem = alias.where(F.col("name") == name).select(F.col("stem").alias("src"))
    return edges.join(stem, "src").select(F.col("dst").alias("stem")).join(nodes, "stem")


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """One row with the smallest (node by node) of the shortest paths, and hops; no row if there is none.

    Layers of nodes grow from both ends, the smaller one first, until two meet;
    no path goes with them.  Of the layers only nodes on a shortest path are
    kept, and the path takes the smallest of them that follows, hop by hop.
    """
    spark = edges.sparkSession
    edges = materialise(edges.select("src", "dst").distinct())
    schema = "path array<string>, hops int"
    if start == goal:
        return spark.createDataFrame([([start], 0)], schema)
    ahead, back = edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    alone = lambda n: materialise(spark.createDataFrame([(n,)], "node string"))
    # of each end: its layers, their sizes, all nodes that were reached, and the edges to go by
    sides = [[[layer], [1], layer, step] for layer, step in ((alone(start), ahead), (alone(goal), back))]
    met = 0
    while not met:
        side, other = sides if sides[0][1][-1] <= sides[1][1][-1] else sides[::-1]
        layers, sizes, seen, step = side
        grown = layers[-1].join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).join(seen, "node", "left_anti").distinct()
        layers.append(materialise(grown))
        size, met = layers[-1].join(other[0][-1].withColumn("there", F.lit(1)), "node", "left").agg(F.count("*"), F.count("there")).first()
        sizes.append(size)
        if not size:
            return spark.createDataFrame([], schema)
        side[2] = seen.unionByName(layers[-1])
        if len(layers) % 16 == 0:
            side[2] = materialise(side[2])
    meet = sides[0][0][-1].join(sides[1][0][-1], "node", "left_semi")
    (first, sizes, _, _), second = sides[0], sides[1][0]
    kept = [materialise(meet)]
    for layer, size in zip(reversed(first[:-1]), reversed(sizes[:-1])):
        if size == 1:  # the only node of its layer is on every path
            kept.insert(0, layer)
            continue
        nexts = ahead.join(kept[0].select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
        kept.insert(0, materialise(layer.join(nexts, "node", "left_semi")))
    at, path = start, [start]
    for layer in [*kept[1:], *reversed(second[:-1])]:
        at = ahead.where(F.col("src") == at).select(F.col("dst").alias("node")).join(layer, "node", "left_semi").agg(F.min("node")).first()[0]
        path.append(at)
    return spark.createDataFrame([(path, len(path) - 1)], schema)


def headings(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """source, total_lines, level, title and line_start of headings outside fenced code."""
    lines = docs.select(F.col(key).alias("source"), split_lines(F.col(text)).alias("a")).select("source", F.size("a").alias("total_lines"), F.posexplode("a").alias("i", "line"))
    order = Window.partitionBy("source").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fence = strip(F.col("line")).rlike(r"^(```|~~~)")
    open_ = F.sum(fence.cast("int")).over(order) % 2
    level, title = F.length(F.regexp_extract("line", OUTLINE_HEADING, 1)), strip(F.regexp_extract("line", OUTLINE_HEADING, 2))
    named = lines.where(fence | F.col("line").startswith("#")).withColumn("open", open_)  # no other line matters
    return named.where((F.col("open") == 0) & ~fence & F.col("line").rlike(OUTLINE_HEADING) & (title != "")).select("source", "total_lines", level.alias("level"), title.alias("title"), (F.col("i") + 1).alias("line_start"))


def outline(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """source, node_id, parent_id, title, level, line_start and line_end of all headings.

    A heading ends before the next of its level or a higher one; its parent is
    the nearest before it of a higher level.  Both come from running extremes
    of each of the six levels, one pass forwards and one backwards.
    """
    found = headings(docs, key, text)
    forwards = Window.partitionBy("source").orderBy("line_start")
    backwards = Window.partitionBy("source").orderBy(F.desc("line_start"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = found.withColumn("node_id", F.row_number().over(forwards) - 1)
    numbered = numbered.select("*", *[F.max(F.when(F.col("level") == n, F.col("node_id"))).over(past(forwards)).alias(f"before{n}") for n in range(1, 7)])
    numbered = numbered.select("*", *[F.min(F.when(F.col("level") == n, F.col("line_start"))).over(past(backwards)).alias(f"after{n}") for n in range(1, 7)])
    parent = F.array_max(F.array(*[F.when(F.col("level") > n, F.col(f"before{n}")) for n in range(1, 7)]))
    end = F.array_min(F.array(*[F.when(F.col("level") >= n, F.col(f"after{n}")) for n in range(1, 7)]))
    return numbered.select("source", "node_id", parent.alias("parent_id"), "title", "level", "line_start", F.coalesce(end - 1, F.col("total_lines")).alias("line_end"))
