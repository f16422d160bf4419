"""Connected components by minimum labels, as DataFrame joins with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node in edges (a, b).

    Each round a node takes the smallest label among its neighbours', then the
    label of that label, so long chains shrink by halves and not by steps.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "least").alias("next"))
        # every node of a tree hands its root the smallest label that it has seen
        roots = hooked.groupBy(F.col("component").alias("root")).agg(F.min("next").alias("lower"))
        lowered = hooked.join(roots, hooked["next"] == roots["root"], "left").select("node", "component", F.least("next", "lower").alias("next"))
        again = store(lowered, "labels")
        changed = again.where("next <> component").limit(1).count()
        labels = again.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
