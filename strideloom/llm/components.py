"""Connected components by alternating stars, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideloom.llm.common import stage


def _near(edges: DataFrame) -> DataFrame:
    """Each node of edges(a, b) with the least of itself and its neighbours."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    return stage(both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")), "near")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, root): each node of an edge with the least node of its component.

    Each round first ties every node's greater neighbours to the least node around it, then every node's lesser
    neighbours and itself to the least of them, until only stars are left; rounds are logarithmic in number for
    graphs met in practice, and nothing but counts comes to the driver. The least neighbours are partial aggregates,
    and they are staged, so that Spark splits the rows of a node of many edges at run time.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    sign = F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))
    before, now = None, edges.agg(*sign).first()
    while before != now:
        near = _near(edges)
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).filter("other > node")
        large = both.join(near, "node").select(F.col("root").alias("a"), F.col("other").alias("b")).distinct()
        large = stage(large, "large")
        least = stage(large.groupBy("b").agg(F.min("a").alias("root")), "least")
        small = large.join(least, "b")
        small = small.select(F.col("root").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        edges = stage(small, "edges")
        before, now = now, edges.agg(*sign).first()
    root = edges.groupBy("b").agg(F.min("a").alias("root"))
    return root.select(F.col("b").alias("node"), "root").union(edges.select("a", "a").distinct())
