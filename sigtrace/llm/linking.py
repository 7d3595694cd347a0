"""Connected components of pairs, by alternating stars over checkpointed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sigtrace.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Each round joins edges with their nodes' smallest neighbours, so that no
    node's neighbours are gathered; rounds grow with the logarithm of a
    component's width.  Nothing but two counts comes to the driver.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # a node that gave its other neighbours away stays with the smallest itself
        edges = cut(small.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        twice = edges.groupBy("a").count().where("count > 1").limit(1).count()
        if not twice and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
