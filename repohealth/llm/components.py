"""Connected components of links as DataFrame rounds; nothing is collected to the driver but a flag a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repohealth.llm.common import cut, drop


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b longs); root is the least node that is reachable.

    Alternating large and small stars: every round hangs the neighbours of a node under its least neighbour, so that
    rounds grow with the logarithm of the longest path; it ends when a round changes nothing. Rounds are cut by tables
    in the shared folder. A node with very many links is one row a task in the minimum, and the join can be split.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m")).withColumn("m", F.least("m_u", "m")), label)
        # large star: larger neighbours go under the least one
        large = cut(both.where("v > u").join(least, F.col("u") == F.col("m_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), label)
        # small star: smaller neighbours and the node itself go under the least one
        small = cut(large.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m")), label)
        hung = large.join(small, F.col("u") == F.col("m_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(hung.unionByName(small.select(F.col("m_u").alias("u"), F.col("m").alias("v"))).distinct(), label)
        same = edges.count() == after.count() and not after.join(edges, ["u", "v"], "left_anti").take(1)
        drop(edges, least, large, small)
        edges = after
        if same:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
