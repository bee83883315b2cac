"""Connected components of a graph given as rows of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs): root is the smallest node it can reach.

    Each round points a node's larger neighbours, then its smaller ones, to the
    smallest neighbour.  A round is aggregations and joins on the node; rounds
    are checkpointed and grow with the logarithm of the graph's size, not with
    its longest path.  The smallest neighbours are checkpointed too: a join of
    two stored tables can be split where a node has very many neighbours.
    """
    links = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: larger neighbours of u, and u's smallest neighbour or itself
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of u (large links always point down) and u itself
        large = cut(large)
        small_least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        links = cut(small.distinct())
        after = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
