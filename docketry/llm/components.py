"""Connected components of an edge table by alternating stars, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import common


def _large_star(edges: DataFrame, tables: common.Scratch) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = tables.write(both.groupBy("u").agg(F.min("v").alias("m")), "least")  # a table, so that a hot u of `both` can be split
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, tables: common.Scratch) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = tables.write(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component, for each node with an edge.

    u and v may be of any type with an order. Each round is written as a table, so
    lineage does not grow; the number of rounds grows with the logarithm of the
    components' diameters.
    """
    tables = common.Scratch(edges.sparkSession)
    now = tables.write(edges.where("u <> v").select("u", "v").distinct(), "edges")
    while now.take(1):
        spread = tables.write(_large_star(now, tables), "edges")
        now = tables.write(_small_star(spread, tables), "edges")
        ends = now.select(F.col("u").alias("k"), F.lit(1).alias("tied"), F.lit(0).alias("root")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("k").agg(F.sum("tied").alias("tied"), F.max("root").alias("root"))
        if not ends.where("tied > 1 or tied + root > 1").take(1):  # every node is tied to one root, and no root to another
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select("v", "v").distinct())
