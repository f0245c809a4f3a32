"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget, packed


def large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links every greater neighbour of a node to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return packed(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")), rows).distinct()


def small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    down = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return packed(down.union(least.select(F.col("m").alias("a"), "b")), rows).distinct()


def unsettled(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes that are neither a root nor linked to one root alone."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("low")).union(edges.select(F.col("b").alias("node"), F.lit(1).alias("low")))
    roles = ends.groupBy("node").agg(F.sum("low").alias("low"), F.min("low").alias("least"))
    got = roles.agg(F.sum("low").alias("rows"), F.count_if(F.expr("low > 1 or low = 1 and least = 0")).alias("bad")).first()
    return got["rows"] or 0, got["bad"]


def components(edges: DataFrame) -> DataFrame:
    """For each node of `edges` (a, b with a < b) the least node it is connected to: node, root.

    Alternates large and small stars until all are stars, which takes a number
    of rounds logarithmic in the size of a component. A round groups and joins
    by node; hubs are summed before the shuffle, and hot keys of the joins are
    split by adaptive execution. Rounds are cut by reliable checkpoints, in no
    more files than their edges fill. A round is two queries, one that counts
    and one that makes both stars: each query leaves plans, broadcasts and code
    in the driver, whatever its size.
    """
    edges = cut(edges)
    while True:
        rows, bad = unsettled(edges)
        if not bad:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).distinct()
        edges = cut(packed(small_star(packed(large_star(packed(edges, rows), rows), rows), rows), rows))
        forget(edges.sparkSession)
