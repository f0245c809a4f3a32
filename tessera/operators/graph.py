"""References and the graph that they make. Edges have src and dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import node_id
from tessera.operators.rounds import spread


def outgoing(edges: DataFrame, builtin: list[str]) -> DataFrame:
    """Distinct edges, but for those to the node itself and to built-in names."""
    return edges.where((F.col("src") != F.col("dst")) & ~F.col("dst").isin(builtin)).distinct()


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """Edges within `depth` steps of each root: root, src, dst, depth (the least).

    The depth is held to 0 to 4 and unrolled into as many joins; nodes reached
    before are left out of the frontier, so that cycles end. A frontier has no
    row twice and neither have the edges, so that what they meet in needs no
    grouping; partitions hold a bounded number of roots.
    """
    depth = max(0, min(depth, 4))
    rows, edges = roots.count(), edges.distinct()
    frontier = seen = roots.select("root", F.col("root").alias("node")).distinct()
    found = None
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", "src", "dst", F.lit(d).cast("long").alias("depth"))
        found = step if found is None else found.union(step)
        # one grouping finds what is new, instead of one and a join with all that was seen
        ahead = step.select("root", F.col("dst").alias("node"), F.lit(True).alias("new")).union(seen.withColumn("new", F.lit(False)))
        frontier = spread(ahead, (d + 1) * rows, "root", "node").groupBy("root", "node").agg(F.bool_and("new").alias("new")).where("new").drop("new")
        seen = seen.union(frontier)
    if found is None:
        return roots.join(edges, F.lit(False)).select("root", "src", "dst", F.lit(0).cast("long").alias("depth"))
    return found


def rendered(edges: DataFrame, form: str = "mermaid", rows: int | None = None) -> DataFrame:
    """The text of each root's graph: root, n_edges, graph. `rows`, if given, is about how many edges there are and sizes partitions."""
    if form == "mermaid":
        line, head, tail = F.concat(F.lit("  "), node_id(F.col("src")), F.lit(" --> "), node_id(F.col("dst"))), "graph TD\n", ""
    else:
        line, head, tail = F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";')), "digraph {\n", "\n}"
    lines = edges.select("root", line.alias("line"))
    once = (lines if rows is None else spread(lines, rows, "root")).distinct()
    text = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return once.groupBy("root").agg(F.count("*").alias("n_edges"), F.concat(F.lit(head), text, F.lit(tail)).alias("graph"))
