"""Chains of pointers, followed to their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rounds import held


def ends(pointers: DataFrame) -> DataFrame:
    """The end of each node's chain: node, end. `pointers` has node and next, one row for each node.

    Each round joins the pointers with themselves and so doubles how far they
    reach: a chain of n takes log2(n) rounds. A node on a cycle, or one that
    leads into it, has no end and no row; once a round finds no further node at
    its end, all others are such. Nodes are null-free, of one type.
    """
    now = held(pointers.select("node", F.col("next").alias("end")).where("node <> next"))
    nodes = now.count()
    if not nodes:
        return now
    ended = -1
    while True:
        further = now.select(F.col("node").alias("end"), F.col("end").alias("beyond"))
        step = held(now.join(further.hint("merge"), "end", "left").select("node", F.coalesce("beyond", "end").alias("end"), F.col("beyond").isNotNull().alias("moved")))
        before, ended = ended, step.where("not moved").count()
        now = step.select("node", "end")
        if ended in (before, nodes):
            break
    return now.join(now.select(F.col("node").alias("end")).hint("merge"), "end", "left_anti").select("node", "end")
