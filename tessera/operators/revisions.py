"""Fact tables by revision, and what makes a refresh due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(rows: DataFrame, key: str, revision: int) -> DataFrame:
    """The state of each key at a revision: its last row up to then, unless that one deletes it.

    rows: key, revision, deleted and others.
    """
    rest = [c for c in rows.columns if c != key]
    last = rows.where(F.col("revision") <= revision).groupBy(key).agg(F.max_by(F.struct(*rest), "revision").alias("r"))
    return last.select(key, "r.*").where("not deleted")


def refreshes(events: DataFrame, group: str) -> DataFrame:
    """How many changes each refresh takes in: changes are gathered until the next read.

    events: group, ord, is_read. Returns group, refresh (from 0), n_changes;
    reads that find nothing new refresh nothing.
    """
    before = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    numbered = events.withColumn("epoch", F.coalesce(F.sum(F.col("is_read").cast("long")).over(before), F.lit(0)))
    found = numbered.groupBy(group, "epoch").agg(F.count_if(~F.col("is_read")).alias("n_changes"), F.max("is_read").alias("closed")).where("n_changes > 0 and closed")
    order = Window.partitionBy(group).orderBy("epoch")
    return found.select(group, (F.row_number().over(order) - 1).cast("long").alias("refresh"), "n_changes")
