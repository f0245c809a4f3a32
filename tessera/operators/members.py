"""Members of types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.rounds import held


def shown_members(members: DataFrame, most: int = 50) -> DataFrame:
    """Members of types that have `most` or fewer; a type with more shows none of them."""
    return members.withColumn("n", F.count("*").over(Window.partitionBy("type_id"))).where(F.col("n") <= most)


def first_members(members: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """The first `most` members of each type."""
    place = F.row_number().over(Window.partitionBy("type_id").orderBy(*order))
    return members.withColumn("place", place).where(F.col("place") <= most)


def type_info(types: DataFrame, members: DataFrame, most: int = 50) -> DataFrame:
    """Each type with its members, if it shows them, in a text of `name: type` sorted by it."""
    text = F.concat(F.col("member"), F.lit(": "), F.col("member_type"))
    lists = members.groupBy("type_id").agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("text"))
    n = F.coalesce("n_members", F.lit(0))
    return types.join(lists, "type_id", "left").select(*types.columns, n.alias("n_members"), F.when(n.between(1, most), F.col("text")).otherwise("").alias("members"))


def ancestors(bases: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """All bases of each type, or of those in `only` (type_id): type_id, base_id, depth (the least); cycles end.

    Rounds follow the depth of the hierarchy; each joins what the round before
    has found.
    """
    first = bases.select("type_id", "base_id").where("type_id <> base_id").distinct()
    asked = first if only is None else first.join(only.select("type_id").distinct(), "type_id", "left_semi")
    frontier = held(asked.withColumn("depth", F.lit(1).cast("long")))
    seen = frontier
    step = first.select(F.col("type_id").alias("base_id"), F.col("base_id").alias("next"))
    while not frontier.isEmpty():
        found = frontier.join(step, "base_id").where("type_id <> next").select("type_id", F.col("next").alias("base_id"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = held(found.join(seen, ["type_id", "base_id"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def inherited(members: DataFrame, bases: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """`members` (type_id, member, ...) with those of all bases, and depth: the
    nearest declaration of a name wins, then that of the least base. With `only`
    (type_id), those types' alone."""
    rest = [c for c in members.columns if c not in ("type_id", "member")]
    own = members.withColumn("depth", F.lit(0).cast("long")).withColumn("base_id", F.col("type_id"))
    if only is not None:
        own = own.join(only.select("type_id").distinct(), "type_id", "left_semi")
    more = ancestors(bases, only).join(members.withColumnRenamed("type_id", "base_id"), "base_id").select(*own.columns)
    near = F.min_by(F.struct(*rest, "depth"), F.struct("depth", "base_id"))
    return own.unionByName(more).groupBy("type_id", "member").agg(near.alias("r")).select("type_id", "member", "r.*")
