"""Facts as projections of relational tables.

Parts are symbols, sources of documents are packages, orders are types and
their lines members, foreign keys are references, events are diagnostics, and
distinct pairs of part and supplier are callables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rounds import spread


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def symbols(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), "p_size")

    def files(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("file"), F.col("source").alias("package"), "text")

    def members(self) -> DataFrame:
        """One row for each part of an order: how much of it in all, as the member's type."""
        rows = self.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("quantity"))
        return rows.select(F.col("l_orderkey").alias("type_id"), F.col("l_partkey").alias("member"), "quantity")

    def edges(self) -> DataFrame:
        """References along foreign keys, from the many to the one."""

        def name(prefix: str, key: str):
            return F.concat(F.lit(prefix), F.col(key).cast("string"))

        pairs = (
            (self.nation, name("n", "n_nationkey"), name("r", "n_regionkey")),
            (self.customer, name("c", "c_custkey"), name("n", "c_nationkey")),
            (self.supplier, name("s", "s_suppkey"), name("n", "s_nationkey")),
            (self.orders, name("o", "o_orderkey"), name("c", "o_custkey")),
        )
        parts = [t.select(a.alias("src"), b.alias("dst")) for t, a, b in pairs]
        return parts[0].union(parts[1]).union(parts[2]).union(parts[3])

    def diagnostics(self) -> DataFrame:
        """Events by user as messages: ord, file, line, col, code, message."""
        code = F.when(F.col("event_type") == "error", 2322).when(F.col("event_type") == "view", 2339).when(F.col("event_type") == "click", 2741).otherwise(1005)
        text = (
            F.when(F.col("event_type") == "error", F.concat(F.lit("Type 't"), F.col("user_id").cast("string"), F.lit("' is not assignable to type 'u'")))
            .when(F.col("event_type") == "view", F.concat(F.lit("Property 'p"), F.col("user_id").cast("string"), F.lit("' does not exist on type 'v'")))
            .otherwise("other")
        )
        file = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")))
        return self.events.select(
            F.col("event_id").alias("ord"),
            file.alias("file"),
            (F.col("user_id") % 13).alias("line"),
            F.floor("value").alias("col"),
            code.cast("long").alias("code"),
            text.alias("message"),
        )

    def callables(self) -> DataFrame:
        lines = self.lineitem.count()
        pairs = spread(self.lineitem.select("l_partkey", "l_suppkey"), lines, "l_partkey", "l_suppkey").distinct()
        rows = pairs.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "l_suppkey", "s_nationkey")
        # dealt out before the parts' texts come in: no task sorts more of them than its share
        rows = spread(rows, lines, "l_partkey").join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        nation = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
        wrapped = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Promise<"), nation, F.lit(">"))).otherwise(nation)
        return rows.select(
            F.col("l_partkey").alias("callable"),
            F.col("l_suppkey").alias("ord"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("file"),
            F.array("p_type", "p_brand").alias("params"),
            wrapped.alias("returns"),
            (F.col("p_size") % 2 == 0).alias("exported"),
            (F.col("p_size") % 5 == 0).alias("deprecated"),
            (F.col("p_size") % 7 == 0).alias("is_function"),
        )
