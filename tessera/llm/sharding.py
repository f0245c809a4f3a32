"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, bucket_count, cut, leading, prefix_sums, unit_hash


#: Equal rows that one row unfolds to.
COPIES = 4096


def copies_apart(rows: DataFrame, seed: int) -> DataFrame:
    """`rows` with dice, a hash that also tells equal rows apart.

    Equal rows are counted before the shuffle and unfolded behind it, in runs
    that different tasks take.
    """
    columns = [F.col(c) for c in rows.columns]
    runs = rows.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES}L)")))
    runs = runs.repartition(*columns, "run")
    rest = F.expr(f"sequence(run * {COPIES}L, least(n, (run + 1) * {COPIES}L) - 1)")
    each = runs.withColumn("copy", F.explode(rest))
    return each.withColumn("dice", unit_hash(F.lit(str(seed)), "doc_id", "print", "copy")).drop("n", "run", "print", "copy")


def interleave(docs: DataFrame, n_shards: int, seed: int = 7) -> DataFrame:
    """Deals documents into shards whose mixture of sources matches the whole.

    Rows are shuffled by a seeded hash within their source and get the
    fractional rank (rank + 1/2) / rows of the source. Sorted by that rank, the
    sequence holds every source in even steps, and is cut into `n_shards` runs
    whose counts differ by one at most (law `rows`).

    A row's hash is of its doc_id, its text, and its number among equal rows,
    so that neither a repeated doc_id nor repeated rows fill one bucket.
    Both ranks are distributed prefix sums over buckets of the sort key: no
    task sees a whole source, and texts are not shuffled.

    Defined results: a null source is a source of its own; a null text has size
    16 and the checksum of no bytes; repeated rows keep places of their own; an
    empty table gives no rows; other columns of `docs` are not read.

    Returns doc_id, source, size, text_crc32, shard, slot.
    """
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")).alias("src"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("print"),
    )
    rows = cut(copies_apart(rows, seed))
    counts = cut(rows.groupBy("src").agg(F.count("*").alias("n_source")))
    total = counts.agg(F.coalesce(F.sum("n_source"), F.lit(0))).first()[0]
    rows = attach(rows, counts, "src")
    rows = rows.withColumn("b", F.floor(leading(F.col("dice")) * bucket_count(F.col("n_source")) / F.lit(2.0**32)))
    order = [F.col(c) for c in ("dice", "doc_id", "text_crc32", "size")]
    rows = prefix_sums(rows, ["src"], "b", order, F.lit(1), "rank")
    share = (F.col("rank") + 0.5) / F.col("n_source")
    rows = rows.drop("b").withColumn("share", share)
    rows = rows.withColumn("b", F.floor(F.col("share") * bucket_count(F.lit(total))))
    rows = rows.withColumn("one", F.lit(0))
    place = prefix_sums(rows, ["one"], "b", [F.col("share"), F.col("src"), F.col("rank")], F.lit(1), "place")
    shard = F.floor(F.col("place") * n_shards / F.lit(max(total, 1)))
    # the division is of whole numbers below 2^53; the cut is checked against them
    shard = F.when(shard * total > F.col("place") * n_shards, shard - 1).when((shard + 1) * total <= F.col("place") * n_shards, shard + 1).otherwise(shard)
    place = place.withColumn("shard", shard.cast("int"))
    begins = F.ceil(F.col("shard").cast("long") * total / F.lit(float(n_shards))).cast("long")
    return place.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("place") - begins).cast("long").alias("slot"))
