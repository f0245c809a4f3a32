"""Helpers shared by the operators on training data."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as Java and RE2 write it; words are the runs between.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side of a join may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 20_000


#: Bytes of text in a block of documents.
BLOCK_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BLOCK_BYTES bytes of a text column, and of a row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(b):
            before = ends[begin - 1] if begin else 0
            stop = max(int(np.searchsorted(ends, before + BLOCK_BYTES)), begin + 1)
            yield b.slice(begin, stop - begin)
            begin = stop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's `spark.checkpoint.dir`. Only where that is unset (tests
    in local mode) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint; for narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more.

    Its cleaner acts once the driver collects garbage, which it does half-hourly
    by itself: too late for iterations that cut their lineage and go on.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a partition of a narrow table, about, where there are few.
PART_ROWS = 50_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """`df`, a narrow table of about so many rows, in no more partitions than they fill."""
    return df.coalesce(rows // PART_ROWS + 1)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` written as a Parquet table in the shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """`df` inner-joined to a table with one row for each value of `on`.

    `small` must be materialised (see `cut`). It is broadcast only if it has at
    most BROADCAST_ROWS rows. A larger one is joined by a shuffle, where
    adaptive execution splits the hot keys of `df`.
    """
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, on)


def unit_hash(*parts: Column | str) -> Column:
    """32 hexadecimal digits that look random; nulls count as a text of their own."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("?")) if isinstance(p, str) else p for p in parts]))


def leading(hexed: Column) -> Column:
    """The first 32 bits of hexadecimal digits, as a long that keeps their order."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def bucket_count(rows: Column) -> Column:
    """Buckets for a distributed rank over so many rows: about 256 rows each, or
    the root of the count where that is more, so that both the rows of a bucket
    and the buckets themselves stay few at any size."""
    return F.ceil(rows / F.greatest(F.lit(256.0), F.sqrt(rows))).cast("long")


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sums of `value` within `group`, without a task that
    holds a whole group.

    `bucket` must not fall as `order` rises. Totals of the buckets are summed
    first, then each bucket is ranked on its own and begins at its offset.
    """
    total, before = f"__{out}_total", f"__{out}_before"
    buckets = df.groupBy(*group, bucket).agg(F.sum(value).alias(total))
    offsets = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    buckets = cut(buckets.withColumn(before, F.coalesce(F.sum(total).over(offsets), F.lit(0))).drop(total))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(buckets, [*group, bucket])
        .withColumn(out, (F.col(out) + F.col(before)).cast("long"))
        .drop(before)
    )
