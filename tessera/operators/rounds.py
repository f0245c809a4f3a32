"""Tables that rounds of an iteration hand to each other."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; where that is unset, a temporary folder, which only local mode allows."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessera-rounds-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: Rows of a partition where their number is known, so that what a task holds doesn't grow with the input.
PART_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt out by `keys`, with partitions for so many rows in all; groupings by these keys and more need no other exchange."""
    return df.repartition(rows // PART_ROWS + 1, *keys)


def held(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: its lineage is
    cut, so that plans stay small over the rounds, a lost executor costs no more
    than its tasks, and what was known of constant columns doesn't reach into
    the plans of later rounds. Rows are packed into as few tasks as they need."""
    path = f"{shared_folder(df.sparkSession)}/tessera-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
