"""Facts that follow their source files: each micro-batch of changed files is a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.revisions import as_of

SCHEMA = "file string, text string, deleted boolean"


def follow(spark: SparkSession, folder: str, facts: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of new JSON files in `folder` to the Parquet table `facts`.

    All that arrived since the last run comes in together: many changes make
    one refresh. The revision is the number of the micro-batch and names the
    partition that it overwrites, so that a batch that is repeated after a
    failure leaves the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("file").agg(F.max_by(F.struct("text", "deleted"), F.struct("changed", "text")).alias("r")).select("file", "r.*")
        rows.write.mode("overwrite").parquet(f"{facts}/revision={number + 1}")

    stream = spark.readStream.schema(SCHEMA).json(folder).withColumn("changed", F.col("_metadata.file_modification_time"))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files_at(spark: SparkSession, facts: str, revision: int) -> DataFrame:
    """The files as they were at a revision; later ones do not show."""
    rows = spark.read.schema(f"{SCHEMA}, revision long").parquet(facts)
    return as_of(rows, "file", revision)


def event_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
