"""Evidence packets, batches and output policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes from which an answer goes to a file of its own.
INLINE_BYTES = 8000


def evaluated(direct: DataFrame, snippet: DataFrame, diagnostics: DataFrame, transform: DataFrame) -> DataFrame:
    """One verdict from four checks, each a row with its `ok` (null: not run).

    The verdict holds if neither snippet nor diagnostics failed, the types fit
    directly or by a transform, and something spoke for it. A failed check
    blocks, but for that of direct fit.
    """
    # rows of one partition each, or their product would have as many as all together
    direct, snippet, diagnostics, transform = (d.coalesce(1) for d in (direct, snippet, diagnostics, transform))
    row = direct.select(F.col("ok").alias("direct")).crossJoin(snippet.select(F.col("ok").alias("snippet")))
    row = row.crossJoin(diagnostics.select(F.col("ok").alias("diagnostics"))).crossJoin(transform.select(F.col("ok").alias("transform")))

    def yes(c: str) -> Column:
        return F.coalesce(c, F.lit(False))

    def not_no(c: str) -> Column:
        return F.coalesce(c, F.lit(True))

    asked = F.col("direct").isNotNull() | F.col("transform").isNotNull()
    fits = ~asked | yes("direct") | yes("transform")
    some = yes("direct") | yes("snippet") | yes("diagnostics") | yes("transform")
    return row.withColumn("ok", not_no("snippet") & not_no("diagnostics") & not_no("transform") & fits & some)


def batch_results(payloads: DataFrame, results: DataFrame) -> DataFrame:
    """Every payload in its place with its result, or why there is none: idx, ok, data, error."""
    out = payloads.join(results, "key", "left")
    missing = F.col("data").isNull()
    return out.select("batch", "idx", (~missing).alias("ok"), "data", F.when(missing, F.concat(F.lit("not found: "), F.col("key").cast("string"))).alias("error"))


def batch_outcome(items: DataFrame) -> DataFrame:
    n, good = F.count("*"), F.count_if("ok")
    outcome = F.when(good == n, "succeeded").when(good == 0, "failed").otherwise("partial_failure")
    return items.groupBy("batch").agg(n.alias("n"), good.alias("n_ok"), outcome.alias("outcome"))


def output_mode(mode: Column, eligible: Column, text: Column) -> Column:
    """inline or artifact: forced, or for a large answer of a command that may."""
    large = F.octet_length(text) > INLINE_BYTES
    return F.when(mode == "artifact", "artifact").when((mode == "auto") & eligible & large, "artifact").otherwise("inline")
