"""Summary statistics of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timing_summary(samples: DataFrame, group: str, value: Column) -> DataFrame:
    """Count, extremes, mean, and exact percentiles with linear interpolation, by group."""
    return samples.groupBy(group).agg(
        F.count(value).alias("n"),
        F.round(F.min(value), 3).alias("least"),
        F.round(F.max(value), 3).alias("most"),
        F.round(F.avg(value), 3).alias("mean"),
        F.round(F.percentile(value, 0.5), 3).alias("p50"),
        F.round(F.percentile(value, 0.95), 3).alias("p95"),
    )
