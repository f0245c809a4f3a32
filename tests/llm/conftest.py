import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from edge_cases import CLASHES, SCHEMA, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="session")
def none(edges):
    return edges.where("false")
