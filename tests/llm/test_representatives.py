"""Representatives of classes of near duplicates."""

import random
from collections import Counter

import pytest
from edge_cases import prose

from tessera.llm import simhash

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("of", [simhash.one_of_each])
def test_null_and_repeated_ids_lose_no_class(spark, of):
    r = random.Random(8)
    a, b, c, d, e = (prose(r, 150) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (3, c), (None, e), (9, e)]
    got = Counter(tuple(x) for x in of(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == Counter([(None, a), (None, b), (3, c), (7, d), (9, e)])
