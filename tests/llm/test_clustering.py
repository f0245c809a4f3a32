"""Clusters against SQL and against plain integers."""

import hashlib
import math
import random

import pytest
from oracle import differences

import __spark_entry__
from tessera.llm import clustering

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label string, n string, ids string"


def plain(rows, clusters, rounds, width):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), k) for k, x in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        c = [[sum(col) // len(col) for col in zip(*own)] if (own := [v for (_, v), a in zip(kept, at) if a == k]) else old for k, old in enumerate(c)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, k in found if k == j) for j in range(len(c))]
    total = sum(inertia)
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, k, fits(d), fits(inertia[k]), fits(total), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in found), key=repr)


def test_registered_query_is_the_sql(spark):
    df = __spark_entry__.queries()["op13_clustering"](spark, FOLDER)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    more, less, n = differences(df, __spark_entry__.oracle_sql()["op13_clustering"], FOLDER)
    assert not more and not less and n == 500


def made(kind):
    r = random.Random(kind)
    rows = []
    for i in range(120):
        v = [r.choice((-1.0, 0.0, 0.5, 1.0)) + (r.random() if kind != "ties" else 0) for _ in range(4)]
        if kind == "large":
            v = [x * r.choice((1.0, 2.0**20, 2.0**40, 1e300 if i % 40 == 0 else 1.0)) for x in v]
        rows.append((r.choice((i, i, i % 7, None)), v))
    return rows + [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0] * 5), (504, [1.0, None, 1.0, 1.0]), (505, [math.nan] * 4), (506, [1.0, 1.0, 1.0, math.inf])]


@pytest.mark.parametrize("kind", ["small", "ties", "large"])
def test_magnitudes_ties_and_odd_vectors(spark, kind):
    rows = made(kind)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, clustering.cluster(df, clusters=5, rounds=4, width=4).collect()), key=repr) == plain(rows, 5, 4, 4)


def test_few_equal_and_no_vectors(spark):
    for rows in ([], [(1, [1.0] * 4)], [(1, [1.0] * 4)] * 9, [(None, [2.0] * 4), (3, [0.0] * 4)]):
        df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
        assert sorted(map(tuple, clustering.cluster(df, clusters=3, rounds=2, width=4).collect()), key=repr) == plain(rows, 3, 2, 4)
