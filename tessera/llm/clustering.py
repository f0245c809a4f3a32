"""Exact integer k-means by matrix products, with sums by treeAggregate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Components of a vector, clusters, rounds, and what components are multiplied by.
WIDTH, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Vectors of one block of the matrix products.
BLOCK_ROWS = 4096
#: Integers up to here, and sums of their products, are exact in float64.
EXACT = 2.0**53
LONGEST = (1 << 63) - 1


def blocks_of(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """rows, ids and components: blocks of vectors with their integer components.

    Components are whole numbers in float64 (exact at any size, because floats
    times a power of two are), or int16 where a block's fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, len(b), BLOCK_ROWS):
                part = b.slice(begin, BLOCK_ROWS)
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), width) * float(scale))
                small = np.abs(x).max() < 1 << 15
                ids = part.column(0)
                raw = [x.astype(np.int16 if small else np.float64).tobytes(), ids.fill_null(0).to_numpy().tobytes(), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([bool(small)]), *(pa.array([r], pa.binary()) for r in raw)], ["n", "small", "components", "ids", "no_id"])

    return kept_vectors(vectors, width).mapInArrow(run, "n int, small boolean, components binary, ids binary, no_id binary")


def kept_vectors(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """vec_id and embedding (doubles) of vectors with `width` components, none null or not finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(x.isNotNull() & (F.size(x) == width)).where(finite)


def matrix(components: bytes, small: bool, n: int) -> np.ndarray:
    return np.frombuffer(components, np.int16 if small else np.float64).reshape(n, -1).astype(np.float64)


class Centroids:
    """Integer centroids of any size, and the exact nearest of each vector."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.largest = max((abs(v) for r in rows for v in r), default=0)
        self.floats = np.array([[float(v) for v in r] for r in rows], np.float64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Number and squared distance of the nearest centroid for each row; ties: the smaller number.

        |x|² - 2x·c + |c|² is exact in float64 as long as no partial sum
        reaches 2^53, which width · (max|x| + max|c|)² bounds. Rows beyond the
        bound are measured in Python's integers.
        """
        bound = x.shape[1] * (np.abs(x).max(axis=1, initial=0) + float(self.largest)) ** 2
        safe = bound < EXACT
        if safe.all():
            return self.by_product(x)
        numbers, distances = np.zeros(len(x), np.int64), [0] * len(x)
        if safe.any():
            a, d = self.by_product(x[safe])
            numbers[safe] = a
            for i, v in zip(np.flatnonzero(safe).tolist(), d.tolist(), strict=True):
                distances[i] = v
        for i in np.flatnonzero(~safe).tolist():
            row = [int(v) for v in x[i].tolist()]
            distances[i], numbers[i] = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), k) for k, c in enumerate(self.rows))
        return numbers, distances

    def by_product(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.floats
        d = np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)
        numbers = d.argmin(axis=1)  # the first of equals
        return numbers, d[np.arange(len(x)), numbers].astype(np.int64)

    def hashes(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]


class Sums:
    """Counts, component sums and distances of the clusters, as Python's integers."""

    def __init__(self, clusters: int, width: int):
        self.counts, self.distances = [0] * clusters, [0] * clusters
        self.totals = [[0] * width for _ in range(clusters)]

    def add(self, x: np.ndarray, centroids: Centroids) -> Sums:
        numbers, distances = centroids.nearest(x)
        distances = distances.tolist() if isinstance(distances, np.ndarray) else distances
        exact = float(np.abs(x).max(initial=0)) * len(x) < EXACT
        for k in np.unique(numbers).tolist():
            at = numbers == k
            rows = x[at]
            sums = rows.sum(axis=0).tolist() if exact else [sum(int(v) for v in col) for col in rows.T.tolist()]
            self.counts[k] += len(rows)
            self.distances[k] += sum(d for d, own in zip(distances, at.tolist(), strict=True) if own)
            self.totals[k] = [a + int(b) for a, b in zip(self.totals[k], sums, strict=True)]
        return self

    def merge(self, other: Sums) -> Sums:
        self.counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        self.distances = [a + b for a, b in zip(self.distances, other.distances, strict=True)]
        self.totals = [[a + b for a, b in zip(r, s, strict=True)] for r, s in zip(self.totals, other.totals, strict=True)]
        return self

    def centroids(self, before: Centroids) -> Centroids:
        """Floors of the means; an empty cluster keeps its centroid."""
        return Centroids([[t // n for t in row] if n else old for n, row, old in zip(self.counts, self.totals, before.rows, strict=True)])


def started(vectors: DataFrame, clusters: int, scale: int, width: int, seed: int) -> Centroids:
    """The vectors with the smallest SHA-256 of `seed:vec_id`, in that order; of
    equal ids the smaller vector comes first, rows without an id come last."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept_vectors(vectors, width).withColumn("hash", hashed).orderBy(F.asc_nulls_last("hash"), "embedding").limit(clusters).collect()
    return Centroids([[int(v) for v in np.floor(np.array(r.embedding) * float(scale)).tolist()] for r in first])


def pass_over(blocks: DataFrame, centroids: Centroids) -> Sums:
    """One pass over all vectors: each block is assigned and summed where it is, and sums are combined in a tree."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast(centroids)
    clusters, width = len(centroids.rows), len(centroids.rows[0])
    rows = blocks.select("components", "small", "n").rdd
    total = rows.treeAggregate(Sums(clusters, width), lambda s, r: s.add(matrix(bytes(r[0]), r[1], r[2]), shared.value), lambda a, b: a.merge(b))
    shared.unpersist()
    return total


def assigned(blocks: DataFrame, centroids: Centroids, sums: Sums) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    hashes = centroids.hashes()
    fits = [d if d <= LONGEST else None for d in sums.distances]
    total = sum(sums.distances)
    total = total if total <= LONGEST else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                n, small, components, ids, no_id = (c[row].as_py() for c in b.columns)
                numbers, distances = centroids.nearest(matrix(components, small, n))
                own = numbers.tolist()
                missing = np.unpackbits(np.frombuffer(no_id, np.uint8), count=n).astype(bool)
                values = [d if d <= LONGEST else None for d in distances] if isinstance(distances, list) else distances
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(ids, np.int64), mask=missing),
                        pa.array(own, pa.int32()),
                        pa.array(values, pa.int64()),
                        pa.array([fits[k] for k in own], pa.int64()),
                        pa.array([total] * n, pa.int64()),
                        pa.array([hashes[k] for k in own]),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = 3) -> DataFrame:
    """Lloyd's rounds over all vectors of `width` components, in whole numbers: floors of the components times `scale`.

    Every round is one pass over a written table of blocks; what the driver
    holds are the sums of the clusters (clusters x width numbers).

    Defined results: vectors of another width, null, or with a null component
    or one that isn't finite take no part; rows of one vec_id are vectors of
    their own; rows without a vec_id take part and start no cluster unless
    others are too few; with fewer vectors than clusters there are as many
    clusters as vectors; results are exact at any magnitude, and a distance or
    inertia that does not fit a long is null; an empty table gives no rows;
    columns besides vec_id and embedding are not read.
    """
    centroids = started(vectors, clusters, scale, width, seed)
    blocks = written(blocks_of(vectors, width, scale), "vector-blocks")
    if not centroids.rows:
        return assigned(blocks, centroids, Sums(0, width))
    for _ in range(rounds):
        centroids = pass_over(blocks, centroids).centroids(centroids)
    return assigned(blocks, centroids, pass_over(blocks, centroids))


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = 3) -> str:
    """The same for DuckDB, each round a table expression of its own; exact while sums of squares stay below 2^53."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS INTEGER) AS k, q AS c
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {clusters}))""",
    ]
    distance = "list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c)"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT any_value(vec_id) AS vec_id, any_value(q) AS q, min(({distance}, k)) AS m FROM (SELECT row_number() OVER () AS r, * FROM v) CROSS JOIN c{r} GROUP BY r)")
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(f ORDER BY place) AS n FROM
  (SELECT k, place, floor(sum(x) / count(*)) AS f FROM (SELECT m[2] AS k, unnest(q) AS x, generate_subscripts(q, 1) AS place FROM a{r}) GROUP BY k, place) GROUP BY k) USING (k))"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, CAST(m[1] AS BIGINT) AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON m[2] = k"""
    )
