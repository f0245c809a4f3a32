"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, written

#: Rows that a block of the index has, and queries that one block of queries has, on average.
BLOCK_ROWS, QUERY_ROWS = 16_384, 64
SCALE = 256
#: Bytes that hold any score of finite doubles.
WIDEST = 280


#: Whole numbers up to here are told apart in float64, and fit numpy's integers with room for sums of two.
PLAIN = 2.0**53


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id and q, the floors of the components times `scale`, as whole doubles; only whole, finite vectors."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(x.isNotNull() & F.col("vec_id").isNotNull())
    # beyond PLAIN every double is whole
    floor = F.transform(x, lambda v: F.when(F.abs(v * scale) < PLAIN, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return rows.where(whole).select(F.monotonically_increasing_id().alias("row"), "vec_id", floor.alias("q"))


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: of numpy where they are small enough, else of Python."""
    if not values.size or np.abs(values).max() < PLAIN:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel().tolist()], object).reshape(values.shape)


class Slices:
    """The bit slices of one block: for each attribute its least value, and a
    bitmap over the rows for each bit of what is above it. Rows lie in the
    order of their ids, equal ids in that of their row numbers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, low: np.ndarray, planes: np.ndarray, maps: np.ndarray):
        self.rows, self.ids, self.low, self.planes = rows, ids, low, planes
        self.maps = maps.reshape(int(planes.sum()), -(-len(ids) // 64))
        self.both = np.concatenate([self.maps, ~self.maps])
        self.begins = np.cumsum(planes) - planes
        self.valid = bitmap(np.ones(len(ids), bool))

    @staticmethod
    def build(rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> Slices:
        order = np.lexsort((rows, ids))
        rows, ids, values = rows[order], ids[order], whole_numbers(values[order])
        low = values.min(0)
        above = values - low
        planes = np.array([int(m).bit_length() for m in above.max(0)], np.int64)
        maps = [bitmap((above[:, d] >> p) & 1) for d, n in enumerate(planes) for p in range(n)]
        return Slices(rows, ids, low.astype(np.float64), planes, np.stack(maps) if maps else np.empty((0, -(-len(ids) // 64)), np.uint64))

    def add(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of all rows' scores, least significant first, and what to add to them.

        A query's component is a sum of signed powers of two. Adding an
        attribute times a power adds its slices, moved up; taking it away adds
        the complements of its slices, less a constant.
        """
        constant = int(sum(int(a) * int(b) for a, b in zip(query, self.low, strict=True)))
        dims, shifts, signs = digits(query)
        n = self.planes[dims]
        for d, k, s in zip(dims.tolist(), shifts.tolist(), signs.tolist(), strict=True):
            if s < 0:
                constant -= ((1 << int(self.planes[d])) - 1) << k
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows = np.repeat(self.begins[dims] + np.where(signs < 0, len(self.maps), 0), n) + step
        weights = np.repeat(shifts, n) + step
        order = np.argsort(weights, kind="stable")
        rows, ends = rows[order], np.cumsum(np.bincount(weights, minlength=1)) if len(weights) else np.zeros(1, np.int64)
        out, carried, w, begin = [], None, 0, 0
        while w < len(ends) or carried is not None:
            end = int(ends[w]) if w < len(ends) else begin
            addends = self.both[rows[begin:end]]
            if carried is not None:
                addends = np.concatenate([addends, carried])
            begin, w = end, w + 1
            slice_, carried = added(addends)
            out.append(slice_)
        return out, constant

    def top(self, query_row: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but the query's own, in no order.

        From the most significant slice downward, rows with the bit go ahead of
        rows without it. The rows that are left at the end have one score; of
        them the smallest ids are taken.
        """
        slices, constant = self.add(query)
        equal, ahead, n = self.valid.copy(), np.zeros_like(self.valid), 0
        for own in np.flatnonzero(self.rows == query_row).tolist():
            equal[own // 64] &= ~np.uint64(1 << own % 64)
        for s in reversed(slices):
            with_bit = equal & s
            m = int(np.bitwise_count(with_bit).sum())
            if n + m > k:
                equal = with_bit
            else:
                ahead, n, equal = ahead | with_bit, n + m, equal & ~s
                if n == k:
                    break
        at = np.concatenate([places(ahead), places(equal)[: k - n]])
        scores = [constant] * len(at)
        for w, s in enumerate(slices):
            bits = (s[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            scores = [x + (int(b) << w) for x, b in zip(scores, bits, strict=True)]
        return list(zip(self.ids[at].tolist(), scores, strict=True))


def bitmap(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits.astype(bool), bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def places(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def digits(query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attribute, power and sign of the signed binary digits of all components;
    no two neighbouring digits of a component are set."""
    found: list[tuple[int, int, int]] = []
    for d, x in enumerate(map(int, query.tolist())):
        k = 0
        while x:
            if x & 1:
                sign = 2 - (x & 3)
                found.append((d, k, sign))
                x -= sign
            x >>= 1
            k += 1
    a = np.array(found, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def added(maps: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The sum bit of bitmaps of one weight, and their carries; full adders take three at a time."""
    carries = []
    while len(maps) > 1:
        n = max(len(maps) // 3, 1)
        a, b = maps[:n], maps[n : 2 * n]
        if len(maps) == 2:
            carries.append(a & b)
            maps = a ^ b
            break
        c, x = maps[2 * n : 3 * n], a ^ b
        carries.append((a & b) | (x & c))
        maps = np.concatenate([x ^ c, maps[3 * n :]])
    return (maps[0] if len(maps) else np.zeros(maps.shape[1], np.uint64)), np.concatenate(carries) if carries else None


def index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block of the index: dim, block, ids, low, planes, maps.

    `rows` (see `quantised`, materialised) is dealt into blocks of about
    `block_rows` by a hash of the id, each of which one task slices. Vectors of
    different dimension are in different blocks.
    """
    blocks = -(-rows.count() // block_rows) or 1

    def build(t: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        values = np.array(t["q"].to_pylist(), np.float64).reshape(len(ids), -1)
        s = Slices.build(t["row"].to_numpy(), ids, values)
        return pa.table(
            {"dim": t["dim"][:1], "block": t["block"][:1], "blocks": pa.array([blocks], pa.int64())}
            | {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in (("rows", s.rows), ("ids", s.ids), ("low", s.low), ("planes", s.planes), ("maps", s.maps))}
        )

    dealt = rows.select("row", "vec_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("dim", "block").applyInArrow(build, "dim int, block long, blocks long, rows binary, ids binary, low binary, planes binary, maps binary")


def search(queries: DataFrame, blocks: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of greatest integer inner product for each query: query_id, rank, vec_id, score.

    Queries are gathered into small blocks, and each meets every block of the
    index of its dimension. A pair of blocks yields k rows for a query, and the
    best k of those are ranked. Ties go to the smaller vec_id.
    """
    parts = -(-queries.count() // QUERY_ROWS) or 1
    asked = queries.select(F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id", "row", F.lit(1)), F.lit(parts)).alias("part"), F.struct("row", "vec_id", "q").alias("query"))
    asked = asked.groupBy("dim", "part").agg(F.collect_list("query").alias("queries"))
    keys = blocks.select("dim", "block")
    pairs = asked.join(keys, "dim").join(blocks, ["dim", "block"]).select("rows", "ids", "low", "planes", "maps", "queries")
    kinds = {"rows": np.int64, "ids": np.int64, "low": np.float64, "planes": np.int64, "maps": np.uint64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                s = Slices(**{n: np.frombuffer(b.column(n)[row].as_py(), t) for n, t in kinds.items()})
                found = [(q["row"], q["vec_id"], *x) for q in b.column("queries")[row].as_py() for x in s.top(q["row"], whole_numbers(np.array(q["q"], np.float64)), k)]
                fits = [-(1 << 63) <= x[3] < 1 << 63 for x in found]
                columns = [
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.int64()),
                    pa.array([0 if f else 1 if x[3] > 0 else -1 for x, f in zip(found, fits, strict=True)], pa.int32()),
                    pa.array([x[3] if f else None for x, f in zip(found, fits, strict=True)], pa.int64()),
                    # bytes that sort as the numbers do
                    pa.array([None if f else (x[3] + (1 << 8 * WIDEST - 1)).to_bytes(WIDEST, "big") for x, f in zip(found, fits, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "beyond", "score", "wide"])

    best = pairs.mapInArrow(run, "query_row long, query_id long, vec_id long, beyond int, score long, wide binary")
    order = Window.partitionBy("query_row").orderBy(F.desc("beyond"), F.desc("score"), F.desc("wide"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """`search` with every row whose vec_id `every` divides as a query, against all other rows.

    Defined results: vectors that are null, or hold a null or a component that
    is not finite, and rows without a vec_id take no part; rows of one vec_id
    are queries and candidates of their own; vectors of different dimension are
    not compared; ranks are exact at any magnitude, and a score that does not
    fit a long is null; an empty table gives no rows; columns besides vec_id
    and embedding are not read.
    """
    rows = cut(quantised(vectors))
    return search(rows.where(F.col("vec_id") % every == 0), written(index(rows), "bitsliced"), k)
