"""Near duplicates by SimHash, found through the segments' bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut
from tessera.llm.components import components

SEGMENT_BITS = 4
SEGMENTS = 64 // SEGMENT_BITS
#: Fingerprints of a grid cell that are compared pair by pair; cells with more
#: are divided further (see `links`).
CELL_ROWS = 24

#: Shingles whose bits are counted at a time, to bound the memory of a long text.
COUNTED = 1 << 16


def shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles of `width` words, up to COUNTED at a time; none of a blank text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(width, len(words))
    ends = ends[k - 1 :].tolist()
    starts = starts[: len(ends)].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), COUNTED):
        part = zip(starts[at : at + COUNTED], ends[at : at + COUNTED], strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in part], np.uint64)


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, others: list[str] | None = None) -> DataFrame:
    """doc_id, its text's fingerprint as a signed long, and other columns; every task works on its own rows."""
    kept = ["doc_id", *(others or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(x.as_py(), width, seed) for x in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(prints, pa.int64())], [*kept, "print"])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("print", T.LongType())])
    return docs.select(*kept, "text").mapInArrow(run, schema)


def segment_count(x: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(x, i * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).cast("long")


def cell_of(x: Column) -> Column:
    """The bit counts of all segments, four bits for each, in one long."""
    cell = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        cell = cell.bitwiseXOR(F.shiftleft(segment_count(x, i), 4 * i))
    return cell


def nearby_cells(x: Column, cell: Column) -> Column:
    """The cells at a Manhattan distance of 1 or less from that of `x`, each with
    the step to it: 0 for its own, i + 1 or -1 - i where segment i has a bit
    more or less.

    If two fingerprints differ in 2 bits or fewer, so do the bit counts of
    their segments by 2 or less in sum: the two meet in a cell.
    """
    steps = [F.struct(cell.alias("at"), F.lit(0).alias("step"))]
    for i in range(SEGMENTS):
        n = segment_count(x, i)
        for sign, possible in ((1, n < SEGMENT_BITS), (-1, n > 0)):
            at = cell.bitwiseXOR(F.shiftleft(n.bitwiseXOR(n + sign), 4 * i))
            steps.append(F.when(possible, F.struct(at.alias("at"), F.lit(sign * (i + 1)).alias("step"))))
    return F.array_compact(F.array(*steps))


def midpoints(x: Column, step: Column) -> Column:
    """The fingerprints in the cell behind `step` that differ from `x` in one bit at most."""
    first = (F.abs(step) - 1) * SEGMENT_BITS
    bits = F.transform(F.sequence(first, first + SEGMENT_BITS - 1), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
    want = F.when(step > 0, F.lit(0)).otherwise(F.lit(1))
    fitting = F.filter(bits, lambda b: (x.bitwiseAND(b) != 0).cast("int") == want)
    return F.when(step == 0, F.array(x)).otherwise(F.transform(fitting, lambda b: x.bitwiseXOR(b)))


def links(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links that join all fingerprints at 2 or fewer differing bits: a, b.

    `prints` has distinct longs in column `print`. Each is mapped to the bit
    counts of its segments and entered into the cells of the grid at a
    Manhattan distance of 1 or less; candidates are those that share a cell.

    A cell with up to `cell_rows` entries is joined with itself, and pairs are
    verified by their differing bits. A cell with more is divided by midpoints:
    an entry goes to each fingerprint of the cell that differs from it in at
    most one bit. Two entries that differ in 2 bits or fewer, and whose midpoint
    is in the cell, share one; all that share one differ in 2 bits or fewer.
    They are linked to the least of them, so that links grow with the entries
    and not with the pairs. No link between classes is lost either way.
    """
    cells = prints.select("print", cell_of(F.col("print")).alias("cell"))
    cells = cells.select("print", F.explode(nearby_cells(F.col("print"), F.col("cell"))).alias("c")).select("print", "c.at", "c.step")
    # the planner takes the unfolded cells for few: hints keep it from broadcasting them
    busy = cells.groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    entries = cut(cells.join(busy.hint("merge"), "at"))

    few = entries.where(F.col("n") <= cell_rows).select("at", "print")
    other = few.select("at", F.col("print").alias("b"))
    pairs = few.withColumnRenamed("print", "a").join(other.hint("merge"), "at").where("a < b and bit_count(a ^ b) <= 2").select("a", "b")

    divided = entries.where(F.col("n") > cell_rows).select("print", F.explode(midpoints(F.col("print"), F.col("step"))).alias("mid"))
    least = divided.groupBy("mid").agg(F.min("print").alias("a"))
    stars = divided.join(least.hint("merge"), "mid").select("a", F.col("print").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, and key: a hash of the text, one of its own for null."""
    return docs.select("doc_id", text_key().alias("key"), "text")


def text_key() -> Column:
    return F.coalesce(F.md5("text"), F.lit("?"))


def classes(rows: DataFrame) -> DataFrame:
    """`rows`, which have a fingerprint in column `print`, with the root of their class."""
    prints = cut(rows.select("print").distinct())
    roots = components(links(prints)).withColumnRenamed("node", "print")
    named = prints.join(roots, "print", "left").select("print", F.coalesce("root", "print").alias("root"))
    return rows.join(named, "print")


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each class the row of `docs` with the least doc_id, null last, then the
    least hash of its text; of equal ids and texts, the least by its columns.

    `rows` has doc_id, key (see `row_keys`) and root, the class. Rows with one
    id and text are reduced to one in the tasks that read them, before the
    shuffle; a null or repeated doc_id brings no rows together besides those.
    """
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("__null"), F.col("doc_id").alias("__id"), F.col("key").alias("__key"))).alias("one"))
    keys = ["__null", "__id", "__key"]
    none = F.lit(-1)
    least = least.select(F.col("one.__null"), F.coalesce("one.__id", none).alias("__id"), F.col("one.__key"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", none).alias("__id"), text_key().alias("__key"), row.alias("__row"))
    single = marked.groupBy(*keys).agg(F.min("__row").alias("__row"))
    return single.join(least.hint("merge"), keys, "left_semi").select("__row.*")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Each document with its fingerprint and the class of near duplicates it is in.

    Documents whose fingerprints differ in 2 bits or fewer are linked; a class
    is what links connect. Equal fingerprints are one node, so that copies make
    no pairs. Only fingerprints are shuffled, never texts.

    Defined results: a null or blank text has fingerprint 0 and is linked like
    any other; a text of fewer than `width` words has one shingle; repeated
    rows stay; a null doc_id gets a class but never names one, unless all of
    the class are null; an empty table gives no rows; columns of `docs` besides
    doc_id and text are not read.

    Returns doc_id, print (signed long), component_id.
    """
    rows = cut(fingerprints(docs, width, seed))
    prints = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints.select("print")))
    named = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(classes, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def one_of_each(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """`docs` with one row of each class of near duplicates (see `keep_one`)."""
    rows = cut(fingerprints(row_keys(docs), width, seed, ["key"]))
    return keep_one(docs, classes(rows))
