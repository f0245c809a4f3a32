"""Lines that many documents share, dropped by bitmaps of the lines to keep."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach, cut, slices, written

#: A key of so many code points that is in so many documents loses its lines.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Lines of a range partition, and of a chunk of it that is looked at at once, about.
RANGE_ROWS, CHUNK_ROWS = 1_000_000, 100_000

#: What a chunk of sorted lines yields: lines to drop, lines whose key may go on in other chunks, and the first documents of such keys.
DROP, PENDING, HEAD = 0, 1, 2
LINES = "h1 long, h2 long, doc_id long, k1 long, k2 long, pos int, nth long"
FOUND = "kind int, h1 long, h2 long, doc_id long, k1 long, k2 long, pos int"


def row_key() -> list[Column]:
    """128 bits of a row's doc_id and text; rows that share them lose the same lines."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(11)).alias("k2")]


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One narrow row for each line whose key has at least `least_chars` code
    points: the key's 128-bit hash, the document, the row's key, the line's
    number, and its place in its task, by which ranges can cut through equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for b in slices(batches, 1):
            hashes, rows, pos = [], [], []
            for row, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                for at, line in enumerate((text or b"").lower().split(b"\n")):
                    if len(line) < least_chars:
                        continue
                    key = line.strip()
                    if len(key) >= least_chars and (key.isascii() or len(key.decode(errors="replace")) >= least_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        pos.append(at)
            if rows:
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                own = b.select(["doc_id", "k1", "k2"]).take(pa.array(rows, pa.int32()))
                places = np.arange(nth, nth + len(rows))
                nth += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *own.columns, pa.array(pos, pa.int32()), pa.array(places)], ["h1", "h2", "doc_id", "k1", "k2", "pos", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key()).mapInArrow(run, LINES)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    out[0] = True
    return out


def decided(t: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """What is known from one chunk of lines, sorted by key and by falling document.

    A key between the chunk's first and last is whole here, and its first
    document keeps its lines. The first and the last key may go on in other
    chunks: their lines are pending, and their first `least` documents are
    heads, from which all chunks' counts and largest documents follow.
    """
    h1, h2 = (t[c].to_numpy() for c in ("h1", "h2"))
    missing, ids = t["doc_id"].is_null().to_numpy(), t["doc_id"].fill_null(0).to_numpy()
    new_key = changes(h1, h2)
    new_doc = new_key | changes(ids, missing)
    run, seen = np.cumsum(new_key) - 1, np.cumsum(new_doc)
    starts = np.flatnonzero(new_key)
    rank = seen - seen[starts][run]  # 0 for lines of the key's first document
    documents = np.maximum.reduceat(rank, starts) + 1
    edge = (run == 0) | (run == run[-1])
    chosen = {DROP: ~edge & (documents[run] >= least) & (rank > 0), PENDING: edge, HEAD: edge & new_doc & (rank < least)}
    for kind, which in chosen.items():
        rows = t.filter(pa.array(which)).drop_columns(["nth"])
        yield from rows.add_column(0, "kind", pa.array(np.full(len(rows), kind, np.int32))).combine_chunks().to_batches()


def dropped_lines(lines: DataFrame, least_docs: int = LEAST_DOCS, chunk_rows: int = CHUNK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """k1, k2, pos: the lines to drop among `lines` (materialised, see `long_lines`).

    Lines are dealt into ranges of their keys, documents and places, so that
    the lines of a hot key are cut into many ranges, and sorted there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= chunk_rows:
                yield from decided(pa.Table.from_batches(held), least_docs)
                held, n = [], 0
        if n:
            yield from decided(pa.Table.from_batches(held), least_docs)

    order = [F.col("h1"), F.col("h2"), F.desc_nulls_last("doc_id"), F.col("k1"), F.col("k2"), F.col("nth")]
    ranges = lines.repartitionByRange(lines.count() // range_rows + 1, *order)
    found = written(ranges.sortWithinPartitions(*order).mapInArrow(run, FOUND), "line-runs")
    keys = found.where(F.col("kind") == HEAD).groupBy(F.struct("h1", "h2").alias("h")).agg(F.count_distinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("largest"))
    keys = cut(keys.where(F.col("n") >= least_docs).drop("n"))
    pending = attach(found.where(F.col("kind") == PENDING).withColumn("h", F.struct("h1", "h2")), keys, "h")
    pending = pending.where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    return found.where(F.col("kind") == DROP).select("k1", "k2", "pos").unionByName(pending.select("k1", "k2", "pos"))


def packed_runs(places: np.ndarray) -> bytes:
    """A bitmap as the lengths of its runs, kept and dropped by turns, as LEB128
    numbers; what is behind the last dropped line is kept."""
    ends = np.flatnonzero(np.r_[np.diff(places) != 1, True])
    begins = np.r_[0, ends[:-1] + 1]
    out, at = bytearray(), 0
    for begin, end in zip(places[begins].tolist(), (places[ends] + 1).tolist(), strict=True):
        for n in (begin - at, end - begin):
            while n > 127:
                out.append(n & 127 | 128)
                n >>= 7
            out.append(n)
        at = end
    return bytes(out)


def dropped_runs(bitmap: bytes) -> list[tuple[int, int]]:
    """(first line, line behind the last) of each dropped run of a bitmap."""
    lengths, n, shift = [], 0, 0
    for x in bitmap:
        n |= (x & 127) << shift
        shift += 7
        if x < 128:
            lengths.append(n)
            n = shift = 0
    ends = np.cumsum(lengths).tolist()
    return list(zip(ends[::2], ends[1::2], strict=True))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, chunk_rows: int = CHUNK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """k1, k2 (see `row_key`), n_dropped and bitmap (see `packed_runs`) of every row that loses lines.

    A line's key is the line without ASCII white space at its ends and with
    A-Z lower-cased. A key of at least `least_chars` code points in at least
    `least_docs` documents loses its lines, but for those of the largest
    doc_id that holds it. Keys are told apart by 128-bit hashes; no text is
    shuffled.

    Defined results: a null or an empty text has one empty line; rows of one
    doc_id are one document, and so are rows without a doc_id, which is less
    than any other; equal rows share one bitmap; an empty table gives no rows;
    columns besides doc_id and text are not read.
    """
    gone = dropped_lines(written(long_lines(docs, least_chars), "lines"), least_docs, chunk_rows, range_rows)
    gone = gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [np.array(x) for x in b.column(2).to_pylist()]
            bitmaps = pa.array([packed_runs(x) for x in places], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in places], pa.int64()), bitmaps], ["k1", "k2", "n_dropped", "bitmap"])

    return gone.mapInArrow(run, "k1 long, k2 long, n_dropped long, bitmap binary")


def kept_text(text: bytes, bitmap: bytes | None) -> bytes:
    if not bitmap:
        return text
    lines, out, at = text.split(b"\n"), [], 0
    for begin, end in dropped_runs(bitmap):
        out += lines[at:begin]
        at = end
    return b"\n".join(out + lines[at:])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_dropped and bitmap of every row; null where no line goes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    return rows.join(bitmaps, ["k1", "k2"], "left").select("doc_id", "text", "n_dropped", "bitmap")


def clean(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id and the text without its dropped lines; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            kept = [None if t is None else kept_text(t, x) for t, x in zip(texts, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return with_bitmaps(docs, bitmaps).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept lines, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            hashes = [hashlib.sha256(kept_text(t, x)).hexdigest() for t, x in zip(texts, b.column(3).to_pylist(), strict=True)]
            lines = pa.array([t.count(b"\n") + 1 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), lines, b.column(2).fill_null(0), pa.array(hashes)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs, bitmaps).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: The same in SQL; key columns as above, ties and nulls as there.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM d),
l AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key),
m AS (SELECT k.*, coalesce(g.n >= 5 AND k.doc_id IS DISTINCT FROM g.largest, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
