"""Periodic runs of words, found by comparing word ids with themselves at every lag."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, written

#: A run has at least so many words and repeats its period at least so often.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Texts beyond so many bytes are scanned by ranges of lags, each a row of its own.
LONG_BYTES = 4 << 20
#: Comparisons of a strided scan that a run is sure to hold.
STRIDED = 8

RUNS = "k1 long, k2 long, begins binary, lengths binary, periods binary"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def changed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, periodic from some word on in a tenth of the documents: with
    h = crc32 of the decimal doc_id and g = h // 10, where 10 divides h. Rows
    without a doc_id are left as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, true, False].view(np.int8)))
    return edges[::2], edges[1::2]


def at_lag(ids: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all stretches of at least `least` places i with ids[i] == ids[i + q].

    Where `least` allows, only every so many places are compared at first: a
    stretch holds at least STRIDED of them, one after another. What is around
    such series is then compared place by place.
    """
    n, step = len(ids) - q, least // STRIDED
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if step < 2:
        begins, ends = stretches(ids[:n] == ids[q:])
    else:
        a, b = stretches(ids[:n:step] == ids[q::step])
        wide = b - a >= STRIDED
        lows, highs = np.maximum((a[wide] - 1) * step + 1, 0), np.minimum(b[wide] * step, n)
        found = []
        for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
            x, y = stretches(ids[low:high] == ids[low + q : high + q])
            found.append((x + low, y + low))
        begins, ends = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    enough = ends - begins >= least
    return begins[enough], ends[enough]


def least_length(q: int, least_words: int, least_times: int) -> int:
    return max(least_words, least_times * q)


class Block:
    """Word ids of some documents, the longest first, with a word of its own
    behind each, so that a lag scans only documents that are long enough."""

    def __init__(self, documents: list[list[bytes]]):
        self.lengths = np.array([len(d) for d in documents], np.int64)
        self.order = np.argsort(-self.lengths, kind="stable")
        known: dict[bytes, int] = {}
        flat: list[int] = []
        for i, k in enumerate(self.order.tolist()):
            flat += [known.setdefault(w, len(known)) for w in documents[k]]
            flat.append(-1 - i)
        self.ids = np.array(flat, np.int32)
        sizes = self.lengths[self.order]
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.falling = -sizes

    def runs(self, lags: range, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> tuple[np.ndarray, ...]:
        """Document, begin, length and period of all stretches at the lags.

        A stretch whose words have a smaller period is that period's run too;
        the smallest lag of one document, begin and length is its period.
        """
        found = []
        for q in lags:
            least = least_length(q, least_words, least_times)
            documents = int(np.searchsorted(self.falling, -least, side="right"))  # as long as a run at least
            if not documents:
                break
            end = self.begins[documents] if documents < len(self.begins) else len(self.ids)
            begins, ends = at_lag(self.ids[:end], q, least - q)
            if len(begins):
                inside = self.owner[begins] == self.owner[ends - 1 + q]  # not from one document to another
                begins, ends = begins[inside], ends[inside]
                found.append(np.stack([begins, ends + q - begins, np.full(len(begins), q)]))
        begins, lengths, periods = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        owner = self.owner[begins]
        keep = primitive(owner, begins, lengths, periods)
        owner, begins, lengths, periods = owner[keep], begins[keep], lengths[keep], periods[keep]
        return self.order[owner], begins - self.begins[owner], lengths, periods


def primitive(owner: np.ndarray, begins: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Places of the stretches with the smallest lag among those of one owner,
    begin and length, by owner, begin and period."""
    order = np.lexsort((periods, lengths, begins, owner))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.all([x[order][1:] == x[order][:-1] for x in (owner, begins, lengths)], axis=0)
    order = order[~same]
    return order[np.lexsort((periods[order], begins[order], owner[order]))]


def greatest(begins: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> int:
    """Place of the run of greatest exact exponent; of equals the first."""
    best = 0
    a, p = lengths.tolist(), periods.tolist()
    for i in range(1, len(a)):
        if a[i] * p[best] > a[best] * p[i]:
            best = i
    return best


def repeats(n: int, begins: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of n words are in a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, begins + periods, 1)
    np.add.at(depth, begins + lengths, -1)
    return np.cumsum(depth[:-1]) > 0


def digest(words: list[bytes], begins: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> tuple:
    """The columns of DIGEST but doc_id, for runs in the order of begin and period."""
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(begins.tolist(), lengths.tolist(), periods.tolist(), strict=True))
    best: tuple = (None, None, None, None)
    kept = words
    if len(begins):
        i = greatest(begins, lengths, periods)
        a, n, q = int(begins[i]), int(lengths[i]), int(periods[i])
        best = (a, n, q, 1000 * n // q)
        kept = [words[k] for k in np.flatnonzero(~repeats(len(words), begins, lengths, periods)).tolist()]
    return (len(begins), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * 8
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def of_short(docs: DataFrame, least_words: int, least_times: int, change: bool) -> DataFrame:
    """DIGEST of documents that are scanned whole, some at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            ids = b.column(0).to_pylist()
            words = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            if change:
                words = [changed(w, i) for w, i in zip(words, ids, strict=True)]
            block = Block(words)
            found = block.runs(range(1, int(block.lengths.max(initial=0)) // least_times + 1), least_words, least_times)
            by = np.argsort(found[0], kind="stable")
            owner, runs = found[0][by], [x[by] for x in found[1:]]
            cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
            yield batch([(i, *digest(w, *(x[cuts[k] : cuts[k + 1]] for x in runs))) for k, (i, w) in enumerate(zip(ids, words, strict=True))])

    return docs.mapInArrow(run, DIGEST)


def row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(12)).alias("k2")]


def of_long(docs: DataFrame, least_words: int, least_times: int, change: bool, range_bytes: int) -> DataFrame:
    """DIGEST of long documents: each row is one document and one range of lags.

    Equal rows are scanned once. Ranges take turns at lags (the k-th of r
    takes k, k + r, ...), because small lags compare more places. Runs come
    back as narrow rows, and each document's are put together with its text.
    """
    keyed = written(docs.select("doc_id", "text", *row_key()), "long-texts")
    once = keyed.dropDuplicates(["k1", "k2"])
    ranges = F.ceil(F.octet_length("text") / range_bytes).cast("int")
    dealt = once.select("*", ranges.alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for row in range(len(b)):
                doc_id, text, k1, k2, parts, part = (b.column(c)[row].as_py() for c in ("doc_id", "text", "k1", "k2", "parts", "part"))
                words = text.encode().split()
                block = Block([changed(words, doc_id) if change else words])
                _, *runs = block.runs(range(part + 1, len(words) // least_times + 1, parts), least_words, least_times)
                yield pa.RecordBatch.from_arrays([pa.array([k1]), pa.array([k2]), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in runs)], ["k1", "k2", "begins", "lengths", "periods"])

    scanned = dealt.repartition(F.col("k1"), F.col("k2"), F.col("part")).mapInArrow(scan, RUNS)
    joined = once.join(scanned.groupBy("k1", "k2").agg(*[F.collect_list(c).alias(c) for c in ("begins", "lengths", "periods")], F.lit(0).alias("z")), ["k1", "k2"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = []
            for row in range(len(b)):
                doc_id, text = b.column("doc_id")[row].as_py(), b.column("text")[row].as_py()
                words = text.encode().split()
                words = changed(words, doc_id) if change else words
                runs = [np.frombuffer(b"".join(b.column(c)[row].as_py()), np.int64) for c in ("begins", "lengths", "periods")]
                keep = primitive(np.zeros(len(runs[0]), np.int64), *runs)
                out.append((doc_id, *digest(words, *(x[keep] for x in runs))))
            made = batch(out)
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *made.columns[1:]], ["k1", "k2", *made.schema.names[1:]])

    order = ["doc_id", "text", "k1", "k2", "begins", "lengths", "periods"]
    ends = joined.select(order).mapInArrow(finish, "k1 long, k2 long, " + DIGEST.partition(", ")[2])
    return keyed.select("doc_id", "k1", "k2").join(ends, ["k1", "k2"]).drop("k1", "k2")


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES, change: bool = False, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The periodic runs of every text, and the text without their repeats, as digests (see DIGEST).

    Words are the runs of characters that are not ASCII white space. A run is
    a stretch of at least `least_words` words, and of `least_times` times its
    smallest period, that no neighbouring word extends. All lags up to a text's
    words over `least_times` are scanned. `change` first makes some documents
    periodic (see `changed`), as a check needs it. Texts beyond `long_bytes`
    are scanned by ranges of lags in as many tasks as their size asks for,
    with the same results.

    Defined results: a null, blank or empty text has no words, no runs, nulls
    for the best run, and the hashes of empty strings; equal rows give equal
    rows; an empty table gives no rows; columns besides doc_id and text are
    not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = F.coalesce(F.octet_length("text") <= long_bytes, F.lit(True))
    ends = of_short(docs.where(short), least_words, least_times, change)
    if docs.where(~short).isEmpty():
        return ends
    return ends.unionByName(of_long(docs.where(~short), least_words, least_times, change, long_bytes).select(ends.columns))
