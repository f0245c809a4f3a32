"""Quality classifier: a factorisation machine."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of hashed words, and factors of an interaction.
WORD_BUCKETS, FACTORS = 1 << 16, 8
#: Most labelled rows that the model is fitted on, taken in the order of a hash,
#: and the most bytes that a text has for it.
FIT_ROWS, FIT_BYTES = 6_000, 1 << 16
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 1e-4
#: A score from which a text counts as good.
GOOD = 0.3

UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SYMBOL, STOP, BANG = b"#*$%&|<>{}[]\\^~=_@", b".,;:", b"!?"
STATISTICS = ("length", "n_chars", "word_size", "variety", "repeats", "symbols", "capitals", "digits", "stops", "bangs", "same_lines", "line_words")


def share_without(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: the buckets of the words, each once, then one for each statistic.

    A bucket's value is the root of its words' share, so that the squares sum to 1; statistics are ratios or logarithms scaled to about 0 to 1.
    """
    raw = (text or "").encode("utf-8", "replace")
    words = raw.lower().split()
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(share_without(raw, UPPER + LOWER), 1)
    stats = (
        math.log1p(len(words)) / 10,
        math.log1p(max(n_chars or 0, 0)) / 12,
        min(len(raw) / n / 20, 2),
        len(counts) / n,
        again / n,
        min(share_without(raw, SYMBOL) / n, 2),
        share_without(raw, UPPER) / letters,
        share_without(raw, DIGIT) / size,
        min(share_without(raw, STOP) / n, 2),
        min(share_without(raw, BANG) / n, 2),
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)) / 8,
    )
    buckets = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in counts), np.int64, len(counts))
    at, which = np.unique(buckets, return_inverse=True)
    values = np.sqrt(np.bincount(which, np.fromiter(counts.values(), np.float64, len(counts)), len(at)) / n)
    return np.append(at, WORD_BUCKETS + np.arange(len(stats))), np.append(values, stats)


@dataclass
class Machine:
    """score = sigmoid(bias + linear + pairwise), the latter in linear time as
    half of (sum of v x) squared less the sum of (v x) squared."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, at: np.ndarray, values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows that lie end to end in `at` and `values`; none may be empty."""
        vx = self.factors[at] * values[:, None]
        sums = np.add.reduceat(vx, begins)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, begins)).sum(1)
        return self.bias + np.add.reduceat(self.linear[at] * values, begins) + pairs, sums

    def score(self, at: np.ndarray, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(at, values, begins)[0], -30, 30)))


def joined(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(r[0]) for r in rows]
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows], dtype=np.float64), np.cumsum([0, *sizes[:-1]])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Machine:
    """Logistic loss, by AdaGrad over seeded batches. Buckets that fewer than two
    rows have stay at zero, so that unknown words count for nothing."""
    rng, width = np.random.default_rng(seed), WORD_BUCKETS + len(STATISTICS)
    machine = Machine(0.0, np.zeros(width), np.zeros((width, FACTORS)))
    if not len(rows) or labels.min() == labels.max():
        machine.bias = 0.0 if not len(rows) else (5.0 if labels[0] else -5.0)
        return machine
    known = np.bincount(np.concatenate([np.unique(r[0]) for r in rows]), minlength=width) >= 2
    machine.factors[known] = rng.normal(0, 0.05, (known.sum(), FACTORS))
    square_w, square_v, square_b = np.full(width, 1e-8), np.full((width, FACTORS), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), BATCH):
            some = order[k : k + BATCH]
            at, values, begins = joined([(rows[i][0][keep], rows[i][1][keep]) for i in some if (keep := known[rows[i][0]]) is not None])
            margin, sums = machine.margins(at, values, begins)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
            lengths = np.diff(np.append(begins, len(at)))
            g = np.repeat(slope, lengths) * values
            which, inverse = np.unique(at, return_inverse=True)
            gw = np.bincount(inverse, g) + DECAY * machine.linear[which]
            gv = g[:, None] * (np.repeat(sums, lengths, 0) - machine.factors[at] * values[:, None])
            gv = np.stack([np.bincount(inverse, gv[:, f]) for f in range(FACTORS)], 1) + DECAY * machine.factors[which]
            square_w[which] += gw**2
            square_v[which] += gv**2
            square_b += slope.sum() ** 2
            machine.linear[which] -= RATE * gw / np.sqrt(square_w[which])
            machine.factors[which] -= RATE * gv / np.sqrt(square_v[which])
            machine.bias -= RATE * slope.sum() / math.sqrt(square_b)
    return machine


def held_out(folds: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Machine:
    """A machine fitted on at most `most` labelled rows that are not held out.

    The rows are those of the first ids by hash; a document with several labels
    has the least of them, and an id with several rows is one row, the least by
    hash of its text. Texts of over `most_bytes` are left out of the fit. The
    ids, whose number is bounded by `most`, are broadcast, so that no other text
    is shuffled; features are made by the tasks, and the driver gets those of
    `most` rows of bounded size.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.as_py(), n.as_py()) for t, n in zip(b.column(1), b.column(2), strict=True)]
            lists = pa.array([m[0].tolist() for m in made], pa.list_(pa.int32())), pa.array([m[1].tolist() for m in made], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, b.column(3)], ["doc_id", "at", "x", "quality"])

    rows = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    rows = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "n_chars", "quality")).alias("one"))
    got = rows.select("doc_id", "one.text", "one.n_chars", "one.quality").mapInArrow(run, "doc_id long, at array<int>, x array<float>, quality int").toArrow()
    got = got.take(pa.compute.sort_indices(got, [("doc_id", "ascending")])) if len(got) else got
    ends = np.cumsum(pa.compute.list_value_length(got["at"]).to_numpy())[:-1]
    at, x = (np.split(got[c].combine_chunks().flatten().to_numpy(), ends) for c in ("at", "x"))
    return fit(list(zip(at, x, strict=True)) if len(got) else [], np.array(got["quality"].to_pylist(), np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score, from 0 to 1, of every whole text; no join and no shuffle.

    Features are the words, statistics of the text and n_chars as metadata;
    doc_id, lang, source and labels are none.

    Defined results: a null or blank text is scored by its statistics, which
    are zeros; a null n_chars counts as 0; repeated rows get the same score;
    without labelled rows all scores are 0.5; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                at, values, begins = joined([features(t.as_py(), n.as_py()) for t, n in zip(part.column(1), part.column(2), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(machine.score(at, values, begins), pa.float64())], ["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text", F.col("n_chars").cast("long")).mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, least: float = GOOD) -> DataFrame:
    """The rows of `docs` that score `least` or more, with the same columns."""
    machine = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                text, n_chars = part.column(part.schema.get_field_index("text")), part.column(part.schema.get_field_index("n_chars"))
                rows = joined([features(t.as_py(), n.as_py()) for t, n in zip(text, n_chars, strict=True)])
                yield part.filter(pa.array(machine.score(*rows) >= least))

    return docs.mapInArrow(run, docs.schema)
