"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: N-grams have up to three characters; a profile has the PROFILE most frequent.
PROFILE = 300
#: N-grams, repeats included, that a task holds before it adds them up.
HELD = 4_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """All n-grams of a text's words in lower case, as numbers.

    A word is a run of letters between two marks; what isn't a letter is a
    mark. A mark alone is no n-gram, and none reaches across a mark. A number
    has 21 bits for each character, the code point and 2, or 1 for a mark.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    v = np.ones(len(points) + 2, np.uint64)
    known = letters()[points]
    v[1:-1][known] = points[known] + 2
    letter = v > 1
    two = v[:-1] | v[1:] << np.uint64(21)
    three = (two[:-1] | v[2:] << np.uint64(42))[letter[1:-1]]
    return np.concatenate([v[letter], two[letter[:-1] | letter[1:]], three])


def spelled(gram: int) -> str:
    """The characters of an n-gram's number, marks as underscores."""
    points = [(gram >> shift) & 0x1FFFFF for shift in (0, 21, 42)]
    return "".join("_" if p == 1 else chr(p - 2) for p in points if p)


def mixed(gram: np.ndarray) -> np.ndarray:
    """A hash that orders n-grams of the same count, the same in every task."""
    x = (gram ^ (gram >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and n over all rows of `docs` with a text and a language; a task adds up before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        held = 0

        def spill() -> Iterator[pa.RecordBatch]:
            for lang, parts in found.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            found.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                found.setdefault(lang.as_py(), []).append(g := grams(text.as_py()))
                held += len(g)
                if held > HELD:
                    yield from spill()
                    held = 0
        yield from spill()

    known = docs.where("text is not null and lang is not null").select("text", "lang")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """For each language its PROFILE most frequent n-grams, in order.

    Counts cover all rows of `docs`; what reaches the driver is bounded by
    PROFILE for each language. A language without a letter in any text has no
    profile.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("gram"), "gram")
    top = gram_counts(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, rank in top.select("lang", "gram", "rank").toLocalIterator():
        found.setdefault(lang, []).append((rank, gram))
    return {lang: np.array([g for _, g in sorted(rows)], np.int64).view(np.uint64) for lang, rows in sorted(found.items())}


class Scorer:
    """Out-of-place distances of texts to profiles."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = list(profiles)
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.uint64)]))
        self.places = np.full((len(self.known), len(self.langs)), -1)
        for k, own in enumerate(profiles.values()):
            self.places[np.searchsorted(self.known, own), k] = np.arange(len(own))

    def score(self, text: str | None) -> tuple[str, float]:
        every = grams(text or "")
        if not len(every) or not self.langs:
            return "und", 0.0
        gram, n = np.unique(every, return_counts=True)
        if len(gram) > PROFILE:  # none below the PROFILE-th largest count can be among the first
            often = n >= np.partition(n, len(n) - PROFILE)[len(n) - PROFILE]
            gram, n = gram[often], n[often]
        first = gram[np.lexsort((mixed(gram), -n))[:PROFILE]]
        at = np.minimum(np.searchsorted(self.known, first), len(self.known) - 1)
        places = np.where((self.known[at] == first)[:, None], self.places[at], -1)
        apart = np.where(places < 0, PROFILE, np.abs(places - np.arange(len(first))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], 1 - float(apart[best]) / (PROFILE * len(first))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every whole text, in one pass without a shuffle.

    A document's n-grams are ranked by count, and the first PROFILE are compared
    with each profile: the distance is the sum of how far ranks are apart,
    PROFILE where the profile lacks the n-gram. The nearest language wins, on
    ties the first in code point order; the score is 1 less the distance as a
    share of the greatest possible.

    Defined results: `und` with score 0 for a text that is null or has no
    letter, or if no language was learned; repeated rows are scored alike; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles)
        for b in batches:
            found = [scorer.score(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
