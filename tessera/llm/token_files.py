"""Token ids of a corpus in compressed binary files, and back."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from tessera.llm.common import attach, cut, prefix_sums
from tessera.llm.repair import Grammar, compress

#: Bytes of text of a shard, and ids of a segment.
SHARD_BYTES, SEGMENT_IDS = 16 << 20, 1 << 20
END = 1
#: Words of Latin letters of which each is one letter in lower case, and its own normal form.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+$"
#: Shards whose segments one task sums.
SHARD_RUN = 1024
#: Words of letters that are encoded as one text, the mark of a word's end in
#: the vocabulary, and marks of which the tokenizer makes one match at a word's end.
JOINED, WORD_END, MARKS = 1000, "</w>", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: The parts of the tokenizer's file that `WordEncoder` relies on.
NORMAL_FORM = [["NFC"], ["Replace", {"Regex": r"\s+"}, " "], ["Lowercase"]]
MATCHES = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
SPACED = re.compile(r"\s")

PARTS = ("sequence", "left", "right", "lengths")


def gathered(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts of `ids` with these begins and lengths, end to end."""
    after = np.cumsum(lengths)
    return ids[np.repeat(begins - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)]


class Lists:
    """Numbered lists that lie end to end in `ids`."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths, self.begins = ids, lengths, np.cumsum(lengths) - lengths

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists with the numbers `at`, end to end, and how long each is."""
        lengths = self.lengths[at]
        return gathered(self.ids, self.begins[at], lengths), lengths


class WordEncoder:
    """Ids of texts, by the ids of their words between ASCII white space.

    The tokenizer's patterns never match across white space, its normal form and
    lower case don't reach across it, and its special tokens have none. So a
    text's ids are its words' ids in turn, and each distinct word of a batch is
    encoded once. A file of other parts is an error.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        own = [[x["type"], *([x["pattern"], x["content"]] if x["type"] == "Replace" else [])] for x in parts["normalizer"]["normalizers"]]
        pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]
        if own != NORMAL_FORM or pattern != MATCHES or any(SPACED.search(x["content"]) for x in parts["added_tokens"]):
            raise ValueError(f"{path}: not a tokenizer of words between white space")
        #: For ASCII letters in lower case, which have their normal form and stand for their own bytes.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True

    def lists(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short texts, end to end, and how many each has.

        Words of letters are encoded many at a time with spaces between them.
        Each is one match of the tokenizer's pattern, and so has one id that
        ends a word. If there are more such ids than words, a letter's normal
        or lower form wasn't one letter, and the words are encoded singly.
        """
        if all(map(str.isalpha, texts)):
            tokenizer = self.plain if all(map(str.isascii, texts)) else self.tokenizer
            ids = np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_last[ids]) + 1
            if len(ends) == len(texts) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def encoded(self, words: pa.Array) -> Lists:
        """The ids of distinct words. Those of ASCII letters, those of other
        letters, and the rest are encoded apart."""
        letters, ascii_ = (f(words).to_numpy(zero_copy_only=False) for f in (pc.utf8_is_alpha, pc.string_is_ascii))
        kinds = np.where(letters, np.where(ascii_, 0, 1), 2)
        parts, order = [], np.argsort(kinds, kind="stable")
        for kind in range(3):
            some = words.filter(pa.array(kinds == kind))
            parts += [self.lists(some.slice(k, JOINED).to_numpy(zero_copy_only=False).tolist()) for k in range(0, len(some), JOINED)]
        found = Lists(*map(np.concatenate, zip(*parts, strict=True)))
        return Lists(*found.of(np.argsort(order)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, without end ids, and how many each has.

        A word of LETTERS with marks behind it has the ids of the letters (in
        lower case, if ASCII) and those of the marks, each of which is a match
        of the tokenizer's pattern. Other words are taken whole: the lower case
        or normal form of other letters may end in a mark that joins those behind.
        """
        split = pc.ascii_split_whitespace(texts)
        sizes, every = pc.list_value_length(split).to_numpy(zero_copy_only=False), split.flatten().dictionary_encode()
        words = every.dictionary
        cores = pc.utf8_rtrim(words, MARKS)
        simple = pc.match_substring_regex(cores, LETTERS)
        lower = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        marked = pc.and_(simple, pc.not_equal(cores, words))
        marks = [w[len(c) :] for w, c in zip(*(x.filter(marked).to_numpy(zero_copy_only=False) for x in (words, cores)), strict=True)]
        # the parts of all words: cores, one empty text, and marks
        parts = pa.concat_arrays([pc.if_else(simple, lower, words), pa.array(["", *marks], pa.string())]).dictionary_encode()
        second = np.full(len(words), len(words))
        second[marked.to_numpy(zero_copy_only=False)] += 1 + np.arange(len(marks))
        two = parts.indices.to_numpy()[np.column_stack([np.arange(len(words)), second])]
        ids, lengths = self.encoded(parts.dictionary).of(two.ravel())
        ids, lengths = Lists(ids, lengths.reshape(-1, 2).sum(1)).of(every.indices.to_numpy())
        before, ends = np.append(0, np.cumsum(lengths)), np.cumsum(sizes)
        return ids, before[ends] - before[ends - sizes]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def with_ends(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.insert(ids, np.cumsum(counts), END).astype(np.uint32)


def write(docs: DataFrame, tokenizer: str, path: str, shard_bytes: int = SHARD_BYTES, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of all texts, each with the end id behind it, in ascending doc_id order.

    Documents are dealt by ranges of doc_id into shards of about `shard_bytes`
    of text. A task encodes its shard by batches, cuts it at document ends into
    segments of at least `segment_ids` ids, and compresses each by Re-Pair; it
    holds one batch and one segment at a time. A row of the files is a segment: shard, segment, n_ids,
    doc_ids and counts of its documents, and the grammar's sequence, left and
    right symbols of its rules, and the rules' expansion lengths, as
    little-endian unsigned 32-bit integers.

    Defined results: a null or empty text is the end id alone; rows of one
    doc_id lie in the order of a hash of their texts, equal rows anywhere among
    each other; null ids come first; a text of any length is in one segment; an
    empty table gives files without rows; other columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(size // shard_bytes + 1, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType.fromDDL("shard int, segment int, n_ids long, counts array<int>, sequence binary, left binary, right binary, lengths binary")
    schema.add("doc_ids", T.ArrayType(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, counts, names, held = [], [], [], 0

        def spill() -> pa.RecordBatch:
            g = compress(np.concatenate(ids))
            columns = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([held], pa.int64()), pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int32()))]
            columns += [pa.array([getattr(g, p).astype("<u4").tobytes()], pa.binary()) for p in PARTS]
            names_ = pa.concat_arrays(names)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(names_)], pa.int32()), names_))
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for b in batches:
            some, n = words.encode(b.column(1))
            all_ids, sizes = with_ends(some, n), n + 1
            ends, begin = np.cumsum(sizes), 0
            while begin < len(b):
                done = ends[begin] - sizes[begin]
                stop = min(int(np.searchsorted(ends, done + segment_ids - held)) + 1, len(b))
                ids.append(all_ids[done : ends[stop - 1]])
                counts.append(sizes[begin:stop])
                names.append(b.column(0).slice(begin, stop - begin))
                held, begin = held + len(ids[-1]), stop
                if held >= segment_ids:
                    yield spill()
                    ids, counts, names, held, segment = [], [], [], 0, segment + 1
        if names:
            yield spill()

    rows.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str, kind: T.DataType = T.LongType()) -> DataFrame:
    """Every document's ids from the files: doc_id, start, ids (little-endian unsigned 32-bit).

    `start` counts the ids of all documents before it: the ids of all segments
    before its own, which are prefix sums over buckets of shards and meet the
    compressed segments, and those before it in the segment.

    Defined results: one row for each row that was written, with its doc_id,
    null or repeated; files without rows give none.
    """
    files = spark.read.parquet(path).withColumn("place", F.struct("shard", "segment"))
    schema = T.StructType.fromDDL("start long, ids binary")
    schema.add("doc_id", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                g = Grammar(*[np.frombuffer(row[p], "<u4").astype(np.uint32) for p in PARTS])
                ids, counts = g.decode().astype("<u4"), np.array(row["counts"], np.int64)
                ends, n = np.cumsum(counts), len(counts)
                offsets = np.append(0, 4 * ends).astype(np.int64)
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(row["base"] + ends - counts, pa.int64()), raw, pa.array(row["doc_ids"], b.schema.field("doc_ids").type.value_type)], schema.names)

    segments = files.select("place", "n_ids", F.expr(f"shard div {SHARD_RUN}").alias("run"))
    bases = cut(prefix_sums(segments, [], "run", [F.col("place")], F.col("n_ids"), "base").select("place", "base"))
    return attach(files, bases, "place").select("base", "counts", "doc_ids", *PARTS).mapInArrow(run, schema).select("doc_id", "start", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids."""
    return rows.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

