"""Byte-level BPE: merges folded by Spark functions over distinct words, and decoding."""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, slices, written

#: Buckets of the literal rank map, of a few entries each: a power of two for
#: pieces, and for pairs of ranks a prime.
RANK_BUCKETS, PAIR_BUCKETS = 1 << 14, 65_521
#: Above all ranks, and no rank.
PAIR, NONE = 1 << 20, 1 << 30
#: The end of a word, as a part: PAIR plus a rank that no piece has, so that no pair is made with it.
END = 2 * PAIR - 1
#: Bytes of a word up to which `fold_short` is used.
SHORT = 64
#: Most entries of the dictionary of frequent words; others are folded where they occur.
DICTIONARY = 1 << 19
#: Words that a counter holds.
COUNTED_WORDS = 200_000

#: Bytes are held as the characters of the same number; these two stand around a part.
OPEN, SHUT = "Ā", "ā"


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def as_characters(piece: bytes) -> str:
    return piece.decode("latin-1")


def bucketed(entries: dict, count: int, place) -> list[dict]:
    """So many small maps of the entries, because Spark searches a map entry by entry."""
    buckets: list[dict] = [{} for _ in range(count)]
    for key, value in entries.items():
        buckets[place(key) % count][key] = value
    return buckets


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal of one row: of each byte, of each piece (its bytes
    as characters), and of each two pieces that make one. Its size is that of
    the vocabulary file, whatever the input.

    It is a scalar subquery: written out as a literal it would be in every text
    that Spark keeps of a plan (4 MB each). Spark takes none within a
    higher-order function, so it has to be a column first.
    """
    pieces = {as_characters(piece): rank for piece, rank in ranks.items()}
    cuts = ((ranks.get(piece[:i]), ranks.get(piece[i:]), rank) for piece, rank in ranks.items() for i in range(1, len(piece)))
    pairs = {a * PAIR + b: rank for a, b, rank in cuts if a is not None and b is not None}
    row = (
        [ranks[bytes([i])] for i in range(256)],
        bucketed(pieces, RANK_BUCKETS, lambda key: xxhash.xxh64_intdigest(key.encode(), 42)),
        bucketed(pairs, PAIR_BUCKETS, lambda key: key),
    )
    table = spark.createDataFrame([row], "bytes array<int>, pieces array<map<string,int>>, pairs array<map<bigint,int>>", verifySchema=False)
    return table.select(F.struct("*").alias("ranks")).scalar()


def let(value: Column, body) -> Column:
    """body(value), with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank(key: Column, ranks: Column) -> Column:
    # the hash is signed here and was not where the buckets were made: the low bits agree
    return F.get(ranks["pieces"], F.xxhash64(key).bitwiseAND(F.lit(RANK_BUCKETS - 1)).cast("int"))[key]


def joined(a: Column, b: Column, ranks: Column) -> Column:
    """The rank of the piece that the pieces of ranks a and b make, or NONE."""
    key = a * F.lit(PAIR).cast("long") + b
    return F.coalesce(F.get(ranks["pairs"], (key % PAIR_BUCKETS).cast("int"))[key], F.lit(NONE))


def fold_short(word: Column, ranks: Column) -> Column:
    """The ranks of the parts that a short word is merged into.

    The state is one array: parts, each the rank of its piece plus PAIR, and
    between two of them the rank of both joined, or NONE; NONE and END also stand at
    either end. A step merges the first pair of least rank, which is the new
    part, and looks up its two new neighbourhoods.
    """

    def step(state: Column, _: Column) -> Column:
        def merged(i: Column) -> Column:
            least = F.get(state, i - 1)
            new = F.array(joined(F.get(state, i - 4) - PAIR, least, ranks), least + PAIR, joined(least, F.get(state, i + 2) - PAIR, ranks))
            return F.when(least >= PAIR, state).otherwise(F.concat(F.slice(state, F.lit(1), i - 3), new, F.slice(state, i + 3, F.size(state))))

        return let(F.array_position(state, F.array_min(state)).cast("int"), merged)

    def start(parts: Column) -> Column:
        def with_next(x: Column, i: Column) -> Column:
            return F.array(x + PAIR, F.when(i + 1 < F.size(parts), joined(x, F.get(parts, i + 1), ranks)).otherwise(F.lit(NONE)))

        state = F.concat(F.array(F.lit(END), F.lit(NONE)), F.flatten(F.transform(parts, with_next)), F.array(F.lit(END)))
        final = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), state, step)
        return F.transform(F.filter(final, lambda x: (x >= PAIR) & (x < END)), lambda x: x - PAIR)

    letters = F.filter(F.split(word, "", -1), lambda c: c != "")
    return let(F.transform(letters, lambda c: F.get(ranks["bytes"], F.ascii(c))), start)


def fold_long(word: Column, ranks: Column) -> Column:
    """The ranks of the parts that a long word is merged into.

    The state is the string of parts, each between two marks. A step looks up
    all neighbours joined and replaces the pair of least rank wherever it
    stands, from left to right: what a merge makes has a greater rank than the
    merge, so that no better pair can come up in between. A long word takes as
    many steps as there are kinds of merges, not merges.
    """

    def parts_of(s: Column) -> Column:
        return F.split(F.substring(s, F.lit(2), F.length(s) - 2), SHUT + OPEN, -1)

    def step(state: Column, _: Column) -> Column:
        def merged(parts: Column) -> Column:
            found = F.transform(parts, lambda p, i: rank(F.concat(p, F.get(parts, i + 1)), ranks))

            def at(r: Column) -> Column:
                def replaced(i: Column) -> Column:
                    a, b = F.get(parts, i), F.get(parts, i + 1)
                    pair, one = F.concat(F.lit(OPEN), a, F.lit(SHUT + OPEN), b, F.lit(SHUT)), F.concat(F.lit(OPEN), a, b, F.lit(SHUT))
                    return F.struct(F.replace(state["s"], pair, one).alias("s"), F.lit(True).alias("live"))

                done = F.struct(state["s"].alias("s"), F.lit(False).alias("live"))
                return F.when(F.array_min(r).isNull(), done).otherwise(let((F.array_position(r, F.array_min(r)) - 1).cast("int"), replaced))

            return let(found, at)

        return F.when(state["live"], let(parts_of(state["s"]), merged)).otherwise(state)

    bytes_ = F.filter(F.split(word, "", -1), lambda b: b != "")
    first = F.concat(F.lit(OPEN), F.array_join(bytes_, SHUT + OPEN), F.lit(SHUT))
    steps = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    final = F.aggregate(steps, F.struct(first.alias("s"), F.lit(True).alias("live")), step)
    return F.transform(parts_of(final["s"]), lambda p: rank(p, ranks))


def fold(words: Column, ranks: Column) -> Column:
    """The ids of each word of an array, its bytes given as characters: its own
    rank if it has one, else the ranks of what its bytes are merged into."""

    def one(word: Column, m: Column) -> Column:
        whole, long = rank(word, m), F.length(word) > SHORT
        return F.when(whole.isNotNull(), F.array(whole)).when(long, fold_long(word, m)).otherwise(fold_short(word, m))

    # the map is named once, or it would be worked out at each place it is used at
    return let(ranks, lambda m: F.transform(words, lambda w: one(w, m)))


#: The characters with the Unicode property White_Space.
SPACES = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


@lru_cache(maxsize=2)
def splitter(pattern: str) -> regex.Pattern:
    """`pattern` compiled, with the white space that Unicode names spelled out:
    four control characters count as such in Python only."""
    out, inside = [], False
    for token in re.findall(r"\\.|.", pattern, re.DOTALL):
        inside = token == "[" or inside and token != "]"
        spaces = {r"\s": SPACES, r"\S": f"^{SPACES}"}.get(token)
        out.append(token if spaces is None else spaces if inside else f"[{spaces}]")
    return regex.compile("".join(out))


#: Marks of which `pattern` makes one word at the end of letters (an apostrophe may
#: begin another), and words of Latin letters.
MARKS, LETTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "^[A-Za-zÀ-ÖØ-öø-ɏ]+$"
#: A space that another one, or an end of the text, is beside.
ODD_SPACE = f"(?:^|[{SPACES}\\x1C-\\x1F]) | (?:$|[{SPACES}\\x1C-\\x1F])"


def split_texts(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the numbers of all texts' words end to end, and how many each has.

    Where a single space stands between other characters, `pattern` always
    begins a word with it. So a text is cut there first. A part of Latin letters
    with marks behind them has two words, the letters and the marks; `pattern`
    splits each other distinct part once. Texts with other spaces are one part
    each.
    """
    odd = pc.match_substring_regex(texts, re.sub(r"\\u(....)", r"\\x{\1}", ODD_SPACE)).to_numpy(zero_copy_only=False)
    cuts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    parts = pa.concat_arrays([cuts.flatten(), texts.filter(pa.array(odd))]).dictionary_encode()
    sizes = np.append(pc.list_value_length(cuts).to_numpy(zero_copy_only=False), np.ones(odd.sum(), np.int64)).astype(np.int64)
    at = 2 * parts.indices.to_numpy().astype(np.int64)
    at[np.cumsum(sizes) - sizes] += 1  # a part that begins a text has no space before it
    used, at = np.unique(at, return_inverse=True)
    spelled, first = parts.dictionary.take(pa.array(used >> 1)), pa.array(used & 1 == 1)
    cores = pc.utf8_rtrim(spelled, MARKS)
    simple = pc.match_substring_regex(cores, LETTERS)
    marked = pc.and_(simple, pc.not_equal(cores, spelled))
    simple_, marked_ = simple.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
    spaced = pc.if_else(first, "", " ")
    leads = pc.binary_join_element_wise(spaced, cores, "").filter(simple)
    marks = [w[len(c) :] for w, c in zip(*(x.filter(marked).to_numpy(zero_copy_only=False) for x in (spelled, cores)), strict=True)]
    others = [*map(splitter(pattern).findall, pc.binary_join_element_wise(spaced, spelled, "").filter(pc.invert(simple)).to_numpy(zero_copy_only=False))]
    words = pa.concat_arrays([leads, pa.array(marks, pa.string()), pa.array([w for ws in others for w in ws], pa.string())]).dictionary_encode()
    lengths = 1 + marked_.astype(np.int64)
    lengths[~simple_] = k = np.array([len(ws) for ws in others], np.int64)
    begins, number = np.cumsum(lengths) - lengths, words.indices.to_numpy()
    flat = np.empty(lengths.sum(), np.int64)
    flat[begins[simple_]] = number[: len(leads)]
    flat[begins[marked_] + 1] = number[len(leads) : len(leads) + len(marks)]
    flat[np.repeat(begins[~simple_] - (np.cumsum(k) - k), k) + np.arange(k.sum())] = number[len(leads) + len(marks) :]
    codes = gathered(flat, begins, lengths, at)
    ends = np.cumsum(sizes)
    totals = np.append(0, np.cumsum(lengths[at]))
    sizes = totals[ends] - totals[ends - sizes]
    # back into the order of the texts
    order = np.argsort(np.append(np.flatnonzero(~odd), np.flatnonzero(odd)))
    return words.dictionary, gathered(codes, np.cumsum(sizes) - sizes, sizes, order), sizes[order]


def gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists with the numbers `at` end to end, of those with these begins and lengths in `values`."""
    n = lengths[at]
    after = np.cumsum(n)
    return values[np.repeat(begins[at] - (after - n), n) + np.arange(after[-1] if len(after) else 0)]


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """word (its bytes as characters) and n over all texts; tasks hand on what they have counted."""

    def spill(counts: Counter) -> pa.RecordBatch:
        words = [as_characters(w.encode("utf-8", "replace")) for w in counts]
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches, 0):
            words, codes, _ = split_texts(b.column(0), pattern)
            counts.update(dict(zip(words.to_numpy(zero_copy_only=False), np.bincount(codes, minlength=len(words)).tolist(), strict=True)))
            if len(counts) > COUNTED_WORDS:
                yield spill(counts)
        yield spill(counts)

    return docs.where("text is not null").select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """The words of up to SHORT bytes above a count that at most `most` words reach.

    Counts are put into eighths of powers of two, so that what the driver sees
    of them is bounded, and whole classes are taken from the top.
    """
    counts = counts.where(F.length("word") <= SHORT)
    level = F.floor(F.log2("n") * 8).cast("int")
    taken, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        taken += row["words"]
        if taken > most:
            break
        least = row["level"]
    return counts.where(level >= least) if least is not None else counts.where(F.lit(False))


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = DICTIONARY) -> pa.Table:
    """word (its bytes as characters) and ids of the frequent words, folded by
    tasks: at most `most` rows of SHORT bytes and ids each."""
    spark = docs.sparkSession
    words = frequent(cut(word_counts(docs, pattern)), most).select("word").repartition(4 * spark.sparkContext.defaultParallelism)
    words = words.withColumn("ranks", rank_map(spark, ranks))
    return words.select("word", F.element_at(fold(F.array("word"), F.col("ranks")), 1).alias("ids")).toArrow()


class Lookup:
    """The dictionary's words, and their ids end to end."""

    def __init__(self, known: pa.Table):
        self.spelled = known["word"]
        self.ids, self.ends = flattened(known["ids"].combine_chunks())

    @cached_property
    def words(self) -> pa.Array:
        """The words as texts have them; only workers that look words up make them."""
        parts = [pa.array([], pa.string())]
        for chunk in self.spelled.iterchunks():
            for k in range(0, len(chunk), 4096):
                some = chunk.slice(k, 4096).to_pylist()
                parts.append(pa.array([w.encode("latin-1") for w in some], pa.binary()).cast(pa.string()))
        return pa.concat_arrays(parts)


def flattened(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))


#: The dictionary that this worker read last, by its name.
LOADED: dict[str, Lookup] = {}


def loaded(name: str, shared: Broadcast) -> Lookup:
    if name not in LOADED:
        LOADED.clear()
        with pa.ipc.open_stream(shared.value) as stream:
            LOADED[name] = Lookup(stream.read_all())
    return LOADED[name]


def shared_table(spark: SparkSession, known: pa.Table) -> Broadcast:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as stream:
        stream.write_table(known)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def encode(docs: DataFrame, path: str, pattern: str, most: int = DICTIONARY, decoded: bool = False) -> DataFrame:
    """doc_id and ids (packed as little-endian unsigned 32-bit integers) of every
    whole text; if `decoded`, also what `decode` adds, in the same Python workers.

    `path` is a file of ranks, `pattern` splits texts into words. Words are
    counted over all documents, and the most frequent, at most `most`, are
    folded once and broadcast as a dictionary. Then documents are looked up in
    blocks (see `slices`); the distinct words of a block that
    the dictionary lacks are written with it and folded in the block's row. All
    that is narrow: no text is shuffled, and every word has its ids by the same
    fold.

    Defined results: a null or empty text has no ids; repeated rows get the
    same ids; an empty table gives no rows; other columns are not read.
    """
    spark, ranks = docs.sparkSession, ranks_of(path)
    known, name = shared_table(spark, dictionary(docs, ranks, pattern, most)), uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType
    blocks = T.StructType([T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("rare", T.ArrayType(T.StringType()))])
    encoded = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_ = loaded(name, known).words
        for b in slices(batches, 1):
            words, codes, sizes = split_texts(b.column(1), pattern)
            found = pc.fill_null(pc.index_in(words, value_set=frequent_), -1).to_numpy()
            is_rare = found < 0
            places = np.where(is_rare, -np.cumsum(is_rare), found).astype(np.int32)
            rare = words.filter(pa.array(is_rare)).to_pylist()
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype(np.int64), places[codes])]
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(0))
            spelled = pa.array([[as_characters(w.encode("utf-8", "replace")) for w in rare]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([doc_ids, *packed, spelled], blocks.names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(name, known)
        for b in batches:
            for k in range(len(b)):
                doc_ids, lists = b.column(0)[k].values, b.column(3)[k].values
                sizes, codes = (np.frombuffer(b.column(i)[k].as_py(), t) for i, t in ((1, np.int64), (2, np.int32)))
                more, ends = flattened(lists)
                begins = np.concatenate([own.ends[:-1], len(own.ids) + ends[:-1]])
                lengths = np.concatenate([np.diff(own.ends), np.diff(ends)])
                words = np.where(codes < 0, len(own.ends) - 2 - codes, codes)
                n = lengths[words]
                after = np.append(0, np.cumsum(n))
                ids = np.concatenate([own.ids, more])[np.repeat(begins[words] - after[:-1], n) + np.arange(after[-1])].astype("<u4")
                cuts = after[np.append(0, np.cumsum(sizes))]
                packed = [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(packed, pa.binary())], encoded.names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(look_up, blocks)
    # written, so that a task has one Python worker at a time
    rows = written(rows, "bpe-blocks", "zstd")
    rows = rows.withColumn("ranks", rank_map(spark, ranks)).select("doc_ids", "sizes", "codes", fold(F.col("rare"), F.col("ranks")).alias("rare"))
    if decoded:
        return rows.mapInArrow(lambda batches: decoded_batches(assemble(batches), path), with_decoded(encoded))
    return rows.mapInArrow(assemble, encoded)


def with_decoded(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField("decoded", T.BinaryType())])


def decoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    piece = {i: b for b, i in ranks_of(path).items()}.__getitem__
    for b in batches:
        texts = [b"".join(map(piece, np.frombuffer(x.as_py(), "<u4").tolist())) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], [*b.schema.names[:2], "decoded"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """`rows` (doc_id, ids as `encode` packs them) with `decoded`, the bytes: the
    pieces of all ids, concatenated. An id that the file lacks is an error."""
    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(lambda batches: decoded_batches(batches, path), with_decoded(rows.schema))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
