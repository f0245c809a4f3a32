"""Operators on single texts against plain Python."""

import base64
import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from edge_cases import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, language_id, quality_model, quality_rules, token_files
from tessera.llm.repair import compress

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "/root/testdata/sf0.001/documents.parquet"


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def base_metrics(text):
    ws = WORD.findall(text or "")
    windows = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
    covered = {k + j for k in range(len(ws) - 2) if windows[tuple(ws[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark, edges, none):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules.measure(edges)
    assert as_rows(got.select(columns)) == Counter((r[0], *base_metrics(r[1])) for r in edge_rows())
    assert got.where("kept and (base_failed or size(failed) > 0)").count() == 0
    kept = quality_rules.kept_documents(edges)
    assert kept.columns == edges.columns and kept.count() == got.where("kept").count() > 0
    assert quality_rules.measure(none).count() == 0
    plan = quality_rules.measure(spark.read.parquet(DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Exchange" not in plan and "Python" not in plan


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=14))
def test_repeated_windows(spark, letters):
    t = spark.createDataFrame([(letters,)], "w array<string>")
    assert t.select(quality_rules.repeated_words(F.col("w"))).first()[0] == base_metrics(" ".join(letters))[4]


def test_every_junk_label_goes_and_every_clean_one_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.measure(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert dict(map(tuple, got)) == {0: 0.0, 1: 1.0}


def test_quality_model(spark, edges, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    machine = quality_model.learn(docs, labels)
    seen = quality_model.score(docs, machine).join(labels, "doc_id").where(quality_model.held_out()).collect()
    right = [(r.score >= quality_model.GOOD) == bool(r.quality) for r in seen]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    assert all(r.score >= quality_model.GOOD for r in seen if r.quality)
    again = quality_model.score(docs.repartition(7), quality_model.learn(docs.repartition(3), labels))
    assert as_rows(again) == as_rows(quality_model.score(docs, machine))
    got = quality_model.score(edges, machine).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    kept = quality_model.good_documents(edges, labels.where("false"))
    assert kept.columns == edges.columns and kept.count() == len(edge_rows())
    assert quality_model.score(none, machine).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_model.Machine(0.1, rng.normal(size=8), rng.normal(size=(8, 3)))
    at, x = np.array([1, 4, 6]), np.array([0.5, 2.0, -1.0])
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(m.margins(at, x, np.array([0]))[0][0], 0.1 + m.linear[at] @ x + pairs)


def plain_grams(text):
    found = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f"_{w}_"
        found.update(g for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]) != "_")
    return found


def test_language_profiles(spark, edges, none):
    docs = spark.read.parquet(DOCS)
    counts = {}
    for r in docs.collect():
        counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    got = Counter({(r.lang, language_id.spelled(r.gram)): r.n for r in language_id.gram_counts(docs).collect()})
    assert got == Counter({(lang, g): n for lang, c in counts.items() for g, n in c.items()})
    profiles = language_id.profiles(docs)
    for lang, c in counts.items():
        n = [c[language_id.spelled(int(g))] for g in profiles[lang]]
        assert n == sorted(c.values(), reverse=True)[: language_id.PROFILE]
    scorer = language_id.Scorer(profiles)
    for r in docs.limit(20).collect():
        own = plain_grams(r.text)
        code = {language_id.spelled(int(g)): int(g) for g in np.unique(language_id.grams(r.text))}
        first = sorted(own, key=lambda g: (-own[g], int(language_id.mixed(np.array([code[g]], np.uint64))[0])))[: language_id.PROFILE]
        ranks = {lang: {language_id.spelled(int(g)): i for i, g in enumerate(p)} for lang, p in profiles.items()}
        apart = {lang: sum(abs(k - p[g]) if g in p else language_id.PROFILE for k, g in enumerate(first)) for lang, p in ranks.items()}
        best = min(apart, key=lambda x: (apart[x], x))
        lang, score = scorer.score(r.text)
        assert lang == best and np.isclose(score, 1 - apart[best] / (language_id.PROFILE * len(first)))
    got = language_id.identify(edges, profiles).collect()
    assert len(got) == len(edge_rows()) and {r.lang_pred for r in got if r.doc_id in (100, 101, 102)} == {"und"}
    assert language_id.identify(none, {}).count() == 0 and language_id.profiles(none) == {}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language_id.profiles(docs.where(~language_id.held_out()))
    right = language_id.identify(docs.where(language_id.held_out()), profiles).join(docs, "doc_id").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.99


def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, edges, none):
    path, enc = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding()
    for most in (byte_bpe.DICTIONARY, 20, 0):  # with a full dictionary, a small one, and none
        got = byte_bpe.decode(byte_bpe.encode(edges, path, public_tokenizers.PATTERN, most), path)
        want = Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in edge_rows())
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got.collect()) == want
    both = byte_bpe.encode(edges, path, public_tokenizers.PATTERN, 20, decoded=True)
    assert as_rows(both) == as_rows(got)
    digest = byte_bpe.digest(got).where("doc_id = 109").first()
    assert digest.decoded_sha256 == hashlib.sha256([r[1] for r in edge_rows() if r[0] == 109][0].encode()).hexdigest()
    assert byte_bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_where_a_word_ends_with_a_merge(spark):
    """A merge at a word's end has no neighbour, whatever ranks the pieces have: `!!!` stood for `un`."""
    path, enc = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding()
    texts = [" lotusgun Soygun", " isolateüyorsun siznıцуmun", "characterizationun"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (byte_bpe.DICTIONARY, 0):
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in byte_bpe.encode(df, path, public_tokenizers.PATTERN, most).collect()}
        assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_splitter_on_odd_characters():
    split, enc = byte_bpe.splitter(public_tokenizers.PATTERN), encoding()
    for text in ("a\x1cb\x85 c  d", "  \n\t x", "don't we'LL 12½²", "é́ß​﻿…", "ab  "):
        assert [i for w in split.findall(text) for i in enc.encode_ordinary(w)] == enc.encode_ordinary(text)


def test_token_files(spark, edges, none, tmp_path):
    tok = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(tok)
    docs = edges.where("doc_id is not null").dropDuplicates(["doc_id"])
    token_files.write(docs, tok, str(tmp_path / "a"), shard_bytes=60_000, segment_ids=5_000)
    got = token_files.digest(token_files.read(spark, str(tmp_path / "a"))).orderBy("doc_id").collect()
    start, want = 0, []
    for i, text in sorted({r[0]: r[1] or "" for r in edge_rows() if r[0] is not None}.items()):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert spark.read.parquet(str(tmp_path / "a")).select("shard", "segment").distinct().count() > 3
    token_files.write(edges, tok, str(tmp_path / "b"))
    assert token_files.read(spark, str(tmp_path / "b")).count() == len(edge_rows())
    token_files.write(none, tok, str(tmp_path / "c"))
    assert token_files.read(spark, str(tmp_path / "c")).count() == 0


#: Letters that change when lower-cased or composed, marks, spaces and special tokens.
ODD = [*"abcXYZ  \n\t!?.'`\"|<>_-09", *"İıßΣςﬁ漢🙂ǅª²Ⅷ", "e\u0301", "\u0307", "A\u030a", "\u212b", "\u200d", "\u00a0", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "'s", "n't", "\u1100\u1161", "\ufeff", "\u0345", "İ!"]


def test_token_ids_of_odd_texts():
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    own, library = token_files.encoder(path), Tokenizer.from_file(path)
    assert all(len(x.lower()) == 1 and unicodedata.normalize("NFC", x) == x for x in map(chr, range(0xC0, 0x250)) if re.match(token_files.LETTERS, x))
    for _ in range(10):
        texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(1000)]
        ids, n = own.encode(pa.array(texts))
        ends = np.cumsum(n)
        assert [ids[i:j].tolist() for i, j in zip(ends - n, ends)] == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_grammar_round_trip_and_random_access(ids, a, b):
    ids = np.array(ids, np.uint32)
    g = compress(ids, least=2)
    assert g.decode().tolist() == ids.tolist() and int(g.sizes().sum()) == len(ids)
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert g.decode(a, b).tolist() == ids[a:b].tolist()


def test_grammar_shrinks_repeats():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    g = compress(ids)
    assert len(g.sequence) + 3 * len(g.left) < len(ids) / 10 and g.decode().tolist() == ids.tolist()
