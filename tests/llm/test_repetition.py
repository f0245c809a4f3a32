"""Periodic runs against a search that tries every stretch."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__
from tessera.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def plain_runs(words):
    """Maximal stretches by each period, those of smallest period kept."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, change=True):
    words = WORD.findall(text or "")
    n = len(words)
    if change and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *head, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_registered_query_is_the_plain_search(spark):
    got = __spark_entry__.queries()["op12_periodic_runs"](spark, FOLDER)
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    short = {r.doc_id for r in docs if len(WORD.findall(r.text or "")) < 1500}
    want = sorted((plain(r.doc_id, r.text) for r in docs if r.doc_id in short), key=repr)
    rows = rows_of(got)
    assert len(rows) == len(docs) and [r for r in rows if r[0] in short] == want and sum(r[1] > 0 for r in want) > 5


def odd_texts(seed):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", "a a b " * 4 + "a a", "A a A a A a A a", "é\x1cé é é é é é"]
    for _ in range(60):
        words = [r.choice("abc") for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            unit = [r.choice("abcd") for _ in range(r.randint(1, 12))]
            k = r.randint(0, len(words))
            words[k:k] = (unit * 9)[: len(unit) * r.randint(2, 6) + r.randint(0, len(unit))]
        texts.append(r.choice((" ", "\n", " \t ")).join(words))
    unit = [f"w{i}" for i in range(300)]
    texts.append(" ".join(["x", "y"] * 50 + unit * 5 + unit[:37] + ["z"] * 9))
    return [(r.choice((i, i, None)), t) for i, t in enumerate(texts)] + [(3, "a b c " * 40)] * 30


@pytest.mark.parametrize("long_bytes", [1 << 22, 40])
def test_odd_texts_whole_and_by_ranges_of_lags(spark, long_bytes):
    rows = odd_texts(long_bytes)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, k1 string, begins string").repartition(3)
    assert rows_of(repetition.periodic_runs(docs, change=True, long_bytes=long_bytes)) == sorted((plain(*r) for r in rows), key=repr)


def test_strided_scan_finds_what_a_full_one_finds():
    r = np.random.default_rng(1)
    for _ in range(300):
        ids = r.integers(0, 2, r.integers(1, 400))
        q, least = int(r.integers(1, 20)), int(r.integers(1, 120))
        if r.random() < 0.7 and len(ids) > 60:
            a = int(r.integers(0, 30))
            ids[a:] = np.resize(ids[a : a + q], len(ids) - a)
            ids[int(r.integers(0, len(ids)))] = 7
        found = repetition.at_lag(ids, q, least)
        full = repetition.stretches(ids[: max(len(ids) - q, 0)] == ids[q:])
        enough = full[1] - full[0] >= least
        assert [x.tolist() for x in found] == [x[enough].tolist() for x in full]


def test_edges(edges, none):
    rows = [r for r in edges.collect()]
    short = {(r.doc_id, r.text) for r in rows if len((r.text or "")) < 15_000}
    got = repetition.periodic_runs(edges, long_bytes=50_000).collect()
    want = sorted((plain(r.doc_id, r.text, False) for r in rows if (r.doc_id, r.text) in short), key=repr)
    assert len(got) == len(rows) and [r for r in sorted(map(tuple, got), key=repr) if r in want] == want
    assert repetition.periodic_runs(none).collect() == []
