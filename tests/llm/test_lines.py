"""Line dedup against SQL and against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from edge_cases import SCHEMA
from oracle import differences
from pyspark.sql import functions as F

import __spark_entry__
from tessera.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
FOLDER = "/root/testdata/sf0.01"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least_chars, least_docs):
    """(doc_id, n_lines, n_dropped, hash, kept text) of each row."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(doc_id)
    gone = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in gone or gone[key_of(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), None if text is None else "\n".join(kept)))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_registered_query_is_the_sql(spark):
    df = __spark_entry__.queries()["op11_line_dedup"](spark, FOLDER)
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    more, less, n = differences(df, __spark_entry__.oracle_sql()["op11_line_dedup"], FOLDER)
    assert not more and not less and n == 1000


def made(seed):
    r = random.Random(seed)
    lines = [f"Line {i} " + "ab Öé🙂"[i % 7 :] * (i % 9) for i in range(25)] + ["", "  ", "é" * 19 + "x", "é" * 20, "HOT " * 9]
    rows = []
    for i in range(80):
        own = [r.choice(lines) if r.random() < 0.8 else lines[-1] for _ in range(r.randint(1, 12))]
        rows.append((r.choice((i, i, i, i // 2, None)), "\n".join(r.choice(("", " ", "\t\r", "\x0b")) + (x.upper() if r.random() < 0.3 else x) + r.choice(("", "\x0c ")) for x in own)))
    return rows + [(7, None), (None, None), (8, ""), (9, "\n"), (10, "\n\n")] + [(200, "HOT " * 9 + "\n" + lines[8])] * 40


@pytest.mark.parametrize(("seed", "least", "chunk"), [(1, 2, 7), (2, 5, 1), (3, 4, 100_000)])
def test_chunks_and_ranges_leave_no_mark(spark, seed, least, chunk):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("k1", "h1", "pos", "kind", "nth", "largest", "bitmap")})
    bitmaps = line_dedup.keep_bitmaps(docs, 20, least, chunk, 50)
    want = plain(rows, 20, least)
    assert rows_of(line_dedup.digest(docs, bitmaps)) == sorted((x[:4] for x in want), key=repr)
    assert rows_of(line_dedup.clean(docs, bitmaps)) == sorted(((x[0], x[4]) for x in want), key=repr)
    assert all(r.n_dropped > 0 and len(r.bitmap) <= 2 + 2 * r.n_dropped for r in bitmaps.collect())


def test_bitmaps_round_trip():
    import numpy as np

    r = random.Random(5)
    for _ in range(200):
        gone = np.array(sorted(r.sample(range(1000), r.randint(1, 60))) + ([5000, 5001] if r.random() < 0.5 else []))
        assert [k for a, b in line_dedup.dropped_runs(line_dedup.packed_runs(gone)) for k in range(a, b)] == gone.tolist()


def test_edges(edges, none):
    got = rows_of(line_dedup.digest(edges, line_dedup.keep_bitmaps(edges)))
    assert got == sorted((x[:4] for x in plain([(r.doc_id, r.text) for r in edges.collect()], 40, 5)), key=repr)
    assert line_dedup.digest(none, line_dedup.keep_bitmaps(none)).collect() == [] and SCHEMA


def test_the_text_is_not_shuffled_for_bitmaps(edges):
    plan = line_dedup.keep_bitmaps(edges)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
