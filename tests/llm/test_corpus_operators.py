"""Operators across documents against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from edge_cases import edge_rows
from pyspark.sql import functions as F

from tessera.llm import bitsliced, mixing, sharding, simhash
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, width=3):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = WORD.findall(ws)
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + width]), 42) for k in range(max(1, len(ws) - width + 1))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("cell_rows", [0, 2, 1000])
def test_links_join_all_within_two_bits(spark, cell_rows):
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for p in list(prints)[:12]:  # chains and clusters of near fingerprints
        for _ in range(25):
            p ^= 1 << r.randrange(64)
            prints.add(p)
    prints = sorted(map(signed, prints))
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    found = [tuple(x) for x in simhash.links(df, cell_rows).collect()]
    close = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
    assert all(a < b and close(a, b) for a, b in found)
    want = roots(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if close(a, b)])
    assert roots(prints, found) == want
    got = {x.node: x.root for x in components(simhash.links(df, cell_rows)).collect()}
    assert {p: got.get(p, p) for p in prints} == want


def test_links_of_a_large_cluster_grow_with_its_size(spark):
    prints = {0}
    for a, b, c in itertools.combinations(range(16), 3):
        prints |= {1 << a, 1 << a | 1 << b, 1 << a | 1 << b | 1 << c}
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    n = simhash.links(df).count()
    assert n < 20 * len(prints)
    assert {x.root for x in components(simhash.links(df)).collect()} == {0}


def test_near_duplicates(spark, edges, none):
    got = simhash.near_duplicates(edges).select("doc_id", simhash.hexadecimal(F.col("print")).alias("p"), "component_id").collect()
    assert Counter((r.doc_id, r.p) for r in got) == Counter((r[0], f"{plain_print(r[1]):016x}") for r in edge_rows())
    of = defaultdict(set)
    for r in got:
        of[r.p].add(r.component_id)
    assert all(len(c) == 1 for c in of.values())
    blank = {r.component_id for r in got if r.doc_id in (100, 101, 102)}
    assert blank == {100} and {r.component_id for r in got if r.doc_id in (105, 106)} == {105}
    one = simhash.one_of_each(edges)
    assert one.columns == edges.columns and one.count() == len({r.component_id for r in got})
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5001)]
    random.Random(2).shuffle(pairs)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    want = roots({n for p in pairs for n in p}, pairs)
    assert all(got.get(n, n) == r for n, r in want.items())


def level_targets(sizes, weights, most=3):
    total, free, target = sum(sizes.values()), dict(weights), {}
    while free:
        level = (total - sum(target.values())) / sum(free.values())
        over = [s for s in free if free[s] * level > most * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in free.items()}
        for s in over:
            target[s] = most * sizes[s]
            del free[s]
    return target


def mix_facts(got):
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    return by


def test_mix(spark, edges, none):
    got = mixing.mix(edges, block=16).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in edge_rows())
    by = mix_facts(got)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    sizes = {s: sum(r["size"] for r in by[s]) for s in order}
    want = level_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in order:
        assert {r.source_size for r in by[s]} == {sizes[s]}
        assert np.isclose(by[s][0].target, want[s]) and abs(sum(r.taken for r in by[s]) - want[s]) <= 0.5 + 1e-6
    again = mixing.mix(edges.repartition(3), block=16).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    docs = mixing.mixed_documents(edges, block=16)
    assert docs.columns == edges.columns and docs.where("text is null").count() == 0
    copies = Counter(r.doc_id for r in docs.collect())
    single = {r.doc_id: r for r in got if r.doc_id not in (None, 105)}
    assert all(copies[i] == int(r.taken / r["size"] + 0.5) for i, r in single.items() if r["size"])
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_small_sources_reach_their_caps(spark):
    rows = [(1, "a b c", "x"), (2, "d", "y"), (3, " ".join("w" * 400), "z"), (4, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = mix_facts(mixing.mix(df).collect())
    assert {s: sum(r.taken for r in v) for s, v in by.items()} == {"x": 9, "y": 3, "z": 392, "w": 0}
    assert by["z"][0].target == 392


def test_schedule_takes_every_block_of_an_epoch_once(spark):
    s = spark.createDataFrame([("a", 1000, 2300.0), ("b", 40, 120.0)], "src string, source_size long, target double")
    rows = mixing.schedule(s, block=16, shard_blocks=20).collect()
    for src, size, blocks in (("a", 1000, 63), ("b", 40, 3)):
        first = [r for r in rows if r.src == src and r.epoch == 0]
        assert sorted(r.block for r in first) == list(range(blocks)) and sum(r.words for r in first) == size
    assert sum(r.words for r in rows if r.src == "a") == 2300 and len({r.shard for r in rows}) > 3
    assert [r.block for r in rows if r.src == "a" and r.epoch == 0] != [r.block for r in rows if r.src == "a" and r.epoch == 1]


def test_interleave(spark, edges, none):
    n = len(edge_rows())
    for shards in (1, 7, 40, 200):
        got = sharding.interleave(edges, shards).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows())
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        counts = [len(by[k]) for k in range(shards)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == n
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        if shards == 7:
            for s in {r[3] for r in edge_rows()}:
                share = sum(r[3] == s for r in edge_rows()) / shards
                assert all(abs(sum(r.source == s for r in v) - share) <= 3 for v in by.values())
    assert sharding.interleave(none, 40).count() == 0


def vectors():
    r = np.random.default_rng(3)
    x = r.normal(0, 0.2, (420, 6)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(i * 5, v.tolist()) for i, v in enumerate(x)]
    rows += [(5001, None), (5002, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (5003, [float("nan")] * 6), (5004, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), (5050, [0.5, 0.5]), (5051, [0.5, -0.5]), (5100, [])]
    return rows + [rows[3]]


def test_bitsliced_search(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'x' AS score", "'y' AS q")
    good = {i: tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for i, v in vectors() if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = set()
    for q, v in good.items():
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found)}
    assert {tuple(r) for r in bitsliced.self_search(df).collect()} == want
    rows = bitsliced.cut(bitsliced.quantised(df))
    small = bitsliced.search(rows.where("vec_id % 50 = 0"), bitsliced.index(rows, block_rows=30), 5)
    assert {tuple(r) for r in small.collect()} == want
    assert bitsliced.self_search(df.where("false")).count() == 0


@pytest.mark.parametrize("scale", [1, 30, 10**6])
def test_slices_add_exactly(scale):
    r = np.random.default_rng(scale)
    x = r.integers(-scale, scale + 1, (130, 5))
    x[40:60] = x[3]
    ids = r.permutation(1000)[:130]
    s = bitsliced.Slices.build(ids, ids, x.astype(float))
    for i, q in zip(ids[:25], x[:25], strict=True):
        want = sorted((-int(v), int(j)) for j, v in zip(ids, x @ q, strict=True) if j != i)
        for k in (1, 5, 129, 500):
            assert sorted((-v, j) for j, v in s.top(int(i), q, k)) == want[:k]


def test_search_of_repeated_ids_and_large_values(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, -1.0]), (1, [5.0, 5.0]), (1, [5.0, 5.0]), (1, [-7.0, 5.0]), (50, [2.0**60, -(2.0**61)]), (2, [2.0**62, 2.0**62]), (3, [-(2.0**62), 2.0**62]), (4, [2.0**100, 3.0]), (5, [1e200, 1.0]), (6, [-1e200, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, bitsliced.self_search(df).collect()), key=repr)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            found = sorted((-(v[0] * w[0] + v[1] * w[1]), i) for m, (i, w) in enumerate(whole) if m != n)[:5]
            want += [(q, k + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for k, (s, i) in enumerate(found)]
    assert got == sorted(want, key=repr)


def test_shards_of_equal_rows_and_one_id(spark):
    rows = [(7, "same", "a")] * 300 + [(None, f"text {i}", "b") for i in range(90)] + [(i, "x", None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 5):
        got = sharding.interleave(df.repartition(parts), 8).collect()
        assert len(got) == 440 and all(sorted(r.slot for r in got if r.shard == k) == list(range(55)) for k in range(8))
        assert all(abs(sum(1 for r in got if r.shard == k and r.source == s) - n / 8) <= 1 for k in range(8) for s, n in (("a", 300), ("b", 90), (None, 50)))
        placed = sorted((r.shard, r.slot, r.doc_id or -1, r.text_crc32) for r in got)
        assert parts == 1 or placed == before
        before = placed
    from tessera.llm.common import bucket_count  # ranks follow the hash within a source, whatever the buckets

    plain = spark.createDataFrame([(r,) for r in (1, 300)], "n long").select(bucket_count(F.col("n"))).collect()
    assert [r[0] for r in plain] == [1, 2]
