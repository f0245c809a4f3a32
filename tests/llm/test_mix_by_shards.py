"""The mix's draws and permutations, against plain Python."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import mixing


def test_permuted_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 17, 256, 257, 1000, 4099):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.xxhash64(F.lit(n))).alias("p")).collect()
        places = [r.p for r in rows]
        assert sorted(places) == list(range(n))
        steps = Counter((b - a) % n for a, b in zip(places, places[1:]))
        assert n < 1000 or steps.most_common(1)[0][1] < 20  # no arithmetic progression


def test_shards_draw_their_sources(spark):
    rows = [("sa", 6400, 6400.0), ("sb", 25600, 25600.0), ("sc", 32000, 32000.0)]
    sources = spark.createDataFrame(rows, "src string, source_size long, target double")
    slots = mixing.schedule(sources, block=16, shard_blocks=100, seed=3).collect()
    sizes, counts = Counter(r.shard for r in slots), Counter((r.shard, r.src) for r in slots)
    total = sum(sizes.values())
    assert total == 4000 and sum(sizes[k] for k in range(40)) > 3800
    share = {src: size / 64000 for src, size, _ in rows}
    chi = sum((counts[k, src] - 100 * p) ** 2 / (100 * p) for k in range(40) for src, p in share.items())
    assert 45 < chi < 125  # 80 degrees of freedom: neither stratified nor far off
    assert {src: sum(r.words for r in slots if r.src == src) for src in share} == {src: size for src, size, _ in rows}


def test_taken_against_brute_force(spark):
    docs = [(i, " ".join(f"w{i}" for _ in range(1 + 37 * i % 90)), "abc"[i % 3] if i % 7 else None) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df, block=16, shard_blocks=20).collect()
    line = defaultdict(list)
    for r in sorted(got, key=lambda r: r.row_key):
        line["~" if r.source is None else "s" + r.source] += [r.doc_id] * r["size"]
    facts = {("~" if r.source is None else "s" + r.source): (r.source_size, r.target) for r in got}
    sources = spark.createDataFrame([(k, *v) for k, v in facts.items()], "src string, source_size long, target double")
    taken, shards = Counter(), defaultdict(set)
    for s in mixing.schedule(sources, block=16, shard_blocks=20).collect():
        for i in line[s.src][16 * s.block : 16 * s.block + s.words]:
            taken[i] += 1
            shards[i].add(s.shard)
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: taken[r.doc_id] for r in got}
    assert {r.doc_id: (r.first_shard, r.last_shard) for r in got if r.taken} == {i: (min(v), max(v)) for i, v in shards.items()}
