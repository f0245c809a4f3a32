"""Near duplicates by shingle sets against brute force."""

import itertools
import random
from collections import defaultdict

from edge_cases import edge_rows

from tessera.llm import near_sets
from tessera.llm.components import components

SCHEMA = "doc_id long, text string"


def plain_set(text, width=5):
    ws = (text or "").lower().split()
    return frozenset(" ".join(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))) if ws else frozenset()


def classes(texts):
    """Classes of texts that pairs at a Jaccard similarity of 0.8 or more connect."""
    sets, up = {t: plain_set(t) for t in texts}, {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            up[top(a)] = top(b)
    by = defaultdict(set)
    for t in texts:
        by[top(t)].add(t)
    return {frozenset(v) for v in by.values()}


def changed(r, text, n):
    ws = text.split()
    for _ in range(n):
        ws[r.randrange(len(ws))] = f"new{r.randrange(10**6)}"
    return " ".join(ws)


def texts():
    r = random.Random(5)
    words = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    found, line = [], words(12)
    for k in range(20):
        base = words(r.choice((8, 30, 120, 300)))
        found += [base, *(changed(r, base, r.choice((0, 1, 1, 2, 3, 6))) for _ in range(5))]
        found += [f"{line} {words(60)}", base + " end"]
    hub = words(110)  # a large group of near copies, most of which are too far from each other
    return found + [changed(r, hub, r.choice((1, 2, 2, 3))) for _ in range(60)]


def test_near_sets_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    by = defaultdict(set)
    for r in near_sets.near_duplicates(df, pivots=8).collect():
        by[r.root].add(rows[r.doc_id][1])
    want = classes([*dict(rows).values()])
    assert {frozenset(v) for v in by.values()} == want and len(want) < len({t for _, t in rows}) - 60


def test_one_of_each_keeps_the_least_of_each_class(spark):
    rows = list(enumerate(texts()[:80]))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in near_sets.one_of_each(df).collect()}
    assert kept == {min(i for i, t in rows if t in c) for c in classes([t for _, t in rows])}


def test_edges_of_near_sets(edges, none):
    one = near_sets.one_of_each(edges)
    assert one.columns == edges.columns and near_sets.one_of_each(none).count() == 0
    got = [r.text for r in one.collect()]
    assert len(got) == len(classes(list({r[1] or "" for r in edge_rows()}))) and len(set(got)) == len(got)


def test_groups_of_near_copies_make_few_pairs(spark, monkeypatch):
    """A group has a bucket for each of its shingles, and pairs came from each: 36,287 for 160 texts."""
    made, pairs_of = [], near_sets.against
    monkeypatch.setattr(near_sets, "against", lambda *a: made.append(pairs_of(*a)) or made[-1])
    r = random.Random(8)
    hub = " ".join(f"w{r.randrange(3000)}" for _ in range(400))
    rows = list(enumerate([changed(r, hub, 2) for _ in range(160)]))
    got = near_sets.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.select("root").distinct().count() == 1 == len(classes([t for _, t in rows]))
    assert sum(d.count() for d in made) < 160 * 40


def test_shingles_of_a_few_rows_in_a_hundred_come_last(spark, monkeypatch):
    """The sample follows the input, so that a shingle of more rows as the input grows isn't taken for a rare one."""
    monkeypatch.setattr(near_sets, "SAMPLE_ROWS", 40)
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} the same five words here" + " x" * (i % 2)) for i in range(2000)]
    known, counts = near_sets.frequent(spark.createDataFrame(rows, SCHEMA), 5, 42)
    assert len(known) == len(counts) > 0 and counts.max() > 100


def jobs(spark, run):
    """How many jobs a call takes."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_leave_the_driver_few_jobs(spark):
    """Each query leaves plans and code in the driver. A chain of 200 nodes took four queries a round, with 94 jobs in all."""
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long").repartition(3)
    got = {}
    n = jobs(spark, lambda: got.update({r.node: r.root for r in components(chain).collect()}))
    assert got == dict.fromkeys(range(1, 201), 0) and n < 85


def test_rounds_of_a_bucket_end_when_pivots_suffice(spark, monkeypatch):
    """Where a bucket has no more nodes outside of its largest class than pivots, all are pivots; by hash, some always were left to another round."""
    calls, checked = [], near_sets.verified
    monkeypatch.setattr(near_sets, "verified", lambda *a: calls.append(1) or checked(*a))
    nothing = near_sets.np.array([], near_sets.np.uint64)
    monkeypatch.setattr(near_sets, "frequent", lambda *a: (nothing, nothing))
    rows = [(i, f"same five words in all own{i}") for i in range(160)]
    got = near_sets.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.select("root").distinct().count() == 160 and len(calls) == 3
