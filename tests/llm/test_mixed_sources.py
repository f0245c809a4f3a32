"""Words by source of the mixed documents."""

from collections import defaultdict

from tessera.llm import mixing


def words_by_source(rows):
    by = defaultdict(int)
    for r in rows:
        by[r.source] += len(r.text.split())
    return by


def test_whole_documents_meet_the_targets(spark):
    text = lambda i, n: f"d{i} " + "w " * (n - 1)
    rows = [(i, text(i, 1024), "hot") for i in range(300)]  # 8 blocks each, target far below half of the words
    rows += [(1000 + i, text(i, 40 + 7 * (i % 50)), "mid") for i in range(600)]
    rows += [(2000 + i, text(i, 3 + i % 400), None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.documents_by_targets(df)
    found = got.collect()
    words = words_by_source(found)
    facts = {r.source: (r.target, r.source_size) for r in mixing.mix(df).collect()}
    largest = {"hot": 1024, "mid": 383, None: 402}
    assert got.columns == df.columns and facts["hot"][0] < 0.5 * facts["hot"][1]
    for source, (target, _) in facts.items():
        assert abs(words[source] - target) <= largest[source] + 2
    assert max(sum(r.doc_id == i for r in found) for i in (0, 1000, 2000, 2399)) <= 3
    assert abs(words_by_source(mixing.mixed_documents(df).collect())["hot"] - facts["hot"][0]) > 10 * 1024
