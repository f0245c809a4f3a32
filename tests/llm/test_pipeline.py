"""The pipeline's stages, each on what the one before kept."""

import json

import corpus_pipeline
from test_near_sets import classes

import __spark_entry__

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    counts, texts = [docs.count()], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            texts.append({r.doc_id: r.text for r in docs.collect()})
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2]
    assert not [i for i in texts[1] if labels.get(i) == 0]
    assert all(i in texts[0] for i, q in labels.items() if q == 1)
    # one text of each class of the texts that the rules kept, that of its least doc_id
    least = {}
    for i, t in texts[1].items():
        least[t] = min(i, least.get(t, i))
    assert set(texts[2]) == {min(least[t] for t in c) for c in classes(list(least))}
    assert counts[5] == counts[4] and docs.columns[0] == "doc_id"


def test_registered(spark):
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert json.dumps(names)
