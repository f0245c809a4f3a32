"""The registered queries on whole small tables: their columns, and what they hold against plain Python."""

import zlib
from collections import Counter, defaultdict

import __spark_entry__
from tessera.llm import quality_model

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id", "op2_quality_model": "doc_id held_out score predicted", "op3_token_files": "doc_id start n_tokens ids_crc32",
    "op4_mixing": "doc_id size source_size target taken", "op5_bitsliced": "query_id rank vec_id score",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_language_id": "doc_id held_out lang_pred score", "op9_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op10_html_extract": "page_id url text n_chars",
}


def rows_of(spark, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    return df.collect()


def test_scores_and_kept_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    machine = quality_model.learn(*(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")))
    got = {r.doc_id: r for r in rows_of(spark, "op2_quality_model")}
    assert len(got) == len(docs)
    for d in docs:
        at, x = quality_model.features(d.text, d.n_chars)
        pairs = sum(float(machine.factors[i] @ machine.factors[j]) * a * b for n, (i, a) in enumerate(zip(at, x)) for j, b in zip(at[:n], x[:n])) if len(at) < 60 else None
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        if pairs is not None:
            want = machine.bias + float(machine.linear[at] @ x) + pairs
            assert abs(r.score - 1 / (1 + 2.718281828459045**-want)) < 1e-6
    rules = rows_of(spark, "op6_quality_rules")
    assert len(rules) == len(docs) and not [r for r in rules if r.base_failed and r.kept] and any(r.kept for r in rules)


def test_shards_and_language(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = rows_of(spark, "op7_sharding")
    slots, counts = defaultdict(list), Counter(r.shard for r in got)
    for r in got:
        slots[r.shard].append(r.slot)
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts.get(k, 0) for k in range(40)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by = defaultdict(Counter)
    for r in got:
        by[docs[r.doc_id].source][r.shard] += 1
    for source, c in by.items():  # every shard has a source's share of the rows, give or take one
        assert all(abs(c[k] - sum(c.values()) / 40) <= 1 for k in range(40)), source
    spoken = rows_of(spark, "op8_language_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in spoken)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in spoken if r.held_out) > 0.95 * sum(r.held_out for r in spoken)


def test_columns_of_the_others(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op1_simhash", "op3_token_files", "op4_mixing", "op10_html_extract", "op5_bitsliced"):
        rows = rows_of(spark, name)
        assert len(rows) == n or name in ("op10_html_extract", "op5_bitsliced")


def test_a_repeated_labelled_id_is_one_row_of_the_fit(spark):
    docs = [(i, f"good text number {i} " * 5 if i % 2 else "spam ### spam " * 9, 9) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, often = (spark.createDataFrame(docs + more, "doc_id long, text string, n_chars long").repartition(4) for more in ([], docs[:40] * 20))
    a, b = quality_model.learn(once, labels), quality_model.learn(often, labels)
    assert (a.linear == b.linear).all() and (a.factors == b.factors).all() and a.bias == b.bias
