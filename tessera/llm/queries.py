"""The registered queries of the operators on training data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitsliced, byte_bpe, clustering, html_extract, language_id, line_dedup, mixing, quality_model, quality_rules, repetition, sharding, simhash, token_files
from tessera.llm.common import shared_dir, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality_model.score(docs, quality_model.learn(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= quality_model.GOOD).cast("int").alias("predicted"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tessera/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.digest(token_files.read(spark, path))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row_key", "source")


def op5_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.self_search(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.measure(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language_id.identify(docs, language_id.profiles(docs.where(~language_id.held_out())))
    return rows.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.model())


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digest(docs, line_dedup.keep_bitmaps(docs))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.periodic_runs(table(spark, sf_dir, "documents"), change=True)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


NUMBERED = (
    op1_simhash, op2_quality_model, op3_token_files, op4_mixing, op5_bitsliced, op6_quality_rules, op7_sharding, op8_language_id, op9_byte_bpe, op10_html_extract,
    op11_line_dedup, op12_periodic_runs, op13_clustering,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NUMBERED}


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": line_dedup.SQL, "op13_clustering": clustering.sql()}
