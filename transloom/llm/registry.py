"""Registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.llm import (decontaminate, language_id, line_dedup, lm_scoring, merkle, packing, pair_bpe, periodic_runs, pii,
                           quality, sharding, simhash, url_filters)
from transloom.llm.common import crc_mod, read_table
from transloom.llm.oracle import oracle_sql as oracle_sql

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that the url query is asked to judge by: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod(F.col("doc_id"), 7)
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"), held_out=fold == 2, deleted=fold == 6)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    content = language_id.learn(docs.where(~held_out & F.col("lang").isNotNull()))
    return language_id.predict(docs, content, extra={"held_out": held_out})


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(read_table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(read_table(spark, sf_dir, "documents"), tail=periodic_runs.planted_tail)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are shown without line ends where 2 divides the crc32 of the id."""
    return merkle.manifest(read_table(spark, sf_dir, "documents"), shown=lambda text: F.when(
        crc_mod(F.col("doc_id"), 2) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return pair_bpe.encode_report(read_table(spark, sf_dir, "documents"), f.read())


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_pii, op3_packing, op4_decontamination, op5_language_id, op6_url_filters, op7_line_dedup, op8_quality_rules,
                                   op9_simhash, op10_sharding, op11_periodic_runs, op12_merkle_manifest, op13_bpe)}
