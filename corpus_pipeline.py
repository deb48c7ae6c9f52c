"""Corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's documents. All but the last return the columns of ``documents``.

Edge cases, in every stage: null and empty texts are rejected by the first stage, and the later ones pass or treat
them as their operators state; repeated rows are one document to the near-duplicate stage, of which one row stays;
empty tables give empty results; columns beyond those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.llm import decontaminate, line_dedup, packing, quality, simhash
from transloom.llm.common import read_table
from transloom.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _like_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; failing lines of the others go."""
    return _like_documents(quality.clean_documents(docs.select(*COLUMNS)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in the document with the largest id only."""
    return _like_documents(line_dedup.drop_lines(docs.select(*COLUMNS)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens: a row per piece."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_dedup_stage), ("near dedup", near_dedup_stage),
          ("decontamination", decontaminate_stage), ("packing", packing_stage)]

#: Fingerprints, tokens and the genetic packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared checkpoint folder and reread."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
