"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import math
import string
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.session import ensure_checkpoint_dir, ship_package

#: Java class of the ASCII white space that separates words: space, tab, LF, VT, FF, CR.
WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def words(col: Column) -> Column:
    """Words of a text (maximal runs outside ASCII white space); none for null or blank text."""
    inner = F.btrim(F.coalesce(col, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE + "+", -1))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of UTF-8 text in the whole table; one narrow aggregate."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0)


def pieces(total: int, per_piece: int, least: int = 1) -> int:
    """Number of pieces of about ``per_piece``; grows in proportion to the input."""
    return max(least, math.ceil(total / per_piece))


def width(spark: SparkSession, wanted: int) -> int:
    """Shuffle width: what the size asks for, never under the session's own setting."""
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small slices, so that a task turns few rows into Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def once_each(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``rows`` with each repeated row (equal in ``keys``, which decide all other columns) once, ``copies`` telling how often it
    was there. Only keys are counted, and only rows that are repeated are grouped, after a partial aggregate where they
    are read; rows of their own stay where they are."""
    cond = lambda left, right: functools.reduce(
        lambda a, k: a & left[k].eqNullSafe(right[f"__{k}"]), keys, F.lit(True))
    again = cut(rows.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"__{k}") for k in keys]), label)
    rest = [F.any_value(c).alias(c) for c in rows.columns if c not in keys]
    repeated = rows.join(again, cond(rows, again), "left_semi").groupBy(*keys).agg(*rest, F.count("*").alias("copies"))
    own = rows.join(again, cond(rows, again), "left_anti").withColumn("copies", F.lit(1).cast("bigint"))
    return own.unionByName(repeated.select(*own.columns))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor re-reads the table instead of recomputing what made it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
