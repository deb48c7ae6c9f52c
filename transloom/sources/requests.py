"""Request sources and result sinks.

A request is ``(request_id, tenant, text, source, target)``. Requests come
from JSON lines (the worker protocol) or from a corpus table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.json import allow_repeated_keys, boxed, kind, string_or_absent, unboxed
from transloom.functions.text import go_trim

RESPONSE_COLUMNS = ("id", "text", "error")


def parse_request_lines(lines: DataFrame) -> DataFrame:
    """``value`` lines to requests; a missing text is '', a missing source 'en', a missing target 'zh'.

    A line that is no JSON object, or whose fields have the wrong type, keeps its reason in
    ``error`` (NULL for a good line) so that it gets a response row and not a blank request.
    Works on batch and streaming input; blank lines are skipped.
    """
    allow_repeated_keys(lines.sparkSession)
    d = lines.where(go_trim("value") != "").withColumn("_v", boxed("value")).withColumn("_v", unboxed(F.col("_v")))
    v = F.col("_v")
    typed = kind(v).startswith("OBJECT")
    for name in ("text", "source", "target"):
        typed = typed & string_or_absent(v, f"$.{name}")
    field = lambda name, default: F.coalesce(F.when(typed, F.try_variant_get(v, f"$.{name}", "string")), F.lit(default))
    return d.select(
        F.coalesce(F.try_variant_get(v, "$.id", "string"), F.lit("")).alias("request_id"),
        F.lit("").alias("tenant"),
        field("text", "").alias("text"),
        field("source", K.DEFAULT_SOURCE).alias("source"),
        field("target", K.DEFAULT_TARGET).alias("target"),
        F.when(~F.coalesce(typed, F.lit(False)), F.lit(K.MSG_BAD_REQUEST)).alias("error"),
    )


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON-lines files, bad lines with their ``error``."""
    return parse_request_lines(spark.read.text(path))


def stream_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 as a stream: the same rows from files as they land in a folder."""
    return parse_request_lines(spark.readStream.text(path))


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A landing folder of Parquet files (a change feed, deltas, taps) as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def refused_lines(requests: DataFrame) -> DataFrame:
    """Response rows of the lines that ``parse_request_lines`` refused."""
    return requests.where(F.col("error").isNotNull()).select(F.col("request_id").alias("id"), F.lit("").alias("text"), "error")


def requests_from_documents(documents: DataFrame, keep: tuple = ()) -> DataFrame:
    """Corpus adapter: one request per document, the document language as source.

    The target alternates by id parity between Chinese and English, so English
    documents with odd ids become same-language pass-through requests.
    """
    return documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"),
        F.col("source").alias("tenant"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("lang", F.lit("")).alias("source"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("zh")).otherwise(F.lit("en")).alias("target"),
        *keep,
    )


def requests_from_conversations(conversations: DataFrame) -> DataFrame:
    """Corpus adapter: one request per turn, id ``c<conv>-<turn>``, English to Chinese."""
    return conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("request_id"),
        F.col("role").alias("tenant"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(K.DEFAULT_SOURCE).alias("source"),
        F.lit(K.DEFAULT_TARGET).alias("target"),
    )


def response_rows(results: DataFrame) -> DataFrame:
    """Worker response rows ``{id, text, error}``; failed rows keep their error."""
    return results.select(
        F.col("request_id").alias("id"),
        F.when(F.col("error") == "", F.col("text")).otherwise(F.lit("")).alias("text"),
        F.col("error"),
    )


def write_response_lines(responses: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S2 sink: JSON lines, non-ASCII written literally (Spark's JSON writer does)."""
    responses.select(*RESPONSE_COLUMNS).write.mode(mode).json(path)


def read_settings_files(spark: SparkSession, path: str) -> DataFrame:
    """S3: one settings JSON document per file; the file name (without extension) is the tenant.
    The raw text is kept; ``operators.settings.normalize_settings`` parses it."""
    raw = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    return raw.select(name.alias("tenant"), F.col("value").alias("raw"))
