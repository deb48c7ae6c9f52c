"""The flagship plan: a table of requests in, one result row per request out.

    requests -> admission (P1) -> settings (J3) -> defaults (P3) -> routing and
    checks (P4/P5) -> one branch for each kind, all of one schema
      rejected  status and message        narrow: no shuffle
      direct    trimmed text (P2)         narrow: no shuffle
      llm       landed replies correlated by id (J5), decoded (C7); the requests' text stays behind
      local     paragraphs -> unique segments -> memory -> model -> fan-out -> reassembly

A branch filters the same narrow admission stage and reads only the columns that it needs, so the
text of a request is shuffled where it is translated and nowhere else. The local requests are read twice:
once for the unique segments (the partial aggregation comes before the shuffle, so a segment
that fills a third of the corpus costs one row per task), once for the parts that are joined
back (where AQE splits such a segment). Sharing one exchange for both would read once but put
every copy of a hot segment into one partition. Replies, settings and memory are read once each.

Requests are told apart by their row key (``operators.segment``), never by their id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.text import go_trim
from transloom.operators import admission as adm
from transloom.operators import reply
from transloom.operators.memory import MemoryTable
from transloom.operators.segment import ROW_KEY, repeated, with_row_key
from transloom.operators.translate import translated_rows

RESULT_COLUMNS = ["request_id", "provider", "model", "status", "text", "error"]
AUDIT_COLUMNS = ["raw_source", "raw_target", "n_chars"]


def translate_corpus(requests: DataFrame, settings_raw: DataFrame, memory: DataFrame | MemoryTable | None = None,
                     replies: DataFrame | None = None, kind: str = "pseudo", options: dict | None = None,
                     max_chars: int | None = None, audit: bool = False,
                     run: str | None = None) -> DataFrame:
    """One result row for every request row. ``audit`` adds the columns that the run audit needs; a column ``error`` of the
    requests marks lines that their source refused."""
    resolved = adm.resolve(with_row_key(requests), settings_raw, max_chars)
    columns = [*RESULT_COLUMNS, *AUDIT_COLUMNS] if audit else RESULT_COLUMNS
    extra = AUDIT_COLUMNS if audit else []
    status, provider = F.col("status"), F.col("provider")
    ready, direct = status == adm.READY, status == adm.DIRECT

    settled = resolved.where(~ready).select(
        "request_id", F.when(direct, F.lit(K.DIRECT_PROVIDER)).otherwise(provider).alias("provider"),
        F.when(direct, F.lit(K.DIRECT_MODEL)).otherwise(F.col("model")).alias("model"), "status",
        F.when(direct, go_trim("text")).otherwise(F.lit("")).alias("text"), adm.row_message().alias("error"), *extra)

    local = resolved.where(ready & (provider == "local")).select(
        "request_id", *ROW_KEY, "text", "source", "target", "model", *extra)
    local = repeated(translated_rows(local, memory, kind, options, tuple(extra), run)).select(
        "request_id", F.lit("local").alias("provider"), "model",
        F.when(F.col("error") == "", F.lit("OK")).otherwise(F.lit("FAILED")).alias("status"), "text", "error", *extra)

    llm = resolved.where(ready & (provider == "llm")).select("request_id", "provider", "model", *extra)
    if replies is None:
        llm = llm.select("request_id", "provider", "model", F.lit("AWAITING_REPLY").alias("status"), F.lit("").alias("text"),
                         F.lit("").alias("error"), *extra)
    else:
        decoded = reply.decode_replies(replies).select(
            "request_id", F.col("status").alias("r_status"), F.col("text").alias("r_text"), F.col("error").alias("r_error"))
        got = F.col("r_status").isNotNull()
        llm = llm.join(decoded, "request_id", "left").select(
            "request_id", "provider", "model", F.coalesce("r_status", F.lit("NO_REPLY")).alias("status"),
            F.coalesce("r_text", F.lit("")).alias("text"),
            F.when(got, F.col("r_error")).otherwise(F.lit(K.MSG_NO_TRANSLATION)).alias("error"), *extra)
    return settled.unionByName(local).unionByName(llm).select(*columns)


def audit_rows(results: DataFrame) -> DataFrame:
    """A1: one audit row per request (from ``translate_corpus(..., audit=True)``): provider, pair as
    asked for, characters, model, outcome."""
    return results.select("request_id", "provider", "model", F.col("raw_source").alias("source"),
                          F.col("raw_target").alias("target"), "n_chars", "status", "error")
