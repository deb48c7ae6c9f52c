"""The translate stage (B3-B7): unique segments -> memory -> model -> fan-out -> reassembly.

The model call is the only Python: ``mapInPandas`` streams Arrow batches of
unique segments through a backend opened once per Python worker. A failing
row becomes an ``error`` value; the worker and the other rows carry on.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.operators import memory as tm
from transloom.operators.admission import READY, resolve, row_message
from transloom.session import materialize, ship_package, stored
from transloom.operators.segment import (ROW_KEY, SEGMENT_KEYS, fan_out, paragraphs, reassemble, repeated, unique_segments,
                                         with_row_key)

TRANSLATED_SCHEMA = "source string, target string, model string, segment string, translation string, error string"


def _translate_batches(kind: str, options: dict | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from transloom.operators.backends import open_backend
        for pdf in batches:
            if pdf.empty:
                continue
            pdf = pdf.reset_index(drop=True)
            translation, error = pdf["translation"].tolist(), [""] * len(pdf)
            todo = pdf[pdf["translation"].isna()]
            for (model, source, target), idx in todo.groupby(["model", "source", "target"], sort=False, dropna=False).groups.items():
                texts = todo["segment"].loc[idx].tolist()
                try:
                    out = open_backend(kind, model, options).translate(texts, source, target)
                    if len(out) != len(texts):
                        raise RuntimeError(f"{len(out)} translations came back for {len(texts)} segments")
                except Exception as exc:  # backend failed to open or crashed on the batch
                    out = [exc] * len(texts)
                for i, value in zip(idx, out):
                    if isinstance(value, BaseException):
                        translation[i], error[i] = "", str(value) or type(value).__name__
                    else:
                        translation[i] = value
            yield pdf.assign(translation=translation, error=error)
    return run


def translate_segments(unique: DataFrame, kind: str = "pseudo", options: dict | None = None) -> DataFrame:
    """Model call per Arrow batch; rows that have a ``translation`` already pass through.
    Sorting inside each partition by pair and length keeps one pair per backend call and
    similar lengths together (less padding)."""
    ship_package(unique.sparkSession)
    if "translation" not in unique.columns:
        unique = unique.withColumn("translation", F.lit(None).cast("string"))
    ordered = unique.sortWithinPartitions("model", "source", "target", F.length("segment"))
    return ordered.select(*SEGMENT_KEYS, "translation").mapInPandas(_translate_batches(kind, options), TRANSLATED_SCHEMA)


def translate_parts(parts: DataFrame, memory: DataFrame | tm.MemoryTable | None = None, kind: str = "pseudo",
                    options: dict | None = None, carry: tuple = (), run: str | None = None) -> DataFrame:
    """B3 + B4 + J6: translated parts ``(request_id, row key, part_no, out, error)``.

    One left join gives the unique segments their memory entry, one Python pass translates
    the others. With a ``MemoryTable`` only the buckets that may hold one of the segments are read, and the fresh
    translations are stored in it under ``run`` before they are joined back: the paid call is materialised first.
    """
    unique = unique_segments(parts)
    if not isinstance(memory, tm.MemoryTable):
        known = tm.recall(unique, memory) if memory is not None else unique
        return fan_out(parts, translate_segments(known, kind, options), carry)
    known = materialize(memory.recall(stored(unique, "unique"), but=run))
    # Call the model once: the checkpoint in the shared folder is what later stages (and retries) read
    translated = materialize(translate_segments(known, kind, options))
    fresh = translated.join(known.where(F.col("translation").isNull()).select(*SEGMENT_KEYS), SEGMENT_KEYS, "left_semi")
    memory.remember(fresh, run)
    return fan_out(parts, translated, carry)


def translated_rows(ready_local: DataFrame, memory: DataFrame | tm.MemoryTable | None = None, kind: str = "pseudo",
                    options: dict | None = None, carry: tuple = (), run: str | None = None) -> DataFrame:
    """B1-B6, one row per row key: ``(request_id, model, carry, row key, copies, text, error)``."""
    parts = paragraphs(ready_local, keep=("source", "target", "model", *carry))
    return reassemble(translate_parts(parts, memory, kind, options, carry, run), carry)


def translate_requests(ready_local: DataFrame, memory: DataFrame | tm.MemoryTable | None = None, kind: str = "pseudo",
                       options: dict | None = None) -> DataFrame:
    """B1-B6 for requests routed to the local model: ``(request_id, model, text, error)``, a row for each request."""
    return repeated(translated_rows(ready_local, memory, kind, options))


def round_trip(ready_local: DataFrame, settings_raw: DataFrame, kind: str = "pseudo",
               options: dict | None = None) -> DataFrame:
    """Translate, swap the pair, translate the result back; ``(request_id, original, forward, back, error)``.
    The way back is a request like any other: it passes admission, routing and the capability checks. Both legs meet by
    the row key of the first one, so requests that share an id stay apart."""
    asked = with_row_key(ready_local)
    forward = translated_rows(asked, kind=kind, options=options).select(
        *ROW_KEY, "copies", F.col("text").alias("forward"), F.col("error").alias("fwd_error"))
    fwd = asked.select(*ROW_KEY, "request_id", "tenant", "source", "target", F.col("text").alias("original")) \
        .dropDuplicates(ROW_KEY).join(forward, ROW_KEY)
    fwd = stored(fwd, "forward")  # read by both legs below; the model is not asked twice
    swapped = fwd.where(F.col("fwd_error") == "").select(
        F.col("_h1").alias("of1"), F.col("_h2").alias("of2"), "request_id", "tenant", F.col("forward").alias("text"),
        F.col("target").alias("source"), F.col("source").alias("target"))
    resolved = resolve(with_row_key(swapped), settings_raw)
    goes = (F.col("status") == READY) & (F.col("provider") == "local")
    back = translated_rows(resolved.where(goes), kind=kind, options=options, carry=("of1", "of2")).select(
        "of1", "of2", F.col("text").alias("back"), F.col("error").alias("back_error"))
    refused = resolved.where(~goes).select("of1", "of2", F.lit("").alias("back"), row_message().alias("back_error"))
    legs = back.unionByName(refused).withColumnsRenamed({"of1": "_h1", "of2": "_h2"})
    return repeated(fwd.join(legs, ROW_KEY, "left").select(
        "request_id", "copies", "original", "forward", F.coalesce("back", F.lit("")).alias("back"),
        F.when(F.col("fwd_error") != "", F.col("fwd_error")).otherwise(F.coalesce("back_error", F.lit("")))
        .alias("error")))
