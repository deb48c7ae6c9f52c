"""Model-download progress logs.

Records are cleaned and parsed by built-in regex functions in the scan's
stage. Dropping consecutive repeats (W1) is a keyed lag that stays parallel
on a hot log; the per-model and per-log summaries are ``max_by`` aggregates,
which combine partially before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.text import go_trim, shorten, strip_ansi, tail
from transloom.operators.ordering import DEFAULT_BLOCK, keyed_lag


def log_records(blobs: DataFrame) -> DataFrame:
    """Split a log blob on CR, LF or CRLF; the last record needs no terminator."""
    parts = F.split("blob", "\r\n|\r|\n", -1)
    records = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return blobs.select("log_id", F.posexplode(records).alias("n", "record")) \
        .select("log_id", F.col("n").cast("bigint").alias("n"), "record")


def _parse_columns(clean):
    named_hit = clean.rlike(K.PROGRESS_NAMED)
    named_p = F.regexp_extract(clean, K.PROGRESS_NAMED, 2).try_cast("int")
    name = shorten(go_trim(F.regexp_extract(clean, K.PROGRESS_NAMED, 1)), K.PROGRESS_NAME_CHARS)
    bare_hit = clean.rlike(K.PROGRESS_BARE)
    bare_p = F.regexp_extract(clean, K.PROGRESS_BARE, 1).try_cast("int")
    named_ok = named_hit & named_p.between(0, 100)
    bare_ok = ~named_hit & bare_hit & bare_p.between(0, 100)
    percent = F.when(named_ok, named_p).when(bare_ok, bare_p).otherwise(F.lit(-1))
    message = (F.when(named_ok, F.concat(F.lit(K.PROGRESS_NAMED_HEAD), name, F.lit(K.PROGRESS_FILE_MID),
                                         named_p.cast("string"), F.lit("%")))
               .when(bare_ok, F.concat(F.lit(K.PROGRESS_BARE_HEAD + K.PROGRESS_FILE_MID), bare_p.cast("string"),
                                       F.lit("%")))
               .otherwise(shorten(clean, K.PROGRESS_MESSAGE_CHARS)))
    return percent, message


def parse(log: DataFrame) -> DataFrame:
    """Strip ANSI codes and blanks, skip blank records, parse percent and message. ``record``
    keeps the whole cleaned line, which ``message`` may shorten."""
    clean = strip_ansi("line")
    df = log.select(*[c for c in log.columns if c != "line"], clean.alias("record")).where(F.col("record") != "")
    percent, message = _parse_columns(F.col("record"))
    return df.select(*df.columns, percent.cast("int").alias("percent"),
                     message.alias("message"))


def changes(parsed: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Drop a record whose ``percent:message`` equals the previous non-blank record's."""
    keyed = parsed.withColumn("_key", F.concat(F.col("percent").cast("string"), F.lit(":"), F.col("message")))
    lagged = keyed_lag(keyed, ["log_id"], "n", ["_key"], block)
    kept = lagged.where(F.col("prev__key").isNull() | (F.col("prev__key") != F.col("_key")))
    return kept.drop("_key", "prev__key")


def download_status(log: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Status rows a download emits: one 'downloading' row per changed record."""
    rows = changes(parse(log), block)
    return rows.select("model", "log_id", "n", F.lit("downloading").alias("status"), "message",
                       F.col("percent").alias("progress"))


def latest_status(status: DataFrame) -> DataFrame:
    """Last write wins per model; only 0..100 counts as a known percentage."""
    last = status.groupBy("model").agg(
        F.max_by(F.struct("log_id", "n", "status", "message", "progress"), F.col("n")).alias("s"))
    return last.select("model", F.col("s.log_id").alias("log_id"), F.col("s.n").alias("updated_n"),
                       F.col("s.status").alias("status"), F.col("s.message").alias("message"),
                       F.col("s.progress").alias("progress"),
                       F.col("s.progress").between(0, 100).alias("has_percent"))


def log_tail(log: DataFrame, chars: int, block: int = 1 << 12) -> DataFrame:
    """``(log_id, tail_text)``: the last ``2 * chars`` characters of each log's lines, joined by LF.

    The lengths decide first what can contribute: of each log the blocks of lines that the characters after them don't
    fill, of those the lines. So no more than that is gathered in one row, however long a line or a log is."""
    enough, at_end = 2 * chars, Window.partitionBy("log_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = log.select("log_id", F.col("n"), F.floor(F.col("n") / block).alias("_blk"), F.right(F.col("line"), F.lit(enough)).alias("line"))
    size = F.length("line") + 1
    sizes = log.groupBy("log_id", F.floor(F.col("n") / block).alias("_blk")).agg(
        F.sum(F.least(F.length("line"), F.lit(enough)) + 1).alias("_size"))
    after = F.coalesce(F.sum("_size").over(at_end.orderBy(F.col("_blk").desc())), F.lit(0))
    wanted = sizes.select("log_id", "_blk", after.alias("_after")).where(F.col("_after") <= enough)
    within = Window.partitionBy("log_id", "_blk").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lines = cut.join(wanted, ["log_id", "_blk"]).withColumn("_after", F.col("_after") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    rows = F.array_sort(F.collect_list(F.struct("n", "line")))
    return lines.where(F.col("_after") <= enough).groupBy("log_id").agg(
        F.right(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit(enough)).alias("tail_text"))


def download_outcome(log: DataFrame, chars: int = 1200) -> DataFrame:
    """Per download, 'ready' at 100 unless the last record is an error or warning line,
    in which case 'error' keeps the progress the status last showed, and the message ends with
    the end of the whole log."""
    parsed = parse(log)
    last = parsed.groupBy("log_id", "model").agg(
        F.max_by(F.struct("percent", "message"), F.col("n")).alias("last"),
        F.count(F.lit(1)).alias("n_records"))
    failed = (F.col("last.percent") == -1) & F.col("last.message").rlike("(?i)error|warning")
    last = last.join(log_tail(log, chars), "log_id")
    return last.select(
        "log_id", "model",
        F.when(failed, F.lit("error")).otherwise(F.lit("ready")).alias("status"),
        F.when(failed, F.concat(F.lit(K.MSG_DOWNLOAD_FAILED), tail(F.col("tail_text"), chars)))
        .otherwise(F.lit(K.DOWNLOAD_READY)).alias("message"),
        F.when(failed, F.col("last.percent")).otherwise(F.lit(100)).alias("progress"),
        F.col("n_records").cast("bigint").alias("n_records"))
