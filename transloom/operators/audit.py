"""Run audit and analytics.

Summaries are plain ``groupBy`` aggregates with partial aggregation before the
shuffle; the median is a merged sketch (``percentile_approx``), so no group is buffered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.text import char_count


def summary(audit_rows: DataFrame) -> DataFrame:
    """A1: requests and characters per provider, model and outcome."""
    return audit_rows.groupBy("provider", "model", "status").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_requests"),
        F.sum("n_chars").cast("bigint").alias("n_chars"))


def length_profile(documents: DataFrame) -> DataFrame:
    """A2: per language, documents, how many exceed the limit, longest and total length."""
    n = char_count("text")
    return documents.groupBy("lang").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs"),
        F.sum(F.when(n > K.MAX_CHARS, 1).otherwise(0)).cast("bigint").alias("n_over_limit"),
        F.max(n).cast("bigint").alias("max_chars"),
        F.sum(n).cast("bigint").alias("total_chars"),
        F.percentile_approx(n, 0.5, 1_000_000).cast("bigint").alias("median_chars"))


NOT_STARTED = ("REFUSED", "EMPTY", "TOO_LONG", "DIRECT", "SETTINGS_ERROR")


def log_lines(audit_rows: DataFrame) -> DataFrame:
    """The log lines a run writes: a start line, with the pair as asked for, for every request past
    the same-language check; then a completion line, or a failure line with the message.
    An unsupported pair is refused between the two and gets no second line."""
    started_rows = audit_rows.where(~F.col("status").isin(*NOT_STARTED))
    label = F.when(F.col("provider") == "llm", F.lit("LLM")).otherwise(F.lit("local"))
    started = F.concat(F.lit("translation started; provider="), F.col("provider"), F.lit(" source="),
                       F.col("source"), F.lit(" target="), F.col("target"), F.lit(" characters="),
                       F.col("n_chars").cast("string"))
    done = F.when(F.col("status") == "OK", F.concat(label, F.lit(" translation completed; model="), F.col("model"))) \
        .otherwise(F.concat(label, F.lit(" translation failed; model="), F.col("model"), F.lit(" error="),
                            F.col("error")))
    second = F.when(~F.col("status").isin("PAIR_UNSUPPORTED", "AWAITING_REPLY"),
                    F.struct(F.lit(1).alias("n"), done.alias("line")))
    return started_rows.select("request_id", "n_chars", F.inline(F.array_compact(F.array(
        F.struct(F.lit(0).alias("n"), started.alias("line")), second))))


# ---------------------------------------------------------------------------
# the program's log
# ---------------------------------------------------------------------------
def log_text(lines: DataFrame, at) -> DataFrame:
    """The lines as the program's log holds them: date, time with microseconds, then the message (which may have line ends)."""
    return lines.select(F.concat(F.date_format(at, K.LOG_TIME), F.lit(" "), F.col("line")).alias("value"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``(log, part, at, line)``: physical lines of log files. Only LF ends a line. A large file is read in parts; ``part`` is
    where a part begins in its file, ``at`` the order of lines in it."""
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("part"),
                      F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def log_records(lines: DataFrame) -> DataFrame:
    """``(log, record)``: a line with the time in front begins a record, others continue it. Lines before the first such
    line of a log are a record without a time.

    Each part of a file finds its records by itself and hands on the last one that it opened, one row a part; so one
    file of any size takes as many tasks as it has parts."""
    start = F.when(F.col("line").rlike(K.LOG_PREFIX), F.struct("part", "at"))
    rows = Window.partitionBy("log", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.partitionBy("log").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = lines.groupBy("log", "part").agg(F.max(start).alias("_open")).select(
        "log", "part", F.last("_open", ignorenulls=True).over(parts).alias("_open"))
    named = lines.join(opened, ["log", "part"]).withColumn("_of", F.coalesce(F.last(start, ignorenulls=True).over(rows), "_open"))
    in_order = F.array_sort(F.collect_list(F.struct("part", "at", "line")))
    return named.groupBy("log", "_of").agg(in_order.alias("_l")).select(
        "log", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """``at_us`` (microseconds, NULL without a time), ``event``, and its fields.

    The event ends at the first ';' or ':' of its first line. Fields are ``key=value``; a value goes up to the next key that the
    program writes, so it may have blanks. ``error``, ``message`` and ``output`` come last and take the rest, line ends
    included; text after ':' is the ``error`` of an event that failed, the ``output`` of any other."""
    at = F.regexp_extract("record", K.LOG_PREFIX, 1)
    body = F.when(at != "", F.substr("record", F.length(at) + 2)).otherwise(F.col("record"))
    split = records.select("*", at.alias("_at"), body.alias("_body")).select(
        "*", F.regexp_extract("_body", r"(?s)^([^;:\n]*)(?:; |: ?|\z|\n)", 1).alias("event"))
    after = F.substr("_body", F.length("event") + 1)
    free = rf"(?s)\A(.*?)\s({'|'.join(K.LOG_FREE_KEYS)})=(.*)\z"
    split = split.withColumn("_rest", F.when(after.startswith(";"), F.concat(F.lit(" "), F.substr(after, F.lit(2)))).otherwise(F.lit("")))
    split = split.withColumn("_free", F.regexp_extract("_rest", free, 2))
    split = split.withColumns({
        "_head": F.when(F.col("_free") != "", F.regexp_extract("_rest", free, 1)).otherwise(F.col("_rest")),
        "_text": F.when(F.col("_free") != "", F.regexp_extract("_rest", free, 3))
                  .when(after.startswith(":"), F.regexp_replace(F.substr(after, F.lit(2)), r"\A[ \n]", "")).otherwise(F.lit(""))})
    failed = F.col("_free").isin("", "error") & ((F.col("_free") == "error") | F.col("event").endswith("failed"))
    keys = {k: F.regexp_extract("_head", rf"(?s)\s{k}=(.*?)(?=\s+(?:{'|'.join(K.LOG_KEYS)})=|\s*\z)", 1) for k in K.LOG_KEYS}
    text = lambda key, cond: F.when(cond, F.col("_text")).otherwise(F.lit("")).alias(key)
    numbers = ("characters", "progress")
    columns = [(v.try_cast("bigint") if k in numbers else v).alias(k) for k, v in keys.items()]
    return split.select(
        F.unix_micros(F.try_to_timestamp("_at", F.lit(K.LOG_TIME))).alias("at_us"), "event", *columns, text("error", failed),
        text("message", F.col("_free") == "message"), text("output", ~failed & (F.col("_free") != "message")))


#: Outcomes that a run counts while it is written; any other one counts as ``OTHER``.
OUTCOMES = ("OK", "FAILED", "DIRECT", "AWAITING_REPLY", "NO_REPLY", "NO_STATUS", "HTTP_ERROR", "STREAM_ERROR", "PARSE_ERROR", "NO_TRANSLATION",
            "REFUSED", "EMPTY", "TOO_LONG", "LLM_NO_URL", "LLM_NO_MODEL", "SETTINGS_ERROR", "PAIR_UNSUPPORTED", "MODEL_NOT_READY",
            "LANG_UNMAPPED")


def run_counts() -> list[F.Column]:
    """Aggregates for ``observe``: requests, characters, and requests per outcome."""
    status = F.col("status")
    return [F.count(F.lit(1)).alias("n_requests"), F.sum("n_chars").alias("n_chars"),
            *[F.count_if(status == s).alias(s) for s in OUTCOMES],
            F.count_if(~F.coalesce(status.isin(*OUTCOMES), F.lit(False))).alias("OTHER")]


def append_audit(audit_rows: DataFrame, path: str, run_id: str) -> dict[str, int]:
    """Durable audit table, one partition per run. Re-running a run id replaces only that run's partition (dynamic
    overwrite), so a retried job does not duplicate rows. The run's counts (``run_counts``) are observed while the rows are
    written and returned."""
    seen = Observation()
    (audit_rows.observe(seen, *run_counts()).withColumn("run_id", F.lit(run_id)).write
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").parquet(path))
    return {name: count or 0 for name, count in seen.get.items()}
