"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``.

Each query reads the input tables (or tables Spark derives from them) whole.
Column names match the DuckDB oracle in ``plans.oracle``.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions import text as T
from transloom.functions import tokens as TK
from transloom.operators import admission as adm
from transloom.operators import audit, feed, progress, reply, segment, turns
from transloom.operators import memory as tm
from transloom.operators.settings import model_catalog, normalize_settings
from transloom.operators.translate import round_trip, translate_requests, translate_segments
from transloom.plans.corpus import audit_rows, translate_corpus
from transloom.session import ensure_checkpoint_dir
from transloom.sources import fixtures as fx
from transloom.sources import requests as rq
from transloom.sources.tables import table
from transloom.streaming.polls import parse_polls

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
GUARD_BYTES = 8_192  # bytes that the reply report is asked for here, so that some replies exceed it


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- shared inputs -----------------------------------------------------------
def _docs(spark, d):
    return table(spark, d, "documents")


def _requests(spark, d):
    return fx.requests(_docs(spark, d))


def _settings(spark, d):
    return fx.settings(_docs(spark, d))


def _resolved(spark, d):
    return adm.resolve(_requests(spark, d), _settings(spark, d))


def _ready_local(spark, d):
    r = _resolved(spark, d)
    return r.where((F.col("status") == adm.READY) & (F.col("provider") == "local")) \
        .select("request_id", "tenant", "text", "source", "target", "model")  # the row key of these six


def _memory(spark, d):
    return fx.memory_seed(table(spark, d, "benchmark"), _docs(spark, d))


def _replies(spark, d):
    return fx.llm_replies(_docs(spark, d))


def _results(spark, d, audit=False):
    return translate_corpus(_requests(spark, d), _settings(spark, d), _memory(spark, d), _replies(spark, d), audit=audit)


# --- S: sources and sinks ----------------------------------------------------
@query
def requests_from_documents(spark, d):
    return _requests(spark, d)


@query
def request_lines(spark, d):
    return rq.parse_request_lines(fx.request_lines(_docs(spark, d)))


@query
def poll_lines(spark, d):
    polls = parse_polls(fx.poll_lines(table(spark, d, "events")))
    return polls.withColumn("ts_ms", F.unix_millis("ts")).drop("ts")


@query
def requests_from_conversations(spark, d):
    return rq.requests_from_conversations(table(spark, d, "conversations"))


@query
def response_rows(spark, d):
    return rq.response_rows(_results(spark, d))


@query
def log_records(spark, d):
    return progress.log_records(fx.log_blobs(table(spark, d, "events")))


# --- P: projections and checks ---------------------------------------------
@query
def trim_text(spark, d):
    return _requests(spark, d).select("request_id", T.go_trim("text").alias("trimmed"),
                                      T.char_count("text").alias("n_chars"))


@query
def admission(spark, d):
    return adm.admit(_requests(spark, d)).select("request_id", "tenant", "source", "target", "n_chars", "over_limit", "status")


@query
def direct_results(spark, d):
    return adm.direct_results(adm.admit(_requests(spark, d)))


@query
def settings_normalise(spark, d):
    return normalize_settings(_settings(spark, d))


@query
def fill_languages(spark, d):
    r = adm.fill_languages(adm.with_settings(adm.admit(_requests(spark, d)), _settings(spark, d)))
    return r.select("request_id", "tenant", "status", "source", "target")


@query
def routing(spark, d):
    return _resolved(spark, d).select("request_id", "provider", "model")


@query
def capability(spark, d):
    return _resolved(spark, d).select("request_id", "provider", "model", "source", "target", "status",
                                      adm.row_message().alias("message"))


@query
def language_lookup(spark, d):
    return adm.language_lookup(_resolved(spark, d))


@query
def model_catalog_query(spark, d):
    return model_catalog(_settings(spark, d))


@query
def result_meta(spark, d):
    results = _results(spark, d).where(F.col("status").isin("OK", adm.DIRECT))
    elapsed = fx.deltas(_docs(spark, d)).groupBy("request_id").agg(F.max("t_ms").alias("elapsed_ms"))
    return results.join(elapsed, "request_id", "left").select(
        "request_id", adm.provider_label("provider").alias("label"),
        adm.elapsed_label(F.coalesce("elapsed_ms", F.lit(0))).alias("elapsed"),
        F.col("model").alias("done_by"))


# --- F: scalar functions ---------------------------------------------------
@query
def shorten_tail(spark, d):
    return _docs(spark, d).select("doc_id", T.shorten("text", 180).alias("short"),
                                  T.tail("text", 120).alias("tail"))


@query
def safe_name(spark, d):
    s = normalize_settings(_settings(spark, d))
    return s.select("tenant", "local_model", T.safe_name("local_model").alias("safe"))


@query
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape("html").alias("escaped"))


@query
def endpoint(spark, d):
    return table(spark, d, "pages").select("page_id", T.endpoint("url").alias("endpoint"))


@query
def paragraphs(spark, d):
    return segment.paragraphs(_requests(spark, d), keep=()).select("request_id", "part_no", "part", "is_sep")


@query
def token_chunks(spark, d):
    return segment.token_chunks(segment.paragraphs(_requests(spark, d), keep=()))


@query
def token_budget(spark, d):
    return segment.token_budget(segment.token_chunks(segment.paragraphs(_requests(spark, d), keep=())))


def _word_ids(spark, d):
    """Chunks as id arrays: a word's id is its length in code points (1-2 act as special ids)."""
    chunks = segment.token_chunks(segment.paragraphs(_requests(spark, d), keep=()))
    return chunks.select("request_id", "part_no", "chunk_no",
                         F.transform(F.split("chunk", " "), lambda w: F.length(w)).alias("ids"))


@query
def strip_special(spark, d):
    ids = _word_ids(spark, d)
    out = TK.strip_special("ids", F.array(F.lit(1), F.lit(2)))
    return ids.select("request_id", "part_no", "chunk_no", F.size(out).alias("n_ids"),
                      F.array_join(out.cast("array<string>"), ",").alias("ids"))


@query
def repetition_collapse(spark, d):
    ids = TK.collapse_repetition_df(_word_ids(spark, d), "ids", F.lit(1), "out")
    return ids.select("request_id", "part_no", "chunk_no", F.size("ids").alias("n_in"),
                      F.size("out").alias("n_out"), F.array_join(F.col("out").cast("array<string>"), ",").alias("ids"))


@query
def error_message(spark, d):
    return reply.error_messages(_replies(spark, d)).select(
        "request_id", "http_status", T.error_text("error").alias("error"))


# --- J / U / B: memory, dedup, translation ----------------------------------
@query
def unique_segments(spark, d):
    return segment.unique_segments(segment.paragraphs(_ready_local(spark, d)))


@query
def tm_hits(spark, d):
    u = segment.unique_segments(segment.paragraphs(_ready_local(spark, d)))
    return tm.hits(u, _memory(spark, d)).select(*segment.SEGMENT_KEYS, "translation")


@query
def tm_misses(spark, d):
    u = segment.unique_segments(segment.paragraphs(_ready_local(spark, d)))
    return tm.misses(u, _memory(spark, d))


@query
def translate_pseudo(spark, d):
    u = segment.unique_segments(segment.paragraphs(_ready_local(spark, d)))
    return translate_segments(tm.misses(u, _memory(spark, d)))


@query
def reassembled(spark, d):
    return translate_requests(_ready_local(spark, d), _memory(spark, d))


@query
def round_trip_query(spark, d):
    return round_trip(_ready_local(spark, d), _settings(spark, d))


@query
def all_results(spark, d):
    return _results(spark, d)


# --- C: replies --------------------------------------------------------------
@query
def llm_payload(spark, d):
    r = _resolved(spark, d).where((F.col("status") == adm.READY) & (F.col("provider") == "llm"))
    p = reply.llm_payload(r)
    v = F.parse_json("payload")
    return p.select(
        "request_id", "endpoint",
        F.variant_get(v, "$.model", "string").alias("model"),
        F.variant_get(v, "$.messages[0].content", "string").alias("system_prompt"),
        F.variant_get(v, "$.messages[1].content", "string").alias("user_prompt"),
        F.variant_get(v, "$.temperature", "int").alias("temperature"),
        F.variant_get(v, "$.stream", "boolean").alias("stream"))


@query
def reply_correlation(spark, d):
    r = _resolved(spark, d).where((F.col("status") == adm.READY) & (F.col("provider") == "llm"))
    return reply.correlate(r, _replies(spark, d)).select("request_id", "model", "attempt", "http_status", "content_type")


@query
def completion_decode(spark, d):
    return reply.completion_decode(_replies(spark, d))


@query
def sse_events(spark, d):
    return reply.sse_events(_replies(spark, d))


@query
def sse_text(spark, d):
    return reply.sse_text(_replies(spark, d))


@query
def reply_dispatch(spark, d):
    return reply.decode_replies(_replies(spark, d))


@query
def reply_guard(spark, d):
    return reply.reply_guard(_replies(spark, d), GUARD_BYTES, GUARD_BYTES)


# --- progress log ------------------------------------------------------------
@query
def progress_parse(spark, d):
    return progress.parse(fx.progress_log(table(spark, d, "events")))


@query
def progress_changes(spark, d):
    return progress.changes(progress.parse(fx.progress_log(table(spark, d, "events"))))


@query
def latest_status(spark, d):
    return progress.latest_status(progress.download_status(fx.progress_log(table(spark, d, "events"))))


@query
def download_outcome(spark, d):
    return progress.download_outcome(fx.progress_log(table(spark, d, "events")))


# --- feeds -------------------------------------------------------------------
@query
def stable_input(spark, d):
    return feed.stable_input(fx.typed_input(table(spark, d, "events")))


@query
def change_feed_batch(spark, d):
    return feed.change_feed(fx.feed(table(spark, d, "events")))


@query
def latest_wins(spark, d):
    return feed.latest_wins(fx.feed(table(spark, d, "events")))


@query
def turn_starts(spark, d):
    return turns.turns(fx.turn_rows(table(spark, d, "events")))


@query
def delta_batches(spark, d):
    return feed.delta_batches(fx.deltas(_docs(spark, d)))


@query
def paired_events(spark, d):
    return feed.paired_events(fx.taps(table(spark, d, "events")))


# --- audit -------------------------------------------------------------------
@query
def audit_summary(spark, d):
    return audit.summary(audit_rows(_results(spark, d, audit=True)))


@query
def length_profile(spark, d):
    return audit.length_profile(_docs(spark, d))


@query
def audit_log_parse(spark, d):
    """The run's log and the download's, written as the program writes them, read back."""
    lines = audit.log_lines(audit_rows(_results(spark, d, audit=True))).select("line", (F.col("n_chars") * 1000 + F.col("n")).alias("us"))
    downloads = fx.download_lines(table(spark, d, "events"))
    path = f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    audit.log_text(lines.unionByName(downloads), F.timestamp_micros(F.lit(K.EPOCH_2026_US) + F.col("us"))).write.text(path)
    found = audit.parse_records(audit.log_records(audit.read_log(spark, path)))
    return found.select("at_us", "event", "provider", "source", "target", "characters", "model", "progress", "error", "message", "output")


# Registered names that differ from the function name (avoid shadowing imports).
ALIASES = {"model_catalog_query": "model_catalog", "round_trip_query": "round_trip"}


def _widen(df: DataFrame) -> DataFrame:
    """Integral result columns are reported as bigint (the oracle's integer type)."""
    narrow = {"int", "smallint", "tinyint"}
    return df.select(*[F.col(n).cast("bigint").alias(n) if t in narrow else F.col(n) for n, t in df.dtypes])


def _wrapped(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _widen(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    return {ALIASES.get(k, k): _wrapped(v) for k, v in REGISTRY.items()}
