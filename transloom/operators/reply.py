"""Chat-completion requests and replies.

A landed reply is one row ``(request_id, http_status, content_type, body)``, with an optional
``attempt``. All replies go through one pass: an event stream is exploded into one row per
event, any other reply is one row (a narrow step); each row is parsed and type-checked with
codegen'd VARIANT reads, and only kinds and texts are shuffled to the per-request fold. The
events of one request are gathered in one row, as its body was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.json import absent, allow_repeated_keys, boxed, kind, object_or_absent, plain_keys, string, string_or_absent, unboxed
from transloom.functions.text import byte_cut, endpoint, go_trim
from transloom.sources import dims

OK, PARSE_ERROR, NO_TRANSLATION, STREAM_ERROR, HTTP_ERROR, NO_STATUS, REPLY_TOO_LARGE = (
    "OK", "PARSE_ERROR", "NO_TRANSLATION", "STREAM_ERROR", "HTTP_ERROR", "NO_STATUS", "REPLY_TOO_LARGE")


#: Names that replies are read by, in any case.
REPLY_KEYS = ("choices", "message", "content", "delta", "error")


# ---------------------------------------------------------------------------
# Request rows
# ---------------------------------------------------------------------------
def user_prompt(source_name, target_name, text) -> Column:
    return F.concat(F.lit(K.USER_PROMPT_HEAD), source_name, F.lit(K.USER_PROMPT_MID), target_name,
                    F.lit(K.USER_PROMPT_TAIL), text)


def llm_payload(resolved_llm: DataFrame) -> DataFrame:
    """Endpoint and JSON payload; the untrimmed text is sent. The API key
    never enters a table (the sender reads it from the executor environment)."""
    spark = resolved_llm.sparkSession
    langs = dims.languages(spark)
    s = langs.select(F.col("code").alias("_s"), F.col("name_zh").alias("_sn"))
    t = langs.select(F.col("code").alias("_t"), F.col("name_zh").alias("_tn"))
    df = (resolved_llm.join(s, resolved_llm["source"] == s["_s"], "left")
          .join(t, resolved_llm["target"] == t["_t"], "left"))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(K.SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 user_prompt(F.coalesce("_sn", "source"), F.coalesce("_tn", "target"), F.col("text")).alias("content")))
    payload = F.to_json(F.struct(F.col("model").alias("model"), messages.alias("messages"),
                                 F.lit(0).alias("temperature"), F.lit(True).alias("stream")))
    return df.select("request_id", endpoint("llm_base_url").alias("endpoint"), payload.alias("payload"))


# ---------------------------------------------------------------------------
# type checks (the strict decoder rejects wrong JSON types)
# ---------------------------------------------------------------------------
def _exists(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant").isNotNull()


def _kind_or(v: Column, path: str, implied: Column, name: str) -> Column:
    """The kind at ``path``, answered without walking the value when ``implied`` proves it
    (a successful deeper lookup proves every container on the way); exact either way."""
    return F.when(implied, F.lit(name)).otherwise(kind(v, path))


def _checked(rows: DataFrame, v: str) -> DataFrame:
    """Adds ``ok`` (every field that the decoders read has its type, in all choices) and ``failed``
    (an ``error`` object is there) for the value column ``v``.

    The kinds are columns computed once; the cheap proofs come first, and only values with
    more than one choice are walked choice by choice.
    """
    val = F.col(v)
    c0 = "$.choices[0]"
    has_c0, has_d, has_m = _exists(val, c0), _exists(val, c0 + ".delta"), _exists(val, c0 + ".message")
    kinds = {
        "$": _kind_or(val, "$", _exists(val, "$.choices") | _exists(val, "$.error"), "OBJECT"),
        "$.choices": _kind_or(val, "$.choices", has_c0, "ARRAY"),
        c0: _kind_or(val, c0, has_d | has_m, "OBJECT"),
        c0 + ".delta": _kind_or(val, c0 + ".delta", _exists(val, c0 + ".delta.content"), "OBJECT"),
        c0 + ".message": _kind_or(val, c0 + ".message", _exists(val, c0 + ".message.content"), "OBJECT"),
        c0 + ".delta.content": kind(val, c0 + ".delta.content"),
        c0 + ".message.content": kind(val, c0 + ".message.content"),
        "$.error": kind(val, "$.error"),
        "$.error.message": kind(val, "$.error.message"),
    }
    rows = rows.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(kinds.values())],
                       F.when(_exists(val, "$.choices[1]"), F.variant_get(val, "$.choices", "array<variant>")).alias("_more"))
    k = {p: F.col(f"_k{i}") for i, p in enumerate(kinds)}
    obj = lambda p: absent(k[p]) | k[p].startswith("OBJECT")
    text = lambda p: absent(k[p]) | (k[p] == "STRING")
    stream = F.col("route") == "stream"  # a completion decoder does not look at error and delta
    each = F.forall("_more", lambda c: object_or_absent(c, "$") & object_or_absent(c, "$.message")
                    & string_or_absent(c, "$.message.content")
                    & (~stream | (object_or_absent(c, "$.delta") & string_or_absent(c, "$.delta.content"))))
    ok = (val.isNotNull() & obj("$") & (absent(k["$.choices"]) | k["$.choices"].startswith("ARRAY")) & obj(c0)
          & obj(c0 + ".message") & text(c0 + ".message.content") & (F.col("_more").isNull() | each)
          & (~stream | (obj(c0 + ".delta") & text(c0 + ".delta.content") & obj("$.error") & text("$.error.message"))))
    rows = rows.withColumns({"ok": F.coalesce(ok, F.lit(False)), "failed": ~absent(k["$.error"]),
                             "has_message": k["$.error.message"] == "STRING"})
    return rows.drop("_more", *[f"_k{i}" for i in range(len(kinds))])


# ---------------------------------------------------------------------------
# Event framing
# ---------------------------------------------------------------------------
def _normalise_lines(body: Column) -> Column:
    """Each line loses up to two trailing CRs: one to the line scanner, one to the suffix trim."""
    return F.regexp_replace(F.regexp_replace(body, "\r{1,2}(\n)", "$1"), "\r{1,2}\\z", "")


# Data lines of one event: "data:" and at most one space, then the value to the
# line end ((?d): only LF ends a line; the CRs of line ends were removed before).
_DATA_LINE = "(?dm)^data: ?(.*)$"


def sse_events_of(body: Column) -> Column:
    """Events of a stream body: blank lines close them."""
    return F.split(_normalise_lines(body), "\n\n")


def event_data(event: Column) -> Column:
    """The ``data`` value of one event (its data lines joined by LF), NULL without data
    lines. Comment lines and other fields are ignored."""
    values = F.regexp_extract_all(event, F.lit(_DATA_LINE), 1)
    return F.when(F.size(values) > 0, F.array_join(values, "\n"))


def is_event_stream(content_type: Column) -> Column:
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("text/event-stream")


# ---------------------------------------------------------------------------
# One pass over the replies
# ---------------------------------------------------------------------------
def _route(replies: DataFrame) -> DataFrame:
    """Replies with their route: ``none`` (no status came), ``error`` (not 2xx), ``stream``, ``json``.

    A NULL body is an empty one. ``attempt`` (0 where the table has none) numbers the replies
    of one request; ``reply_key`` tells replies of the same attempt apart.
    """
    if "attempt" not in replies.columns:
        replies = replies.withColumn("attempt", F.lit(0).cast("bigint"))
    st = F.col("http_status")
    return replies.select(
        "request_id", F.col("attempt").cast("bigint").alias("attempt"), "http_status",
        F.coalesce("body", F.lit("")).alias("body"),
        F.xxhash64("http_status", "content_type", "body").alias("reply_key"),
        F.when(st.isNull(), F.lit("none")).when((st < 200) | (st >= 300), F.lit("error"))
        .when(is_event_stream(F.col("content_type")), F.lit("stream")).otherwise(F.lit("json")).alias("route"))


def _event_rows(routed: DataFrame) -> DataFrame:
    """One row per event of a stream, one row for any other reply, with kind and text.

    The body is read once, by a narrow explode; what follows is whole-stage codegen
    (higher-order lambdas are interpreted).
    """
    allow_repeated_keys(routed.sparkSession)
    stream = F.col("route") == "stream"
    ev = routed.select("request_id", "attempt", "reply_key", "route", "http_status", F.posexplode(
        F.when(stream, sse_events_of(F.col("body"))).otherwise(F.array("body"))).alias("ev", "raw"))
    ev = ev.withColumn("data", F.when(stream, event_data(F.col("raw"))).otherwise(F.col("raw")))
    ev = ev.withColumn("d", F.when(stream, go_trim("data")).otherwise(F.col("data"))).drop("raw")
    ev = ev.withColumn("_d", plain_keys("d", *REPLY_KEYS)).withColumn("_box", boxed("_d")) \
        .withColumn("v", unboxed(F.col("_box"))).drop("_box", "_d")
    ev = _checked(ev, "v")
    skip = stream & (F.col("data").isNull() | (F.col("d") == ""))
    message, content = string(F.col("v"), "$.choices[0].message.content"), string(F.col("v"), "$.choices[0].delta.content")
    ev = ev.withColumns({"msg": F.when(F.col("has_message"), go_trim(string(F.col("v"), "$.error.message"))).otherwise(F.lit("")),
                         "message": F.when(F.col("ok"), message).otherwise(F.lit(""))})
    kind_ = (F.when(F.col("route") == "none", F.lit(NO_STATUS)).when(F.col("route") == "error", F.lit(HTTP_ERROR))
             .when(skip, F.lit("SKIP")).when(stream & (F.col("d") == "[DONE]"), F.lit("DONE"))
             .when(~F.col("ok"), F.lit(PARSE_ERROR)).when(stream & F.col("failed"), F.lit(STREAM_ERROR))
             .otherwise(F.lit("DELTA")))
    ev = ev.withColumn("kind", kind_)
    reason = F.when(F.col("msg") == "", go_trim("data")).otherwise(F.col("msg"))
    text = (F.when(F.col("kind") == HTTP_ERROR, F.concat(F.lit(K.MSG_HTTP_ERROR_HEAD), F.col("http_status").cast("string"),
                                                         F.lit(K.MSG_HTTP_ERROR_MID), reason))
            .when(F.col("kind") == NO_STATUS, F.lit(K.MSG_NO_REPLY_STATUS))
            .when(F.col("kind") == STREAM_ERROR, F.concat(F.lit(K.MSG_STREAM_ERROR), F.when(
                F.col("msg") == "", F.lit(K.MSG_UNKNOWN_ERROR)).otherwise(F.col("msg"))))
            .when(F.col("kind") == PARSE_ERROR, F.when(stream, F.lit(K.MSG_STREAM_PARSE_ERROR)).otherwise(F.lit(K.MSG_PARSE_ERROR)))
            .when(F.col("kind") == "DELTA", F.when(stream & (content != ""), content).otherwise(F.col("message")))
            .otherwise(F.lit("")))
    return ev.select("request_id", "attempt", "reply_key", "route", "http_status", F.col("ev").cast("bigint").alias("ev"),
                     "data", "kind", text.alias("text"))


def _short(status: Column, http_status: Column, error: Column) -> Column:
    """C4: the message of an HTTP error is cut at 500 bytes."""
    head = F.concat(F.lit(K.MSG_HTTP_ERROR_HEAD), http_status.cast("string"), F.lit(K.MSG_HTTP_ERROR_MID))
    message = F.substr(error, F.length(head) + 1)
    return F.when(status == HTTP_ERROR, F.concat(head, byte_cut(message, K.ERROR_BYTES))).otherwise(error)


def fold_events(events: DataFrame) -> DataFrame:
    """``(request_id, attempt, route, http_status, status, text, error, error_full)``, one row per request.

    A stream stops at its first [DONE]; the first failure before it fails the reply even after
    deltas; deltas are concatenated and trimmed; blank is NO_TRANSLATION. Of several replies
    to one request the last attempt counts (within an attempt, the largest reply key).
    ``error`` is cut as the interactive program shows it, ``error_full`` is whole.

    One exchange by request: both groupings share it, and only kinds and texts cross it.
    """
    dealt = events.repartition("request_id")
    keep = F.when(F.col("kind") != "SKIP", F.struct("ev", "kind", "text"))
    d = dealt.groupBy("request_id", "attempt", "reply_key", "route", "http_status").agg(
        F.array_sort(F.collect_set(keep)).alias("_ev"))  # a reply landed twice counts once
    d = d.withColumn("_done", F.array_position(F.transform("_ev", lambda e: e["kind"] == "DONE"), True))
    d = d.withColumn("_live", F.when(F.col("_done") > 0, F.slice("_ev", 1, (F.col("_done") - 1).cast("int")))
                     .otherwise(F.col("_ev")))
    d = d.withColumn("_fail", F.try_element_at(F.filter("_live", lambda e: e["kind"] != "DELTA"), F.lit(1)))
    d = d.withColumn("_txt", go_trim(F.array_join(F.transform(F.filter("_live", lambda e: e["kind"] == "DELTA"),
                                                              lambda e: e["text"]), "")))
    status = (F.when(F.col("_fail").isNotNull(), F.col("_fail.kind"))
              .when(F.col("_txt") == "", F.lit(NO_TRANSLATION)).otherwise(F.lit(OK)))
    d = d.withColumn("status", status)
    error = F.coalesce(F.col("_fail.text"), F.when((F.col("status") == NO_TRANSLATION), F.lit(K.MSG_NO_TRANSLATION)), F.lit(""))
    d = d.select("request_id", F.struct(
        "attempt", "reply_key", "route", "http_status", "status",
        F.when(F.col("status") == OK, F.col("_txt")).otherwise(F.lit("")).alias("text"), error.alias("error")).alias("r"))
    last = d.groupBy("request_id").agg(F.max_by("r", F.struct("r.attempt", "r.reply_key")).alias("r")).select("request_id", "r.*")
    return last.select("request_id", "attempt", "route", "http_status", "status", "text",
                       _short(F.col("status"), F.col("http_status"), F.col("error")).alias("error"),
                       F.col("error").alias("error_full"))


def reply_guard(replies: DataFrame, cap: int = K.REPLY_BODY_CAP, line_cap: int = K.SSE_LINE_CAP) -> DataFrame:
    """K1: reports a JSON body over ``cap`` bytes or an event-stream line over ``line_cap``. A report only:
    every reply is decoded whole."""
    size = F.octet_length(F.coalesce("body", F.lit("")))
    longest = F.array_max(F.transform(F.split("body", "\n", -1), lambda line: F.octet_length(line)))
    # no line can exceed the cap when the whole body does not: split only the large bodies
    large = F.when(is_event_stream(F.col("content_type")), F.when(size <= line_cap, F.lit(False)).otherwise(longest > line_cap)) \
        .otherwise(size > cap)
    return replies.select("request_id", size.cast("bigint").alias("body_bytes"),
                          F.when(large, F.lit(REPLY_TOO_LARGE)).otherwise(F.lit(OK)).alias("guard"))


def decode_replies(replies: DataFrame) -> DataFrame:
    """Status first, then content type; one row per request that has a reply."""
    return fold_events(_event_rows(_route(replies)))


def completion_decode(replies: DataFrame) -> DataFrame:
    """The last non-stream 2xx reply of each request."""
    rows = _route(replies).where(F.col("route") == "json")
    return fold_events(_event_rows(rows)).select("request_id", "status", "text")


def sse_events(replies: DataFrame) -> DataFrame:
    """One row per event that carries data, in order."""
    rows = replies.where(is_event_stream(F.col("content_type")))
    ev = rows.select("request_id", F.posexplode(sse_events_of(F.coalesce("body", F.lit("")))).alias("ev", "raw"))
    ev = ev.select("request_id", F.col("ev").cast("bigint").alias("ev"), event_data(F.col("raw")).alias("data"))
    return ev.where(F.col("data").isNotNull())


def sse_text(replies: DataFrame) -> DataFrame:
    """Folded text and status of the last event-stream reply (2xx) of each request."""
    rows = _route(replies).where(F.col("route") == "stream")
    return fold_events(_event_rows(rows)).select("request_id", "status", "text", "error")


def error_messages(replies: DataFrame) -> DataFrame:
    """The last non-2xx reply of each request."""
    rows = _route(replies).where(F.col("route") == "error")
    return fold_events(_event_rows(rows)).select("request_id", "http_status", "error")


def correlate(resolved_llm: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies matched to requests by id; replies for unknown ids are dropped."""
    return resolved_llm.select("request_id", "model").join(replies, "request_id", "inner")
