"""Tables derived from the input tables, the same way the DuckDB oracle derives them.

Every derived table is a narrow projection (or an explode) of a driver table,
so it grows with its input and never passes through the driver. Variant rows
are *added* by rule on the row id; no input row is dropped. The DuckDB twins
live in ``transloom.plans.oracle`` and must stay in step with this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.sources.requests import requests_from_documents

ESC = "\x1b"
# Letters and digits only, so every word embeds in JSON without escaping.
REPLY_WORD = r"[\p{L}\p{N}]+"


def _s(c: Column) -> Column:
    return c.cast("string")


def tenant_index(tenant) -> Column:
    t = F.col(tenant) if isinstance(tenant, str) else tenant
    return F.coalesce(F.regexp_extract(t, r"[0-9]+", 0).try_cast("int"), F.lit(0))


# ---------------------------------------------------------------------------
# requests: every document, plus padded / blank / NULL / empty-language / unmapped / refused variants,
# requests without an id, of one id, asked twice, and lines that their source refused
# ---------------------------------------------------------------------------
PAD_HEAD = "\u3000 "
PAD_TAIL = " \u00a0\n"
BLANK_TEXT = " \t\u3000\u2003 "


def requests(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    kinds = F.array_compact(F.array(
        F.lit("d"),
        F.when(d % 10 == 3, F.lit("p")),
        F.when(d % 20 == 7, F.lit("w")),
        F.when(d % 20 == 11, F.lit("e")),
        F.when(d % 20 == 13, F.lit("s")),
        F.when(d % 20 == 17, F.lit("t")),
        F.when(d % 20 == 19, F.lit("x")),
        F.when(d % 20 == 1, F.lit("n")),
        F.when(d % 20 == 2, F.lit("l")),
        F.when(d % 10 == 5, F.lit("u")),
        F.when(d % 20 == 10, F.lit("f")),
        F.when(d % 20 == 4, F.lit("i")),
        F.when(d % 20 == 6, F.lit("j")),
        F.when(d % 20 == 8, F.lit("k")),
        F.when(d % 20 == 12, F.lit("r")),
        F.when(d % 20 == 14, F.lit("b")),
    ))
    base = requests_from_documents(documents, keep=("doc_id",))
    v = base.select("*", F.explode(kinds).alias("kind"))
    kind = F.col("kind")
    text = (F.when(kind == "p", F.concat(F.lit(PAD_HEAD), "text", F.lit(PAD_TAIL)))
            .when(kind == "w", F.lit(BLANK_TEXT))
            .when(kind.isin("e", "b"), F.lit(""))
            .when(kind == "f", F.concat(F.lit(K.PSEUDO_REFUSES), "text"))
            .when(kind != "n", F.col("text")))
    source = (F.when(kind.isin("s", "x"), F.lit("")).when(kind == "u", F.lit("pt"))
              .when(kind != "l", F.col("source")))
    target = (F.when(kind.isin("t", "x"), F.lit(""))
              .when(kind.isin("d", "r"), F.col("target")).otherwise(F.lit("zh")))
    return v.select(
        F.when(kind == "i", F.lit("")).when(kind == "k", F.lit("same")).when(kind == "r", F.concat(F.lit("d"), _s(d)))
        .when(kind != "j", F.concat(kind, _s(d))).alias("request_id"),
        F.col("tenant"),
        text.alias("text"),
        source.alias("source"),
        target.alias("target"),
        F.when(kind == "b", F.lit(K.MSG_BAD_REQUEST)).alias("error"),
    )


# ---------------------------------------------------------------------------
# settings: one raw JSON document per tenant, a second and different one for some, the same one twice for others
# ---------------------------------------------------------------------------
def _pick(i: Column, m: int, options: list) -> Column:
    out = None
    for k, value in enumerate(options):
        if value is None:
            continue
        cond = (i % m) == k
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out


SETTINGS_PROVIDER = ['"provider":"llm"', '"provider":"local"', None, '"provider":"LLM"']
SETTINGS_LOCAL_MODEL = ['"localModel":"facebook/nllb-200-distilled-600M"', '"localModel":"  "', None,
                        '"localModel":"Helsinki-NLP/opus-mt-en-zh"', '"localModel":"acme/custom-mt:v2"']
SETTINGS_BASE_URL = ['"llmBaseUrl":" https://api.example.com/v1/ "',
                     '"llmBaseUrl":"https://proxy.example.net/openai/Chat/Completions/"', None]
SETTINGS_LLM_MODEL = ['"llmModel":" gpt-4o-mini "', None, '"llmModel":" gpt-4o-mini "',
                      '"llmModel":"qwen2.5:7b"', None, '"llmModel":"  "', '"llmModel":"qwen2.5:7b"']
SETTINGS_CLIPBOARD = ['"clipboardEnabled":false', '"shortcutEnabled":false',
                      '"clipboardEnabled":true,"shortcutEnabled":false', None, '"shortcutEnabled":true',
                      '"clipboardEnabled":false,"shortcutEnabled":true']
SETTINGS_SOURCE = ['"sourceLanguage":"fr"', '"sourceLanguage":""', '"sourceLanguage":"pt"', None, None, None, None]
SETTINGS_TARGET = ['"targetLanguage":"en"', '"targetLanguage":""', '"targetLanguage":"ja"', None, None]


SETTINGS_BROKEN = '{"provider":"llm","llmModel":'
SETTINGS_TYPED = '{"provider":5}'
SETTINGS_CASE = '{"Provider":"llm","LLMModel":"qwen2.5:7b","llmBaseUrl":"https://x.example.com"}'


SETTINGS_OTHER = '{"provider":"local","targetLanguage":"fr"}'


def settings(documents: DataFrame) -> DataFrame:
    """Settings JSON documents of each tenant (the ``source`` column of documents)."""
    tenants = documents.select(F.col("source").alias("tenant")).distinct()
    i = tenant_index("tenant")
    parts = [_pick(i, len(opts), opts) for opts in (
        SETTINGS_PROVIDER, SETTINGS_LOCAL_MODEL, SETTINGS_BASE_URL, SETTINGS_LLM_MODEL,
        SETTINGS_CLIPBOARD, SETTINGS_SOURCE, SETTINGS_TARGET)]
    raw = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    raw = F.when(i % 20 == 7, F.lit(SETTINGS_BROKEN)).when(i % 20 == 9, F.lit(SETTINGS_TYPED)) \
        .when(i % 20 == 11, F.lit(SETTINGS_CASE)).otherwise(raw)
    files = F.when(i % 20 == 3, F.array(raw, F.lit(SETTINGS_OTHER))).when(i % 20 == 5, F.array(raw, raw)).otherwise(F.array(raw))
    return tenants.select("tenant", F.explode(files).alias("raw"))


# ---------------------------------------------------------------------------
# translation memory seed: benchmark passages and every third document, into Chinese, both
# models; its translations carry a mark that the test double never returns
# ---------------------------------------------------------------------------
MEMORY_MARK = "(tm) "


def memory_seed(benchmark: DataFrame, documents: DataFrame) -> DataFrame:
    from transloom.functions.text import paragraph_parts
    earlier = documents.where(F.col("doc_id") % 3 == 0).select(F.col("lang").alias("source"), "text")
    texts = benchmark.select(F.lit("en").alias("source"), "text").unionByName(earlier)
    parts = texts.select("source", F.explode(paragraph_parts("text")).alias("segment")) \
        .where(~F.col("segment").startswith("\n")).distinct()
    model_ids = F.array(*[F.lit(m[0]) for m in K.MODELS])
    return parts.select(
        "source", F.lit("zh").alias("target"), F.explode(model_ids).alias("model"), "segment",
        F.concat(F.lit(MEMORY_MARK), "segment").alias("translation"))


# ---------------------------------------------------------------------------
# LLM replies: one landed HTTP reply per document request
# ---------------------------------------------------------------------------
def _delta(w: Column, field: str = "delta", nl: str = "\n") -> Column:
    return F.concat(F.lit('data: {"choices":[{"' + field + '":{"content":"'), w, F.lit(' "}}]}' + nl + nl))


def sse_body(words: Column, variant: Column) -> Column:
    plain = F.array_join(F.transform(words, lambda w: _delta(w)), "")
    crlf = F.concat(F.lit(": keep-alive\r\n"), F.array_join(F.transform(
        words, lambda w: F.concat(F.lit("event: message\r\n"), _delta(w, nl="\r\n"))), ""),
        F.lit("data: {\"choices\":[]}\r\r\n\r\r\ndata: [DONE]\r\n\r\n"))
    message = F.array_join(F.transform(words, lambda w: F.concat(
        F.lit('data: {"choices":[{"message":{"content":"'), w, F.lit(' "}}]}'))), "\n\n")
    multiline = F.concat(F.lit('data: {"choices":[]}\n\n'), F.array_join(F.transform(words, lambda w: F.concat(
        F.lit('data: {"error":null,"choices":[{"delta":\ndata: {"content":"'), w, F.lit(' "}}]}\n\n'))), ""),
        F.lit("data:[DONE]\n\n"))
    return (F.when(variant == 0, F.concat(plain, F.lit("data: [DONE]\n\n")))
            .when(variant == 1, crlf)
            .when(variant == 2, F.concat(plain, F.lit('data: {"error":{"message":" rate limited "}}\n\n'),
                                         F.lit("data: [DONE]\n\n")))
            .when(variant == 3, F.concat(plain, F.lit('data: {"choices":[]} and more\n\n')))
            .when(variant == 4, F.concat(plain, F.lit("data: [DONE]\n\n"),
                                         F.lit('data: {"error":{"message":"late"}}\n\n')))
            .when(variant == 5, F.replace(message, F.lit('"content"'), F.lit('"CONTENT"')))
            .otherwise(multiline))


def llm_replies(documents: DataFrame) -> DataFrame:
    """Landed replies: none for one document in 11, a second attempt for one in 13, some without
    a status or a body, JSON with trailing text or a wrong type in a later choice."""
    first = _first_replies(documents).where(F.col("doc_id") % 11 != 4)
    d = F.col("doc_id")
    again = documents.where(d % 13 == 0).select(
        "doc_id", F.lit(1).cast("bigint").alias("attempt"), F.lit(200).cast("int").alias("http_status"),
        F.lit("application/json").alias("content_type"),
        F.concat(F.lit('{"choices":[{"message":{"content":"retry '), _s(d), F.lit('"}}]}')).alias("body"))
    return first.unionByName(again).select(
        F.concat(F.lit("d"), _s(d)).alias("request_id"), "attempt", "http_status", "content_type", "body")


def _first_replies(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    words = F.regexp_extract_all("text", F.lit(REPLY_WORD), 0)
    joined = F.array_join(words, " ")
    k = d % 5
    status = F.when(k == 3, F.when(d % 2 == 0, F.lit(429)).otherwise(F.lit(502))).otherwise(F.lit(200))
    ctype = (F.when(k == 1, F.lit("Text/Event-Stream; charset=utf-8"))
             .when(k == 2, F.lit("application/json; charset=utf-8"))
             .when(k == 4, F.lit("text/html")).otherwise(F.lit("application/json")))
    ok_json = F.concat(F.lit('{"id":"r'), _s(d), F.lit('","choices":[{"index":0,"message":{"role":"assistant",'
                                                       '"content":" '), joined, F.lit(' "}}]}'))
    ok_json = F.when(d % 4 == 1, F.concat(ok_json, F.lit(" and more"))).otherwise(ok_json)
    cased = F.concat(F.lit('{"Choices": [{"MESSAGE":{"Content" :" '), joined, F.lit(' "}}]}'))  # names in another case
    ok_json = F.when(d % 3 == 2, cased).otherwise(ok_json)
    odd_json = (F.when(d % 6 == 0, F.lit('{"choices":[{"message":{"content":"x"}},{"message":{"content":5}}]}'))
                .when(d % 3 == 0, F.lit('{"choices":[]}'))
                .when(d % 3 == 1, F.lit('{"choices":[{"message":{"content":"  "}}]}'))
                .otherwise(F.concat(F.lit('{"choices":[{"message":{"content":'), _s(F.size(words)),
                                    F.lit("}}]}"))))
    error_body = (F.when(d % 3 == 0, F.concat(F.lit('{"error":{"message":"  quota exceeded: '),
                                              F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), F.lit('  "}}')))
                  .when(d % 8 == 0, F.lit('{"Error":{"Message":"case"}}'))
                  .when(d % 3 == 1, F.col("text"))
                  .otherwise(F.lit('{"error":{"message":""}}')))
    body = (F.when(k == 0, ok_json).when(k == 1, sse_body(words, d % 7)).when(k == 2, odd_json)
            .when(k == 3, error_body).otherwise(F.concat(F.lit("<html>"), joined, F.lit("</html>"))))
    return documents.select(
        "doc_id", F.lit(0).cast("bigint").alias("attempt"),
        F.when(d % 17 != 3, status).cast("int").alias("http_status"),
        ctype.alias("content_type"),
        F.when(d % 19 != 6, body).alias("body"),
    )


# ---------------------------------------------------------------------------
# deltas: the words of every document as a reply stream, a few ms apart
# ---------------------------------------------------------------------------
def deltas(documents: DataFrame) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(REPLY_WORD), 0)
    exploded = documents.select(F.concat(F.lit("d"), _s(F.col("doc_id"))).alias("request_id"),
                                F.posexplode(words).alias("seq", "word"))
    return exploded.select(
        "request_id", F.col("seq").cast("bigint").alias("seq"),
        (F.col("seq") * 12 + F.length("word") % 10).cast("bigint").alias("t_ms"),
        F.concat(F.col("word"), F.lit(" ")).alias("delta"),
    )


# ---------------------------------------------------------------------------
# progress logs: one download log per user, one record per event
# ---------------------------------------------------------------------------
def _progress_p(value: Column) -> Column:
    return (F.floor(value) % 5 * 25).cast("int")


def progress_log(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    p = _progress_p(F.col("value"))
    ps = _s(p)
    fname = F.concat(F.col("event_type"), F.lit(".safetensors"))
    named = F.concat(fname, F.lit(": "), ps, F.lit("%|"), F.repeat(F.lit("█"), (p / 25).cast("int")),
                     F.lit(" | "), ps, F.lit("M/100M"))
    k = e % 9
    line = (F.when(k == 0, named)
            .when(k == 1, F.concat(F.lit(ESC + "[2K" + ESC + "[1G"), named))
            .when(k == 2, F.lit("  "))
            .when(k == 3, F.concat(F.lit("Downloading: "), ps, F.lit("%")))
            .when(k == 4, F.lit("Fetching 3 files: 100%|██████████| 3/3"))
            .when(k == 5, F.lit("config.json: 999%|"))
            .when(k == 6, F.concat(F.lit("warning: retrying "), F.col("event_type")))
            .when(k == 7, F.concat(F.repeat(F.lit("x"), 190), F.lit(" "), ps, F.lit("%")))
            .otherwise(F.concat(F.lit(ESC + "[33mUserWarning: "), F.col("props"), F.lit(ESC + "[0m"))))
    u = F.col("user_id")
    model = (F.when(u % 3 == 0, F.lit(K.DEFAULT_LOCAL_MODEL)).when(u % 3 == 1, F.lit(K.DEFAULT_NLLB_MODEL))
             .otherwise(F.lit("acme/custom-mt:v2")))
    return events.select(
        F.concat(F.lit("u"), _s(u)).alias("log_id"),
        model.alias("model"),
        e.alias("n"),
        line.alias("line"),
    )


def download_lines(events: DataFrame) -> DataFrame:
    """``(line, us)``: what the program logs of downloads: progress with a free message, output of several lines, failures."""
    e = F.col("event_id")
    model = F.when(F.col("user_id") % 2 == 0, F.lit(K.DEFAULT_LOCAL_MODEL)).otherwise(F.lit("my own model"))  # names may have blanks
    p = _progress_p(F.col("value"))
    line = (F.when(e % 5 == 0, F.concat(F.lit("model download output; model="), model, F.lit(" progress="), _s(p), F.lit(" message=at "), _s(p),
                                        F.lit("; model=x error=none")))
            .when(e % 5 == 1, F.concat(F.lit("model download stdout; model="), model, F.lit(" output=first\n\n  second; error=2 "), F.col("event_type")))
            .when(e % 5 == 2, F.concat(F.lit("model download failed; model="), model, F.lit(" error=exit status 1\nlast: "), F.col("event_type")))
            .when(e % 5 == 3, F.concat(F.lit("runtime installer output:\n"), F.col("event_type"), F.lit("\r\ndone")))
            .otherwise(F.concat(F.lit("runtime preparation failed: "), F.col("event_type"), F.lit(": no python"))))
    return events.select(line.alias("line"), (e * 7).alias("us"))


def log_blobs(events: DataFrame) -> DataFrame:
    """One stderr blob per event with CR, LF and CRLF record ends."""
    e = F.col("event_id")
    p = _progress_p(F.col("value"))
    fname = F.concat(F.col("event_type"), F.lit(".safetensors"))
    sep1 = F.when(e % 3 == 0, F.lit("\r\n")).when(e % 3 == 1, F.lit("\n")).otherwise(F.lit("\r"))
    tail_ = (F.when(e % 4 == 0, F.lit("\nfinished")).when(e % 4 == 1, F.lit("\n"))
             .when(e % 4 == 2, F.lit("\r\n\r\nfinished")).otherwise(F.lit("")))
    blob = F.concat(fname, F.lit(": "), _s(p), F.lit("%|x\r"), fname, F.lit(": "), _s(p + 1), F.lit("%|x"),
                    sep1, F.lit("warning "), F.col("event_type"), tail_)
    return events.select(e.alias("log_id"), blob.alias("blob"))


# ---------------------------------------------------------------------------
# change feed polls, typed input, key taps: all from events
# ---------------------------------------------------------------------------
def feed(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    seq = F.when(e % 13 == 0, F.lit(0)).otherwise(F.floor(F.col("value") / 5)).cast("bigint")
    return events.select(
        F.col("user_id").alias("device"), e.alias("poll"), seq.alias("seq"),
        F.when(e % 17 == 3, seq + 1).otherwise(seq).alias("seq_after"),
        (e % 11 != 5).alias("read_ok"),
        F.when(F.col("event_type") == "purchase", F.lit("self")).otherwise(F.lit("user")).alias("origin"),
        F.when(e % 19 == 2, F.lit(" \t ")).otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("props")))
        .alias("text"),
        F.col("ts"),
    )


def poll_lines(events: DataFrame) -> DataFrame:
    """The polls of ``feed`` as their devices land them, a JSON line each; some lines are cut, no object, or lack fields."""
    polls = feed(events).withColumn("ts", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
    whole = F.to_json(F.struct("poll", "seq", "seq_after", "read_ok", "origin", "text", "ts"))
    m = F.col("poll") % 23
    value = (F.when(m == 1, F.substr(whole, F.lit(1), F.length(whole) - 1))
             .when(m == 2, F.to_json(F.struct("poll", "text")))
             .when(m == 3, F.to_json(F.struct("poll", "seq", "origin", "text", "ts")))
             .when(m == 4, F.concat(F.lit("["), whole, F.lit("]")))
             .when(m == 5, F.lit(" ")).otherwise(whole))
    device = F.when(m == 6, F.lit("lost")).otherwise(_s(F.col("device")))
    return polls.select(device.alias("device"), F.lit("0001.jsonl").alias("file"), F.col("poll").alias("line"), value.alias("value"))


def request_lines(documents: DataFrame) -> DataFrame:
    """Requests as JSON lines ``value``; some are cut, no object, followed by something, blank, or have odd fields."""
    d, m = F.col("doc_id"), F.col("doc_id") % 17
    name, target = F.concat(F.lit("d"), _s(d)).alias("id"), F.when(d % 2 == 0, F.lit("zh")).otherwise(F.lit("ja")).alias("target")
    text, source = F.col("text"), F.col("lang").alias("source")
    whole = F.to_json(F.struct(name, text, source, target))
    return documents.select(
        F.when(m == 3, F.substr(whole, F.lit(1), F.length(whole) - 1))
        .when(m == 5, F.to_json(F.struct(text, source, target)))
        .when(m == 7, F.to_json(F.struct(name, d.alias("text"), source, target)))
        .when(m == 9, F.concat(F.lit("["), whole, F.lit("]")))
        .when(m == 11, F.concat(whole, F.lit(" x")))
        .when(m == 13, F.lit(" \t"))
        .when(m == 15, F.to_json(F.struct(d.alias("id"), text)))
        .otherwise(whole).alias("value"))


def typed_input(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    trigger = (F.when(F.col("event_type") == "click", F.lit("manual"))
               .when(F.col("event_type") == "signup", F.lit("feed")).otherwise(F.lit("auto")))
    text = F.when(e % 5 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("note "), _s(F.floor(F.col("value")).cast("bigint") % 3)))
    return events.select(
        F.col("user_id").alias("user_id"), e.alias("n"), trigger.alias("trigger"),
        F.lit("en").alias("source"),
        F.when(e % 7 == 0, F.lit("ja")).otherwise(F.lit("zh")).alias("target"),
        text.alias("text"),
    )


def turn_rows(events: DataFrame) -> DataFrame:
    """Feed texts, typed text and ends of translations of each user, in order of the event id."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, F.lit("done")).when(F.col("event_type").isin("signup", "view"), F.lit("feed")).otherwise(F.lit("typed"))
    text = F.when(e % 11 == 5, F.lit(" \t")).otherwise(F.concat(F.lit(" note "), _s(F.floor(F.col("value")).cast("bigint") % 3)))
    return events.select("user_id", e.alias("n"), kind.alias("kind"), F.lit("en").alias("source"),
                         F.when(e % 13 == 0, F.lit("ja")).otherwise(F.lit("zh")).alias("target"), text.alias("text"))


def taps(events: DataFrame) -> DataFrame:
    """Key taps: clicks are another key, everything else the modifier; 3 ms per event id.
    A key cannot go down again while it is held, so each hold ends before the user's next press."""
    from transloom.operators.ordering import keyed_lag
    e = F.col("event_id")
    base = events.select("user_id", "event_type", (e * 3).alias("press_ms"),
                         ((F.floor(F.col("value")).cast("bigint") % 7) * 90).alias("hold"),
                         (-e * 3).alias("_rev"))
    nxt = keyed_lag(base, ["user_id"], "_rev", ["press_ms"], 1 << 22, prefix="next_")
    hold = F.when(F.col("next_press_ms").isNull(), F.col("hold")).otherwise(
        F.least(F.col("hold"), F.col("next_press_ms") - F.col("press_ms") - 1))
    return nxt.select(
        "user_id",
        F.when(F.col("event_type") == "click", F.lit("other")).otherwise(F.lit("ctrl")).alias("key"),
        "press_ms", (F.col("press_ms") + hold).alias("release_ms"),
    )
