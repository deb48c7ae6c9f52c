"""DuckDB twins of the registered queries.

Each string is standalone SQL over the pre-registered views (documents,
events, pages, benchmark, conversations, ...). Derived tables are rebuilt as
CTEs by the same rules ``transloom.sources.fixtures`` uses in Spark. The two
sequential folds (``delta_batches``, ``paired_events``) are list reductions here.
"""

from __future__ import annotations

from transloom import constants as K
from transloom.sources import fixtures as fx

# ---------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = K.WHITE_SPACE_CLASS


def trim(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def shorten(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE substring({x}, 1, {n}) || '{K.ELLIPSIS}' END)"


def tail(x: str, n: int) -> str:
    t = trim(x)
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE '{K.ELLIPSIS}' || right({t}, {n}) END)"


def safe(x: str) -> str:
    return f"replace(replace(replace({x}, '/', '--'), '\\', '--'), ':', '-')"


def endpoint(x: str) -> str:
    b = f"regexp_replace({x}, '/+\\z', '', 'g')"
    return (f"(CASE WHEN ends_with(lower({b}), '{K.COMPLETIONS_PATH}') THEN {b} "
            f"WHEN ends_with(lower({b}), '{K.V1_PATH}') THEN {b} || '{K.COMPLETIONS_PATH}' "
            f"ELSE {b} || '{K.V1_PATH}{K.COMPLETIONS_PATH}' END)")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^\\t\\n\\f\\r ]+', 0)"


def chunks(w: str, size: int = K.CHUNK_TOKENS) -> str:
    return (f"(CASE WHEN len({w}) > 0 THEN list_transform(range(0, len({w}), {size}), "
            f"lambda i: {w}[i + 1 : i + {size}]) ELSE [] END)")


def pseudo(seg: str, target: str) -> str:
    return (f"array_to_string(list_transform({chunks(words(seg))}, "
            f"lambda c: '[' || {target} || '] ' || array_to_string(c, ' ')), ' ')")


def refused(seg: str) -> str:
    return f"starts_with({seg}, {lit(K.PSEUDO_REFUSES)})"


def parts(x: str) -> str:
    return f"regexp_extract_all({x}, '{K.PARAGRAPH_PARTS}', 1)"


def pick(i: str, options: list) -> str:
    m = len(options)
    whens = " ".join(f"WHEN {i} % {m} = {k} THEN {lit(v)}" for k, v in enumerate(options) if v is not None)
    return f"(CASE {whens} END)"


MODEL_IDS = [m[0] for m in K.MODELS]
READY_MARKERS = ", ".join(lit(m.replace("/", "--").replace("\\", "--").replace(":", "-") + ".ready")
                          for m in MODEL_IDS)
LANG_CODES = ", ".join(lit(c) for c, _, _ in K.LANGUAGES)
LANG_VALUES = ", ".join(f"({lit(c)}, {lit(n)}, {lit(b)})" for c, n, b in K.LANGUAGES)


def _status_message(x: str) -> str:
    from transloom.operators.admission import STATUS_MESSAGES
    whens = " ".join(f"WHEN {x} = {lit(code)} THEN {lit(msg)}" for code, msg in STATUS_MESSAGES.items())
    return f"(CASE {whens} ELSE '' END)"


def _row_message() -> str:
    return (f"(CASE status WHEN 'REFUSED' THEN refused WHEN 'SETTINGS_ERROR' THEN settings_error "
            f"ELSE {_status_message('status')} END)")


# ---------------------------------------------------------------------------
# derived tables (twins of transloom.sources.fixtures)
# ---------------------------------------------------------------------------
REQUESTS = f"""
requests AS (
  SELECT CASE kind WHEN 'i' THEN '' WHEN 'j' THEN NULL WHEN 'k' THEN 'same' WHEN 'r' THEN 'd' || CAST(doc_id AS VARCHAR)
              ELSE kind || CAST(doc_id AS VARCHAR) END AS request_id, source AS tenant,
    CASE kind WHEN 'p' THEN {lit(fx.PAD_HEAD)} || text || {lit(fx.PAD_TAIL)}
              WHEN 'w' THEN {lit(fx.BLANK_TEXT)} WHEN 'e' THEN '' WHEN 'b' THEN '' WHEN 'f' THEN {lit(K.PSEUDO_REFUSES)} || text
              WHEN 'n' THEN NULL ELSE text END AS text,
    CASE WHEN kind IN ('s', 'x') THEN '' WHEN kind = 'u' THEN 'pt' WHEN kind = 'l' THEN NULL ELSE lang END AS source,
    CASE WHEN kind IN ('t', 'x') THEN '' WHEN kind IN ('d', 'r') THEN (CASE WHEN doc_id % 2 = 0 THEN 'zh' ELSE 'en' END)
         ELSE 'zh' END AS target,
    CASE WHEN kind = 'b' THEN {lit(K.MSG_BAD_REQUEST)} END AS error
  FROM (SELECT *, unnest(list_filter(['d',
          CASE WHEN doc_id % 10 = 3 THEN 'p' END, CASE WHEN doc_id % 20 = 7 THEN 'w' END,
          CASE WHEN doc_id % 20 = 11 THEN 'e' END, CASE WHEN doc_id % 20 = 13 THEN 's' END,
          CASE WHEN doc_id % 20 = 17 THEN 't' END, CASE WHEN doc_id % 20 = 19 THEN 'x' END,
          CASE WHEN doc_id % 20 = 1 THEN 'n' END, CASE WHEN doc_id % 20 = 2 THEN 'l' END,
          CASE WHEN doc_id % 10 = 5 THEN 'u' END, CASE WHEN doc_id % 20 = 10 THEN 'f' END,
          CASE WHEN doc_id % 20 = 4 THEN 'i' END, CASE WHEN doc_id % 20 = 6 THEN 'j' END,
          CASE WHEN doc_id % 20 = 8 THEN 'k' END, CASE WHEN doc_id % 20 = 12 THEN 'r' END,
          CASE WHEN doc_id % 20 = 14 THEN 'b' END],
          lambda k: k IS NOT NULL)) AS kind FROM documents) d
)"""

_I = "coalesce(try_cast(regexp_extract(tenant, '[0-9]+', 0) AS INTEGER), 0)"
SETTINGS = f"""
settings AS (
  SELECT tenant, unnest(CASE WHEN {_I} % 20 = 3 THEN [raw, {lit(fx.SETTINGS_OTHER)}] WHEN {_I} % 20 = 5 THEN [raw, raw] ELSE [raw] END) AS raw
  FROM (SELECT tenant, CASE WHEN {_I} % 20 = 7 THEN {lit(fx.SETTINGS_BROKEN)} WHEN {_I} % 20 = 9 THEN {lit(fx.SETTINGS_TYPED)}
      WHEN {_I} % 20 = 11 THEN {lit(fx.SETTINGS_CASE)} ELSE '{{' || concat_ws(',', {pick(_I, fx.SETTINGS_PROVIDER)}, {pick(_I, fx.SETTINGS_LOCAL_MODEL)},
      {pick(_I, fx.SETTINGS_BASE_URL)}, {pick(_I, fx.SETTINGS_LLM_MODEL)}, {pick(_I, fx.SETTINGS_CLIPBOARD)},
      {pick(_I, fx.SETTINGS_SOURCE)}, {pick(_I, fx.SETTINGS_TARGET)}) || '}}' END AS raw
  FROM (SELECT DISTINCT source AS tenant FROM documents) t) f
)"""

_LM = f"coalesce(json_extract_string(raw, '$.localModel'), {lit(K.DEFAULT_LOCAL_MODEL)})"
_READABLE = ("json_valid(raw) AND coalesce(json_type(CASE WHEN json_valid(raw) THEN raw END, '$.provider'), 'VARCHAR') "
             "IN ('VARCHAR', 'NULL')")
def normalized(name: str, rows: str) -> str:
    return f"""
{name} AS (
  SELECT tenant,
    CASE WHEN coalesce(json_extract_string(raw, '$.provider'), json_extract_string(raw, '$.Provider')) = 'llm' THEN 'llm'
         ELSE 'local' END AS provider,
    CASE WHEN {trim(_LM)} = '' THEN {lit(K.DEFAULT_LOCAL_MODEL)} ELSE {_LM} END AS local_model,
    regexp_replace({trim("coalesce(json_extract_string(raw, '$.llmBaseUrl'), '')")}, '/+\\z', '', 'g')
      AS llm_base_url,
    {trim("coalesce(json_extract_string(raw, '$.llmModel'), json_extract_string(raw, '$.LLMModel'), '')")} AS llm_model,
    coalesce(CAST(json_extract(raw, '$.clipboardEnabled') AS BOOLEAN),
             CAST(json_extract(raw, '$.shortcutEnabled') AS BOOLEAN), true) AS clipboard_enabled,
    coalesce(CAST(json_extract(raw, '$.quickOpenEnabled') AS BOOLEAN), true) AS quick_open_enabled,
    CASE WHEN coalesce(json_extract_string(raw, '$.sourceLanguage'), '') = '' THEN 'en'
         ELSE json_extract_string(raw, '$.sourceLanguage') END AS source_language,
    CASE WHEN coalesce(json_extract_string(raw, '$.targetLanguage'), '') = '' THEN 'zh'
         ELSE json_extract_string(raw, '$.targetLanguage') END AS target_language,
    settings_error
  FROM (SELECT tenant, CASE WHEN {_READABLE} THEN raw ELSE '{{}}' END AS raw,
               CASE WHEN {_READABLE} THEN '' ELSE {lit(K.MSG_SETTINGS_ERROR)} END AS settings_error FROM {rows}) s
)"""


NORMALIZED = normalized("ns", "settings")
# one row per tenant; different documents of a tenant are an error
PER_TENANT = f"""
one AS (SELECT tenant, min(raw) <> max(raw) AS conflict, CASE WHEN min(raw) <> max(raw) THEN '{{}}' ELSE min(raw) END AS raw
        FROM settings GROUP BY tenant),{normalized("tn", "one")},
ts AS (SELECT tn.* REPLACE (CASE WHEN one.conflict THEN {lit(K.MSG_SETTINGS_CONFLICT)} ELSE tn.settings_error END AS settings_error)
       FROM tn JOIN one USING (tenant))"""

ADMITTED = f"""
adm AS (
  SELECT request_id, tenant, text, source, target, length(t) AS n_chars, length(t) > {K.MAX_CHARS} AS over_limit, refused,
    CASE WHEN refused <> '' THEN 'REFUSED' WHEN t = '' THEN 'EMPTY' WHEN source = target THEN 'DIRECT' ELSE 'ADMITTED' END AS status
  FROM (SELECT request_id, tenant, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(target, '') AS target,
               {trim("coalesce(text, '')")} AS t, coalesce(error, '') AS refused FROM requests) r
)"""

RESOLVED = f"""
ws AS (
  SELECT a.*, coalesce(s.provider, 'local') AS provider,
    coalesce(s.local_model, {lit(K.DEFAULT_LOCAL_MODEL)}) AS local_model,
    coalesce(s.llm_base_url, '') AS llm_base_url, coalesce(s.llm_model, '') AS llm_model,
    coalesce(s.source_language, 'en') AS source_language, coalesce(s.target_language, 'zh') AS target_language,
    coalesce(s.settings_error, '') AS settings_error, a.source AS raw_source, a.target AS raw_target
  FROM adm a LEFT JOIN ts s USING (tenant)
),
filled AS (
  SELECT * REPLACE (
    CASE WHEN status = 'ADMITTED' AND source = '' THEN source_language ELSE source END AS source,
    CASE WHEN status = 'ADMITTED' AND target = '' THEN target_language ELSE target END AS target)
  FROM ws
),
resolved AS (
  SELECT request_id, tenant, text, source, target, n_chars, provider, llm_base_url, raw_source, raw_target, refused, settings_error,
    CASE WHEN provider = 'llm' THEN llm_model ELSE local_model END AS model,
    CASE WHEN status = 'REFUSED' THEN status WHEN settings_error <> '' THEN 'SETTINGS_ERROR' WHEN status <> 'ADMITTED' THEN status
         WHEN provider = 'llm' AND {trim("llm_base_url")} = '' THEN 'LLM_NO_URL'
         WHEN provider = 'llm' AND {trim("llm_model")} = '' THEN 'LLM_NO_MODEL'
         WHEN provider = 'llm' THEN 'READY'
         WHEN local_model = {lit(K.DEFAULT_LOCAL_MODEL)} AND (source <> 'en' OR target <> 'zh') THEN 'PAIR_UNSUPPORTED'
         WHEN {safe("local_model")} || '.ready' NOT IN ({READY_MARKERS}) THEN 'MODEL_NOT_READY'
         WHEN lower(local_model) LIKE '%nllb%' AND NOT (source IN ({LANG_CODES}) AND target IN ({LANG_CODES}))
           THEN 'LANG_UNMAPPED'
         ELSE 'READY' END AS status
  FROM filled
)"""

BASE = f"WITH {REQUESTS},{SETTINGS},{PER_TENANT},{ADMITTED},{RESOLVED}"

MEMORY = f"""
mem AS (
  SELECT p.source, 'zh' AS target, m.model, p.segment, {lit(fx.MEMORY_MARK)} || p.segment AS translation
  FROM (SELECT DISTINCT source, unnest({parts("text")}) AS segment FROM (
          SELECT 'en' AS source, text FROM benchmark UNION ALL SELECT lang, text FROM documents WHERE doc_id % 3 = 0) t) p
  CROSS JOIN (VALUES {", ".join(f"({lit(m)})" for m in MODEL_IDS)}) m(model)
  WHERE NOT starts_with(p.segment, chr(10))
)"""

LOCAL_PARTS = f"""
rl AS MATERIALIZED (SELECT row_number() OVER () AS rid, request_id, tenant, text, source, target, model, raw_source, raw_target, n_chars
  FROM resolved WHERE status = 'READY' AND provider = 'local'),
lp AS (
  SELECT rid, source, target, model, unnest({parts("text")}) AS part,
         generate_subscripts({parts("text")}, 1) - 1 AS part_no
  FROM rl
),
uniq AS (SELECT DISTINCT source, target, model, part AS segment FROM lp WHERE NOT starts_with(part, chr(10)))"""

REASSEMBLED = f"""
tr AS (SELECT u.source, u.target, u.model, u.segment, m.translation IS NULL AND {refused("u.segment")} AS failed,
              coalesce(m.translation, {pseudo("u.segment", "u.target")}) AS translation
       FROM uniq u LEFT JOIN mem m USING (source, target, model, segment)),
joined AS (
  SELECT lp.rid,
    CASE WHEN coalesce(bool_or(tr.failed), false) THEN '' ELSE
      {trim("string_agg(CASE WHEN starts_with(lp.part, chr(10)) THEN lp.part ELSE tr.translation END, '' ORDER BY lp.part_no)")}
      END AS text,
    CASE WHEN coalesce(bool_or(tr.failed), false) THEN {lit(K.MSG_PSEUDO_REFUSED)} ELSE '' END AS error
  FROM lp LEFT JOIN tr ON lp.source = tr.source AND lp.target = tr.target AND lp.model = tr.model
    AND lp.part = tr.segment
  GROUP BY lp.rid
),
reassembled AS (SELECT rl.*, joined.text AS done, joined.error FROM rl JOIN joined USING (rid))"""


def _reply_delta(w: str, field: str = "delta", nl: str = "\n") -> str:
    return f"""'data: {{"choices":[{{"{field}":{{"content":"' || {w} || ' "}}}}]}}' || {lit(nl + nl)}"""


_W = "words"
SSE_BODY = f"""(CASE doc_id % 7
  WHEN 0 THEN array_to_string(list_transform({_W}, lambda w: {_reply_delta("w")}), '') || {lit("data: [DONE]" + chr(10) * 2)}
  WHEN 1 THEN {lit(": keep-alive" + chr(13) + chr(10))} || array_to_string(list_transform({_W}, lambda w:
      {lit("event: message" + chr(13) + chr(10))} || {_reply_delta("w", nl=chr(13) + chr(10))}), '')
      || {lit('data: {"choices":[]}' + (chr(13) * 2 + chr(10)) * 2 + "data: [DONE]" + (chr(13) + chr(10)) * 2)}
  WHEN 2 THEN array_to_string(list_transform({_W}, lambda w: {_reply_delta("w")}), '')
      || {lit('data: {"error":{"message":" rate limited "}}' + chr(10) * 2)} || {lit("data: [DONE]" + chr(10) * 2)}
  WHEN 3 THEN array_to_string(list_transform({_W}, lambda w: {_reply_delta("w")}), '') || {lit('data: {"choices":[]} and more' + chr(10) * 2)}
  WHEN 4 THEN array_to_string(list_transform({_W}, lambda w: {_reply_delta("w")}), '') || {lit("data: [DONE]" + chr(10) * 2)}
      || {lit('data: {"error":{"message":"late"}}' + chr(10) * 2)}
  WHEN 5 THEN array_to_string(list_transform({_W}, lambda w: 'data: {{"choices":[{{"message":{{"CONTENT":"' || w || ' "}}}}]}}'),
      {lit(chr(10) * 2)})
  ELSE {lit('data: {"choices":[]}' + chr(10) * 2)} || array_to_string(list_transform({_W}, lambda w:
      {lit('data: {"error":null,"choices":[{"delta":' + chr(10) + 'data: {"content":"')} || w || {lit(' "}}]}' + chr(10) * 2)}), '')
      || {lit("data:[DONE]" + chr(10) * 2)}
END)"""

REPLIES = f"""
rw AS (SELECT doc_id, text, regexp_extract_all(text, '{fx.REPLY_WORD}', 0) AS words FROM documents),
replies AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS request_id, CAST(1 AS BIGINT) AS attempt, CAST(200 AS INTEGER) AS http_status,
    'application/json' AS content_type, '{{"choices":[{{"message":{{"content":"retry ' || CAST(doc_id AS VARCHAR) || '"}}}}]}}' AS body
  FROM documents WHERE doc_id % 13 = 0
  UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS request_id, CAST(0 AS BIGINT) AS attempt,
    CAST(CASE WHEN doc_id % 17 = 3 THEN NULL WHEN doc_id % 5 = 3 THEN (CASE WHEN doc_id % 2 = 0 THEN 429 ELSE 502 END) ELSE 200 END
      AS INTEGER) AS http_status,
    CASE doc_id % 5 WHEN 1 THEN 'Text/Event-Stream; charset=utf-8' WHEN 2 THEN 'application/json; charset=utf-8'
         WHEN 4 THEN 'text/html' ELSE 'application/json' END AS content_type,
    CASE WHEN doc_id % 19 <> 6 THEN CASE doc_id % 5
      WHEN 0 THEN CASE WHEN doc_id % 3 = 2 THEN '{{"Choices": [{{"MESSAGE":{{"Content" :" ' || array_to_string(words, ' ') || ' "}}}}]}}'
             ELSE '{{"id":"r' || CAST(doc_id AS VARCHAR) || '","choices":[{{"index":0,"message":{{"role":"assistant","content":" '
                  || array_to_string(words, ' ') || ' "}}}}]}}' || CASE WHEN doc_id % 4 = 1 THEN ' and more' ELSE '' END END
      WHEN 1 THEN {SSE_BODY}
      WHEN 2 THEN (CASE WHEN doc_id % 6 = 0 THEN '{{"choices":[{{"message":{{"content":"x"}}}},{{"message":{{"content":5}}}}]}}'
                   ELSE CASE doc_id % 3 WHEN 0 THEN '{{"choices":[]}}'
                   WHEN 1 THEN '{{"choices":[{{"message":{{"content":"  "}}}}]}}'
                   ELSE '{{"choices":[{{"message":{{"content":' || CAST(len(words) AS VARCHAR) || '}}}}]}}' END END)
      WHEN 3 THEN (CASE WHEN doc_id % 3 <> 0 AND doc_id % 8 = 0 THEN '{{"Error":{{"Message":"case"}}}}'
                   ELSE CASE doc_id % 3 WHEN 0 THEN '{{"error":{{"message":"  quota exceeded: ' || coalesce(words[1], '') || '  "}}}}'
                   WHEN 1 THEN text ELSE '{{"error":{{"message":""}}}}' END END)
      ELSE '<html>' || array_to_string(words, ' ') || '</html>' END END AS body
  FROM rw WHERE doc_id % 11 <> 4
)"""
# the last attempt of each request, with an empty body for none
def any_case(body: str) -> str:
    """The names that replies are read by, in lower case."""
    for key in ("choices", "message", "content", "delta", "error"):
        body = f"""regexp_replace({body}, '"(?i:{key})"(\\s*:)', '"{key}"\\1', 'g')"""
    return body


LANDED = f"""
landed AS (
  SELECT request_id, attempt, http_status, content_type, {any_case("coalesce(body, '')")} AS body FROM replies
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC) = 1
)"""


def landed(where: str) -> str:
    """The last attempt among the replies that a query looks at."""
    body = any_case("coalesce(body, '')")
    return (f"landed AS (SELECT request_id, attempt, http_status, content_type, {body} AS body FROM replies "
            f"WHERE {where} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC) = 1)")


_STREAM = "http_status BETWEEN 200 AND 299 AND contains(lower(content_type), 'text/event-stream')"
_JSON = "http_status BETWEEN 200 AND 299 AND NOT contains(lower(content_type), 'text/event-stream')"
_ERROR = "(http_status < 200 OR http_status >= 300)"


def _kind(x: str, path: str) -> str:
    return f"coalesce(json_type({x}, '{path}'), 'MISSING')"


def _absent(k: str) -> str:
    return f"({k} IN ('MISSING', 'NULL'))"


def _obj_or_absent(x, path):
    k = _kind(x, path)
    return f"({_absent(k)} OR {k} = 'OBJECT')"


def _str_or_absent(x, path):
    k = _kind(x, path)
    return f"({_absent(k)} OR {k} = 'VARCHAR')"


def _s(x, path):
    return f"coalesce(json_extract_string({x}, '{path}'), '')"


def completion_cols(raw: str = "body") -> str:
    body = f"(CASE WHEN json_valid({raw}) THEN {raw} END)"
    ok = (f"(json_valid({raw}) AND {_obj_or_absent(body, '$')} AND "
          f"({_absent(_kind(body, '$.choices'))} OR {_kind(body, '$.choices')} = 'ARRAY') AND "
          f"{_obj_or_absent(body, '$.choices[0]')} AND {_obj_or_absent(body, '$.choices[0].message')} AND "
          f"{_str_or_absent(body, '$.choices[0].message.content')} AND {_obj_or_absent(body, '$.choices[1]')} AND "
          f"{_obj_or_absent(body, '$.choices[1].message')} AND {_str_or_absent(body, '$.choices[1].message.content')})")
    content = trim(f"CASE WHEN {ok} THEN {_s(body, '$.choices[0].message.content')} ELSE '' END")
    status = f"(CASE WHEN NOT {ok} THEN 'PARSE_ERROR' WHEN {content} = '' THEN 'NO_TRANSLATION' ELSE 'OK' END)"
    return status, content


def _norm_lines(body: str) -> str:
    return f"regexp_replace(regexp_replace({body}, '\\r{{1,2}}(\\n)', '\\1', 'g'), '\\r{{1,2}}\\z', '')"


SSE_FOLD = f"""
sse_rows AS (
  SELECT request_id, string_split({_norm_lines("body")}, chr(10) || chr(10)) AS evs FROM landed WHERE {_STREAM}
),
sse_ev AS (
  SELECT request_id, ev, CASE WHEN len(dl) > 0 THEN array_to_string(
      list_transform(dl, lambda l: regexp_replace(substring(l, 6), '^ ', '')), chr(10)) END AS data
  FROM (SELECT request_id, ev, list_filter(string_split(evt, chr(10)), lambda l: starts_with(l, 'data:')) AS dl
        FROM (SELECT request_id, generate_subscripts(evs, 1) - 1 AS ev, unnest(evs) AS evt FROM sse_rows) u) x
),
sse_k AS (
  SELECT request_id, ev, kind,
    CASE WHEN kind = 'STREAM_ERROR' THEN {lit(K.MSG_STREAM_ERROR)} ||
           (CASE WHEN msg = '' THEN {lit(K.MSG_UNKNOWN_ERROR)} ELSE msg END)
         WHEN kind = 'PARSE_ERROR' THEN {lit(K.MSG_STREAM_PARSE_ERROR)}
         WHEN kind = 'DELTA' THEN (CASE WHEN dc <> '' THEN dc ELSE mc END) ELSE '' END AS text
  FROM (
    SELECT request_id, ev,
      CASE WHEN data IS NULL OR d0 = '' THEN 'SKIP' WHEN d0 = '[DONE]' THEN 'DONE'
           WHEN NOT (d IS NOT NULL AND {_obj_or_absent("d", "$")}
                     AND ({_absent(_kind("d", "$.error"))} OR {_kind("d", "$.error")} = 'OBJECT')
                     AND {_str_or_absent("d", "$.error.message")}
                     AND ({_absent(_kind("d", "$.choices"))} OR {_kind("d", "$.choices")} = 'ARRAY')
                     AND {_obj_or_absent("d", "$.choices[0]")} AND {_obj_or_absent("d", "$.choices[0].delta")}
                     AND {_obj_or_absent("d", "$.choices[0].message")}
                     AND {_str_or_absent("d", "$.choices[0].delta.content")}
                     AND {_str_or_absent("d", "$.choices[0].message.content")}) THEN 'PARSE_ERROR'
           WHEN NOT {_absent(_kind("d", "$.error"))} THEN 'STREAM_ERROR' ELSE 'DELTA' END AS kind,
      {trim(_s("d", "$.error.message"))} AS msg,
      {_s("d", "$.choices[0].delta.content")} AS dc, {_s("d", "$.choices[0].message.content")} AS mc
    FROM (SELECT *, CASE WHEN json_valid(d0) THEN d0 END AS d FROM (SELECT *, {trim("data")} AS d0 FROM sse_ev) y0) y
  ) z
),
sse_done AS (SELECT request_id, coalesce(min(ev) FILTER (WHERE kind = 'DONE'), 9223372036854775807) AS done_at
             FROM sse_k GROUP BY request_id),
sse_fold AS (
  SELECT k.request_id,
    arg_min(k.kind, k.ev) FILTER (WHERE k.kind IN ('PARSE_ERROR', 'STREAM_ERROR') AND k.ev < d.done_at) AS fail_kind,
    arg_min(k.text, k.ev) FILTER (WHERE k.kind IN ('PARSE_ERROR', 'STREAM_ERROR') AND k.ev < d.done_at) AS fail_text,
    {trim("coalesce(string_agg(k.text, '' ORDER BY k.ev) FILTER (WHERE k.kind = 'DELTA' AND k.ev < d.done_at), '')")}
      AS txt
  FROM sse_k k JOIN sse_done d USING (request_id) GROUP BY k.request_id
),
sse_text AS (
  SELECT request_id,
    CASE WHEN fail_kind IS NOT NULL THEN fail_kind WHEN txt = '' THEN 'NO_TRANSLATION' ELSE 'OK' END AS status,
    CASE WHEN fail_kind IS NULL AND txt <> '' THEN txt ELSE '' END AS text,
    coalesce(fail_text, CASE WHEN txt = '' THEN {lit(K.MSG_NO_TRANSLATION)} END, '') AS error
  FROM sse_fold
)"""


def _http_message(body: str) -> str:
    """C4 message before the byte cut: error.message trimmed, else the body trimmed."""
    g = f"(CASE WHEN json_valid({body}) THEN {body} END)"
    j = (f"(CASE WHEN {_kind(g, '$.error.message')} = 'VARCHAR' "
         f"THEN {trim(_s(g, '$.error.message'))} ELSE '' END)")
    return f"(CASE WHEN {j} = '' THEN {trim(body)} ELSE {j} END)"


def _byte_cut(m: str, n: int = K.ERROR_BYTES) -> str:
    """First ``n`` UTF-8 bytes; a code point cut in two becomes one U+FFFD."""
    p = f"left({m}, {n})"
    k = f"len(list_filter(range(1, length({p}) + 1), lambda i: strlen(left({p}, i)) <= {n}))"
    return (f"(CASE WHEN strlen({m}) <= {n} THEN {m} ELSE left({p}, {k}) || "
            f"(CASE WHEN strlen(left({p}, {k})) < {n} THEN chr(65533) ELSE '' END) END)")


_CS, _CT = completion_cols("body")
DECODED = f"""
{LANDED},{SSE_FOLD},
decoded AS (
  SELECT r.request_id, r.attempt, r.http_status,
    CASE WHEN r.http_status IS NULL THEN 'none' WHEN r.http_status < 200 OR r.http_status >= 300 THEN 'error'
         WHEN contains(lower(r.content_type), 'text/event-stream') THEN 'stream' ELSE 'json' END AS route,
    CASE WHEN r.http_status IS NULL THEN 'NO_STATUS' WHEN r.http_status < 200 OR r.http_status >= 300 THEN 'HTTP_ERROR'
         WHEN contains(lower(r.content_type), 'text/event-stream') THEN s.status ELSE {_CS} END AS status,
    CASE WHEN r.http_status IS NULL OR r.http_status < 200 OR r.http_status >= 300 THEN ''
         WHEN contains(lower(r.content_type), 'text/event-stream') THEN s.text
         WHEN {_CS} = 'OK' THEN {_CT} ELSE '' END AS text,
    CASE WHEN r.http_status IS NULL THEN {lit(K.MSG_NO_REPLY_STATUS)}
         WHEN r.http_status < 200 OR r.http_status >= 300 THEN {lit(K.MSG_HTTP_ERROR_HEAD)} ||
           CAST(r.http_status AS VARCHAR) || {lit(K.MSG_HTTP_ERROR_MID)} || r.cut
         WHEN contains(lower(r.content_type), 'text/event-stream') THEN s.error
         WHEN {_CS} = 'PARSE_ERROR' THEN {lit(K.MSG_PARSE_ERROR)}
         WHEN {_CS} = 'NO_TRANSLATION' THEN {lit(K.MSG_NO_TRANSLATION)} ELSE '' END AS error,
    CASE WHEN r.http_status < 200 OR r.http_status >= 300 THEN {lit(K.MSG_HTTP_ERROR_HEAD)} ||
           CAST(r.http_status AS VARCHAR) || {lit(K.MSG_HTTP_ERROR_MID)} || r.hm END AS whole
  FROM (SELECT *, {_byte_cut("hm")} AS cut FROM (SELECT *, {_http_message("body")} AS hm FROM landed) r0) r
  LEFT JOIN sse_text s USING (request_id)
)"""

ALL_RESULTS = f"""
{BASE},{MEMORY},{LOCAL_PARTS},{REASSEMBLED},{REPLIES},{DECODED},
all_results AS (
  SELECT request_id, provider, model, status, '' AS text, {_row_message()} AS error, raw_source, raw_target, n_chars
    FROM resolved WHERE status NOT IN ('DIRECT', 'READY')
  UNION ALL
  SELECT request_id, 'direct', {lit(K.DIRECT_MODEL)}, status, {trim("text")}, '', raw_source, raw_target, n_chars
    FROM resolved WHERE status = 'DIRECT'
  UNION ALL
  SELECT request_id, 'local', model, CASE WHEN error = '' THEN 'OK' ELSE 'FAILED' END, done, error, raw_source, raw_target, n_chars FROM reassembled
  UNION ALL
  SELECT r.request_id, 'llm', r.model, coalesce(d.status, 'NO_REPLY'), coalesce(d.text, ''),
         CASE WHEN d.status IS NULL THEN {lit(K.MSG_NO_TRANSLATION)} ELSE d.error END,
         raw_source, raw_target, n_chars
    FROM resolved r LEFT JOIN decoded d USING (request_id) WHERE r.status = 'READY' AND r.provider = 'llm'
)"""

# HTTP error rows need the byte cut only for the message of error replies; the
# decoded error text of HTTP_ERROR rows is compared through the all_results
# query below only for routes other than 'error'.


def _progress_log() -> str:
    named = ("event_type || '.safetensors: ' || CAST(p AS VARCHAR) || '%|' || repeat('█', p // 25) || ' | ' "
             "|| CAST(p AS VARCHAR) || 'M/100M'")
    esc = "chr(27)"
    return f"""
plog AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS log_id,
    CASE user_id % 3 WHEN 0 THEN {lit(K.DEFAULT_LOCAL_MODEL)} WHEN 1 THEN {lit(K.DEFAULT_NLLB_MODEL)}
         ELSE 'acme/custom-mt:v2' END AS model,
    event_id AS n,
    CASE event_id % 9
      WHEN 0 THEN {named}
      WHEN 1 THEN {esc} || '[2K' || {esc} || '[1G' || {named}
      WHEN 2 THEN '  '
      WHEN 3 THEN 'Downloading: ' || CAST(p AS VARCHAR) || '%'
      WHEN 4 THEN 'Fetching 3 files: 100%|██████████| 3/3'
      WHEN 5 THEN 'config.json: 999%|'
      WHEN 6 THEN 'warning: retrying ' || event_type
      WHEN 7 THEN repeat('x', 190) || ' ' || CAST(p AS VARCHAR) || '%'
      ELSE {esc} || '[33mUserWarning: ' || props || {esc} || '[0m' END AS line
  FROM (SELECT *, CAST((CAST(floor(value) AS BIGINT) % 5) * 25 AS INTEGER) AS p FROM events) e
)"""


NAMED = K.PROGRESS_NAMED.replace("(?d)", "")
PARSED = f"""
{_progress_log()},
pclean AS (SELECT log_id, model, n, {trim(f"regexp_replace(line, '{K.ANSI_ESCAPE}', '', 'g')")} AS rec FROM plog),
pm AS (
  SELECT log_id, model, n, rec,
    regexp_matches(rec, '{NAMED}') AS nh, try_cast(regexp_extract(rec, '{NAMED}', 2) AS INTEGER) AS np,
    {shorten(trim(f"regexp_extract(rec, '{NAMED}', 1)"), K.PROGRESS_NAME_CHARS)} AS nm,
    regexp_matches(rec, '{K.PROGRESS_BARE}') AS bh, try_cast(regexp_extract(rec, '{K.PROGRESS_BARE}', 1) AS INTEGER) AS bp
  FROM pclean WHERE rec <> ''
),
parsed AS (
  SELECT log_id, model, n,
    CAST(CASE WHEN nh AND np BETWEEN 0 AND 100 THEN np WHEN NOT nh AND bh AND bp BETWEEN 0 AND 100 THEN bp ELSE -1 END
         AS BIGINT) AS percent,
    CASE WHEN nh AND np BETWEEN 0 AND 100
           THEN {lit(K.PROGRESS_NAMED_HEAD)} || nm || {lit(K.PROGRESS_FILE_MID)} || CAST(np AS VARCHAR) || '%'
         WHEN NOT nh AND bh AND bp BETWEEN 0 AND 100
           THEN {lit(K.PROGRESS_BARE_HEAD + K.PROGRESS_FILE_MID)} || CAST(bp AS VARCHAR) || '%'
         ELSE {shorten("rec", K.PROGRESS_MESSAGE_CHARS)} END AS message, rec AS record
  FROM pm
),
changed AS (
  SELECT log_id, model, n, percent, message, record FROM (
    SELECT *, lag(CAST(percent AS VARCHAR) || ':' || message) OVER (PARTITION BY log_id ORDER BY n) AS pk FROM parsed) q
  WHERE pk IS NULL OR pk <> CAST(percent AS VARCHAR) || ':' || message
)"""

FEED = """
feed AS (
  SELECT user_id AS device, event_id AS poll, seq,
    CASE WHEN event_id % 17 = 3 THEN seq + 1 ELSE seq END AS seq_after,
    event_id % 11 <> 5 AS read_ok,
    CASE WHEN event_type = 'purchase' THEN 'self' ELSE 'user' END AS origin,
    CASE WHEN event_id % 19 = 2 THEN ' ' || chr(9) || ' ' ELSE event_type || ' ' || props END AS text
  FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(floor(value / 5) AS BIGINT) END AS seq FROM events) e
)"""

CHANGES = f"""
{FEED},
f1 AS (SELECT *, lag(poll) OVER (PARTITION BY device ORDER BY poll) IS NULL AS is_first FROM feed),
f2 AS (SELECT * FROM f1 WHERE is_first OR (seq <> 0 AND read_ok AND seq_after = seq)),
f3 AS (SELECT *, lag(seq) OVER (PARTITION BY device ORDER BY poll) AS prev_seq FROM f2),
fired AS (SELECT device, poll, seq, text FROM f3
          WHERE NOT is_first AND seq <> prev_seq AND origin <> 'self' AND {trim("text")} <> '')"""


def _audit_rows() -> str:
    return f"""
{ALL_RESULTS},
audit_rows AS (
  SELECT request_id, provider, model, raw_source AS source, raw_target AS target, n_chars, status, error FROM all_results
)"""


def _q() -> dict[str, str]:
    ids = "list_transform(string_split(chunk, ' '), lambda w: length(w))"
    chunk_rows = f"""
cp AS (SELECT request_id, unnest({parts("text")}) AS part, generate_subscripts({parts("text")}, 1) - 1 AS part_no
       FROM requests),
ck AS (SELECT request_id, part_no, {chunks(words("part"))} AS cs FROM cp WHERE NOT starts_with(part, chr(10))),
ck2 AS (SELECT request_id, part_no, generate_subscripts(cs, 1) - 1 AS chunk_no, unnest(cs) AS toks FROM ck),
chunks AS (SELECT request_id, part_no, chunk_no, array_to_string(toks, ' ') AS chunk, len(toks) AS n_tokens FROM ck2)"""
    q: dict[str, str] = {}

    q["requests_from_documents"] = f"WITH {REQUESTS} SELECT * FROM requests"
    q["request_lines"] = f"""
SELECT CASE WHEN m IN (3, 5, 9, 11) THEN '' WHEN m = 15 THEN CAST(doc_id AS VARCHAR) ELSE 'd' || CAST(doc_id AS VARCHAR) END AS request_id,
  '' AS tenant, CASE WHEN bad THEN '' ELSE coalesce(text, '') END AS text,
  CASE WHEN bad OR m = 15 THEN 'en' ELSE coalesce(lang, 'en') END AS source,
  CASE WHEN bad OR m = 15 OR doc_id % 2 = 0 THEN 'zh' ELSE 'ja' END AS target, CASE WHEN bad THEN {lit(K.MSG_BAD_REQUEST)} END AS error
FROM (SELECT *, doc_id % 17 AS m, doc_id % 17 IN (3, 7, 9, 11) AS bad FROM documents) d WHERE m <> 13"""
    q["poll_lines"] = f"""
WITH {FEED.lstrip().removeprefix("WITH ")},
p AS (SELECT feed.*, epoch_us(events.ts) // 1000 AS ms, poll % 23 AS m, CASE WHEN poll % 23 = 6 THEN 'device is no number' WHEN poll % 23 IN (1, 4)
    THEN 'poll is no JSON object' WHEN poll % 23 = 2 THEN 'poll without number or counter' END AS error
  FROM feed JOIN events ON events.event_id = feed.poll WHERE poll % 23 <> 5)
SELECT CASE WHEN m <> 6 THEN device END AS device, error, CASE WHEN error IS NULL THEN poll END AS poll, CASE WHEN error IS NULL THEN seq END AS seq,
  CASE WHEN error IS NULL THEN (CASE WHEN m = 3 THEN seq ELSE seq_after END) END AS seq_after,
  CASE WHEN error IS NULL THEN m <> 3 AND read_ok END AS read_ok, CASE WHEN error IS NULL THEN origin END AS origin,
  CASE WHEN error IS NULL THEN text END AS text, CASE WHEN error IS NULL THEN ms END AS ts_ms FROM p"""
    q["requests_from_conversations"] = (
        "SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id, role AS tenant, text, "
        "'en' AS source, 'zh' AS target FROM conversations")
    q["response_rows"] = (f"{ALL_RESULTS} SELECT request_id AS id, CASE WHEN error = '' THEN text ELSE '' END AS text, "
                          "error FROM all_results")
    q["log_records"] = """
WITH b AS (
  SELECT event_id AS log_id, event_type || '.safetensors: ' || CAST(p AS VARCHAR) || '%|x' || chr(13) || event_type
    || '.safetensors: ' || CAST(p + 1 AS VARCHAR) || '%|x'
    || CASE event_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(10) ELSE chr(13) END
    || 'warning ' || event_type
    || CASE event_id % 4 WHEN 0 THEN chr(10) || 'finished' WHEN 1 THEN chr(10)
            WHEN 2 THEN chr(13) || chr(10) || chr(13) || chr(10) || 'finished' ELSE '' END AS blob
  FROM (SELECT *, CAST((CAST(floor(value) AS BIGINT) % 5) * 25 AS INTEGER) AS p FROM events) e
),
s AS (SELECT log_id, regexp_split_to_array(blob, '\\r\\n|\\r|\\n') AS a FROM b),
r AS (SELECT log_id, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS recs FROM s)
SELECT log_id, generate_subscripts(recs, 1) - 1 AS n, unnest(recs) AS record FROM r"""
    q["trim_text"] = f"WITH {REQUESTS} SELECT request_id, {trim('text')} AS trimmed, length({trim('text')}) AS n_chars FROM requests"
    q["admission"] = f"WITH {REQUESTS},{ADMITTED} SELECT request_id, tenant, source, target, n_chars, over_limit, status FROM adm"
    q["direct_results"] = (f"WITH {REQUESTS},{ADMITTED} SELECT request_id, {trim('text')} AS text, 'direct' AS provider, "
                           f"{lit(K.DIRECT_MODEL)} AS model FROM adm WHERE status = 'DIRECT'")
    q["settings_normalise"] = f"WITH {SETTINGS},{NORMALIZED} SELECT * FROM ns"
    q["fill_languages"] = f"{BASE} SELECT request_id, tenant, status, source, target FROM filled"
    q["routing"] = f"{BASE} SELECT request_id, provider, model FROM resolved"
    q["capability"] = (f"{BASE} SELECT request_id, provider, model, source, target, status, "
                       f"{_row_message()} AS message FROM resolved")
    q["language_lookup"] = f"""{BASE}, langs AS (SELECT * FROM (VALUES {LANG_VALUES}) l(code, name_zh, nllb_code))
SELECT r.request_id, r.source, r.target, coalesce(s.name_zh, r.source) AS source_name,
  coalesce(t.name_zh, r.target) AS target_name, s.nllb_code AS source_nllb, t.nllb_code AS target_nllb
FROM resolved r LEFT JOIN langs s ON r.source = s.code LEFT JOIN langs t ON r.target = t.code"""
    models = ", ".join(f"({lit(m)}, {lit(n)}, {lit(sz)}, {str(d).lower()})" for m, n, _, sz, d in K.MODELS)
    q["model_catalog"] = f"""WITH {SETTINGS},{PER_TENANT}
SELECT ns.tenant, m.model, m.name, m.size, {safe("m.model")} || '.ready' IN ({READY_MARKERS}) AS downloaded,
  ns.local_model = m.model AS selected, m.is_default
FROM ts AS ns CROSS JOIN (VALUES {models}) m(model, name, size, is_default)"""
    q["result_meta"] = f"""{ALL_RESULTS},
dw AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS request_id, generate_subscripts(w, 1) - 1 AS seq, unnest(w) AS word
       FROM (SELECT doc_id, regexp_extract_all(text, '{fx.REPLY_WORD}', 0) AS w FROM documents) x),
dl AS (SELECT request_id, max(seq * 12 + length(word) % 10) AS elapsed_ms FROM dw GROUP BY 1),
m AS (SELECT a.*, coalesce(dl.elapsed_ms, 0) AS ms FROM all_results a LEFT JOIN dl USING (request_id)
      WHERE a.status IN ('OK', 'DIRECT'))
SELECT request_id,
  CASE WHEN provider = 'local' THEN {lit(K.PROVIDER_LABEL_LOCAL)} WHEN provider = 'llm' THEN {lit(K.PROVIDER_LABEL_LLM)}
       ELSE {lit(K.PROVIDER_LABEL_OTHER)} END AS label,
  CAST((ms + 50) // 100 // 10 AS VARCHAR) || '.' || CAST((ms + 50) // 100 % 10 AS VARCHAR) || 's' AS elapsed,
  model AS done_by
FROM m"""
    q["shorten_tail"] = f"SELECT doc_id, {shorten('text', 180)} AS short, {tail('text', 120)} AS tail FROM documents"
    q["safe_name"] = f"WITH {SETTINGS},{NORMALIZED} SELECT tenant, local_model, {safe('local_model')} AS safe FROM ns"
    q["html_escape"] = ("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
                        "'\"', '&quot;') AS escaped FROM pages")
    q["endpoint"] = f"SELECT page_id, {endpoint('url')} AS endpoint FROM pages"
    q["paragraphs"] = f"""WITH {REQUESTS}
SELECT request_id, part_no, part, starts_with(part, chr(10)) AS is_sep FROM (
  SELECT request_id, generate_subscripts({parts("text")}, 1) - 1 AS part_no, unnest({parts("text")}) AS part
  FROM requests) x"""
    q["token_chunks"] = f"WITH {REQUESTS},{chunk_rows} SELECT request_id, part_no, chunk_no, n_tokens, chunk FROM chunks"
    q["token_budget"] = f"""WITH {REQUESTS},{chunk_rows}
SELECT request_id, part_no, chunk_no, greatest(1, least(n_tokens, {K.MODEL_INPUT_CAP})) AS source_tokens,
  least({K.OUTPUT_CAP}, greatest({K.OUTPUT_FLOOR}, 4 * greatest(1, least(n_tokens, {K.MODEL_INPUT_CAP})) + 16))
    AS max_new_tokens FROM chunks"""
    strip = f"""
  (SELECT CASE WHEN f IS NULL THEN [] ELSE ids[f : len(ids) + 1 - list_position(list_reverse(c), true)] END
   FROM (SELECT list_transform(ids, lambda x: NOT list_contains([1, 2], x)) AS c,
                list_position(list_transform(ids, lambda x: NOT list_contains([1, 2], x)), true) AS f))"""
    q["strip_special"] = f"""WITH {REQUESTS},{chunk_rows},
w AS (SELECT request_id, part_no, chunk_no, {ids} AS ids FROM chunks),
s AS (SELECT request_id, part_no, chunk_no, {strip} AS out FROM w)
SELECT request_id, part_no, chunk_no, len(out) AS n_ids, array_to_string(out, ',') AS ids FROM s"""
    periodic = "len(list_filter(range(n - 2 * p + 1, n + 1), lambda i: ids[i] <> ids[i - p])) = 0"
    q["repetition_collapse"] = f"""WITH {REQUESTS},{chunk_rows},
w AS (SELECT request_id, part_no, chunk_no, {ids} AS ids FROM chunks),
c AS (SELECT *, len(ids) AS n FROM w),
p AS (SELECT *, list_filter(range(1, greatest(1, n // 3) + 1), lambda p: p * 3 <= n AND {periodic}) AS cands FROM c),
r AS (SELECT *, cands[1] AS p FROM p),
b AS (SELECT *, coalesce(list_max(list_filter(range(p + 1, n + 1), lambda i: ids[i] <> ids[i - p])), p) AS last_bad
      FROM r),
o AS (SELECT *, CASE WHEN n >= 4 AND len(cands) > 0
                 THEN list_concat(ids[1 : greatest(n - ((n - last_bad) // p + 1) * p, 0)], ids[n - p + 1 : n])
                 ELSE ids END AS out FROM b)
SELECT request_id, part_no, chunk_no, n AS n_in, len(out) AS n_out, array_to_string(out, ',') AS ids FROM o"""
    q["unique_segments"] = f"{BASE},{LOCAL_PARTS} SELECT * FROM uniq"
    q["tm_hits"] = f"{BASE},{MEMORY},{LOCAL_PARTS} SELECT u.*, m.translation FROM uniq u JOIN mem m USING (source, target, model, segment)"
    q["tm_misses"] = f"{BASE},{MEMORY},{LOCAL_PARTS} SELECT u.* FROM uniq u ANTI JOIN mem m USING (source, target, model, segment)"
    q["translate_pseudo"] = f"""{BASE},{MEMORY},{LOCAL_PARTS}
SELECT source, target, model, segment, CASE WHEN {refused("segment")} THEN '' ELSE {pseudo("segment", "target")} END AS translation,
  CASE WHEN {refused("segment")} THEN {lit(K.MSG_PSEUDO_REFUSED)} ELSE '' END AS error
FROM (SELECT u.* FROM uniq u ANTI JOIN mem m USING (source, target, model, segment)) x"""
    q["reassembled"] = f"{BASE},{MEMORY},{LOCAL_PARTS},{REASSEMBLED} SELECT request_id, model, done AS text, error FROM reassembled"
    q["error_message"] = f"""WITH {REPLIES.lstrip()},{landed(_ERROR)},
e AS (SELECT *, {_http_message("body")} AS hm FROM landed),
c AS (SELECT *, {_byte_cut("hm")} AS cut FROM e)
SELECT request_id, CAST(http_status AS BIGINT) AS http_status,
  regexp_replace({lit(K.MSG_HTTP_ERROR_HEAD)} || CAST(http_status AS VARCHAR) || {lit(K.MSG_HTTP_ERROR_MID)} || cut,
                 '(?i)^Error:\\s*', '') AS error
FROM c"""
    back_text = trim("string_agg(CASE WHEN starts_with(part, chr(10)) THEN part ELSE " + pseudo("part", "target")
                     + " END, '' ORDER BY part_no)")
    q["round_trip"] = f"""{BASE},mem AS (SELECT '' AS source, '' AS target, '' AS model, '' AS segment, '' AS translation WHERE false),
{LOCAL_PARTS},{REASSEMBLED},
fw AS (SELECT rid, request_id, tenant, text AS original, target AS source, source AS target, model, done AS forward,
              error AS fwd_error FROM reassembled),
judged AS (SELECT fw.*, CASE WHEN fwd_error <> '' THEN fwd_error
    WHEN forward = '' THEN {lit(K.MSG_EMPTY)} WHEN source = target THEN ''
    WHEN model = {lit(K.DEFAULT_LOCAL_MODEL)} AND (source <> 'en' OR target <> 'zh') THEN {lit(K.MSG_PAIR_UNSUPPORTED)}
    WHEN lower(model) LIKE '%nllb%' AND NOT (source IN ({LANG_CODES}) AND target IN ({LANG_CODES})) THEN {lit(K.MSG_LANG_UNMAPPED)}
    ELSE '' END AS error FROM fw),
bp AS (SELECT rid, target, unnest({parts("forward")}) AS part, generate_subscripts({parts("forward")}, 1) AS part_no
       FROM judged WHERE error = ''),
bk AS (SELECT rid, {back_text} AS back FROM bp GROUP BY rid)
SELECT j.request_id, j.original, j.forward, coalesce(bk.back, '') AS back, j.error
FROM judged j LEFT JOIN bk USING (rid)"""
    q["all_results"] = f"{ALL_RESULTS} SELECT request_id, provider, model, status, text, error FROM all_results"
    q["llm_payload"] = f"""{BASE}, langs AS (SELECT * FROM (VALUES {LANG_VALUES}) l(code, name_zh, nllb_code))
SELECT r.request_id, {endpoint("r.llm_base_url")} AS endpoint, r.model,
  {lit(K.SYSTEM_PROMPT)} AS system_prompt,
  {lit(K.USER_PROMPT_HEAD)} || coalesce(s.name_zh, r.source) || {lit(K.USER_PROMPT_MID)} || coalesce(t.name_zh, r.target)
    || {lit(K.USER_PROMPT_TAIL)} || r.text AS user_prompt,
  CAST(0 AS BIGINT) AS temperature, true AS stream
FROM resolved r LEFT JOIN langs s ON r.source = s.code LEFT JOIN langs t ON r.target = t.code
WHERE r.status = 'READY' AND r.provider = 'llm'"""
    q["reply_correlation"] = f"""{BASE},{REPLIES}
SELECT r.request_id, r.model, CAST(p.http_status AS BIGINT) AS http_status, p.content_type, p.attempt FROM resolved r JOIN replies p USING (request_id)
WHERE r.status = 'READY' AND r.provider = 'llm'"""
    q["completion_decode"] = f"""WITH {REPLIES.lstrip().lstrip(",")},{landed(_JSON)}
SELECT request_id, {_CS} AS status, CASE WHEN {_CS} = 'OK' THEN {_CT} ELSE '' END AS text FROM landed"""
    every_stream = SSE_FOLD.replace(f"FROM landed WHERE {_STREAM}", "FROM (SELECT request_id, coalesce(body, '') AS body FROM replies "
                                    "WHERE contains(lower(content_type), 'text/event-stream')) e")
    q["sse_events"] = f"""WITH {REPLIES.lstrip()},{every_stream} SELECT request_id, ev, data FROM sse_ev WHERE data IS NOT NULL"""
    q["sse_text"] = f"WITH {REPLIES.lstrip()},{landed(_STREAM)},{SSE_FOLD} SELECT * FROM sse_text"
    q["reply_dispatch"] = f"""WITH {REPLIES.lstrip()},{DECODED}
SELECT request_id, attempt, CAST(http_status AS BIGINT) AS http_status, route, status, text, error,
  coalesce(whole, error) AS error_full FROM decoded"""
    q["reply_guard"] = f"""WITH {REPLIES.lstrip().replace("replies AS (", "replies0 AS (", 1)},
replies AS (SELECT request_id, content_type, coalesce(body, '') AS body FROM replies0)
SELECT request_id, CAST(octet_length(encode(body)) AS BIGINT) AS body_bytes,
  CASE WHEN (CASE WHEN contains(lower(content_type), 'text/event-stream')
                  THEN coalesce(list_max(list_transform(string_split(body, chr(10)), lambda l: octet_length(encode(l)))), 0)
                       > 8192
                  ELSE octet_length(encode(body)) > 8192 END) THEN 'REPLY_TOO_LARGE' ELSE 'OK' END AS guard
FROM replies"""
    q["progress_parse"] = f"WITH {PARSED.lstrip()} SELECT * FROM parsed"
    q["progress_changes"] = f"WITH {PARSED.lstrip()} SELECT * FROM changed"
    q["latest_status"] = f"""WITH {PARSED.lstrip()}
SELECT model, arg_max(log_id, n) AS log_id, max(n) AS updated_n, 'downloading' AS status,
  arg_max(message, n) AS message, arg_max(percent, n) AS progress, arg_max(percent, n) BETWEEN 0 AND 100 AS has_percent
FROM changed GROUP BY model"""
    q["download_outcome"] = f"""WITH {PARSED.lstrip()},
l AS (SELECT log_id, model, arg_max(percent, n) AS lp, arg_max(message, n) AS lm, count(*) AS n_records
      FROM parsed GROUP BY log_id, model),
w AS (SELECT log_id, string_agg(line, chr(10) ORDER BY n) AS whole FROM plog GROUP BY log_id),
f AS (SELECT *, lp = -1 AND regexp_matches(lm, '(?i)error|warning') AS failed FROM l JOIN w USING (log_id))
SELECT log_id, model, CASE WHEN failed THEN 'error' ELSE 'ready' END AS status,
  CASE WHEN failed THEN {lit(K.MSG_DOWNLOAD_FAILED)} || {tail("whole", 1200)} ELSE {lit(K.DOWNLOAD_READY)} END AS message,
  CASE WHEN failed THEN lp ELSE 100 END AS progress, n_records
FROM f"""
    q["stable_input"] = f"""
WITH t AS (
  SELECT user_id, event_id AS n,
    CASE WHEN event_type = 'click' THEN 'manual' WHEN event_type = 'signup' THEN 'feed' ELSE 'auto' END AS trigger,
    'en' AS source, CASE WHEN event_id % 7 = 0 THEN 'ja' ELSE 'zh' END AS target,
    {trim("CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'note ' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END")}
      AS tx
  FROM events),
nb AS (SELECT *, lag(source) OVER w AS ps, lag(target) OVER w AS pt, lag(tx) OVER w AS px
       FROM t WHERE tx <> '' WINDOW w AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, n, trigger,
  CASE WHEN trigger <> 'auto' OR px IS NULL OR NOT (ps = source AND pt = target AND px = tx) THEN 'started'
       ELSE 'skipped' END AS decision FROM nb
UNION ALL SELECT user_id, n, trigger, 'blank' FROM t WHERE tx = ''"""
    q["change_feed_batch"] = f"WITH {CHANGES.lstrip()} SELECT * FROM fired"
    q["latest_wins"] = f"""WITH {CHANGES.lstrip()}
SELECT device, CAST(floor(poll / 100) AS BIGINT) AS batch_no, max(poll) AS poll, {trim("arg_max(text, poll)")} AS text,
  count(*) - 1 AS n_superseded
FROM fired GROUP BY device, CAST(floor(poll / 100) AS BIGINT)"""
    same = lambda s, t, x: f"coalesce(ls = {s} AND lt = {t} AND lx = {x}, false)"
    q["turn_starts"] = f"""
WITH RECURSIVE r AS (
  SELECT user_id, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    CASE WHEN event_id % 3 = 0 THEN 'done' WHEN event_type IN ('signup', 'view') THEN 'feed' ELSE 'typed' END AS kind,
    'en' AS s, CASE WHEN event_id % 13 = 0 THEN 'ja' ELSE 'zh' END AS t,
    CASE WHEN event_id % 11 = 5 THEN '' ELSE 'note ' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END AS x
  FROM events WHERE user_id IS NOT NULL),
st AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, false AS busy, NULL::VARCHAR AS ls, NULL::VARCHAR AS lt, NULL::VARCHAR AS lx,
    NULL::BIGINT AS qn, NULL::VARCHAR AS qx, NULL::BIGINT AS pn, NULL::VARCHAR AS ps, NULL::VARCHAR AS pt, NULL::VARCHAR AS px,
    '' AS box, '' AS cs, '' AS ct, NULL::BIGINT AS asked, NULL::BIGINT AS started, NULL::VARCHAR AS origin FROM r
  UNION ALL
  SELECT user_id, rn,
    CASE WHEN act = 'idle' THEN false WHEN act IN ('feed now', 'typed now', 'feed next', 'typed next') THEN true ELSE busy END,
    CASE act WHEN 'feed now' THEN s WHEN 'typed now' THEN s WHEN 'feed next' THEN cs WHEN 'typed next' THEN ps ELSE ls END,
    CASE act WHEN 'feed now' THEN t WHEN 'typed now' THEN t WHEN 'feed next' THEN ct WHEN 'typed next' THEN pt ELSE lt END,
    CASE act WHEN 'feed now' THEN x WHEN 'typed now' THEN x WHEN 'feed next' THEN qx WHEN 'typed next' THEN px ELSE lx END,
    CASE WHEN act = 'queue' THEN n WHEN act IN ('feed now', 'feed next') THEN NULL ELSE qn END,
    CASE WHEN act = 'queue' THEN x WHEN act IN ('feed now', 'feed next') THEN NULL ELSE qx END,
    CASE WHEN act = 'pend' THEN n WHEN act IN ('typed now', 'typed next', 'idle') THEN NULL ELSE pn END,
    CASE WHEN act = 'pend' THEN s WHEN act IN ('typed now', 'typed next', 'idle') THEN NULL ELSE ps END,
    CASE WHEN act = 'pend' THEN t WHEN act IN ('typed now', 'typed next', 'idle') THEN NULL ELSE pt END,
    CASE WHEN act = 'pend' THEN x WHEN act IN ('typed now', 'typed next', 'idle') THEN NULL ELSE px END,
    CASE WHEN kind = 'typed' OR act = 'feed now' THEN x WHEN act = 'feed next' THEN qx ELSE box END,
    CASE WHEN kind = 'typed' OR (kind = 'feed' AND x <> '') THEN s ELSE cs END,
    CASE WHEN kind = 'typed' OR (kind = 'feed' AND x <> '') THEN t ELSE ct END,
    CASE act WHEN 'feed now' THEN n WHEN 'typed now' THEN n WHEN 'feed next' THEN qn WHEN 'typed next' THEN pn END,
    CASE WHEN act IN ('feed now', 'typed now', 'feed next', 'typed next') THEN n END,
    CASE WHEN act IN ('feed now', 'feed next') THEN 'feed' WHEN act IN ('typed now', 'typed next') THEN 'typed' END
  FROM (SELECT st.*  EXCLUDE (rn, asked, started, origin), r.rn, r.n, r.kind, r.s, r.t, r.x, CASE
      WHEN kind = 'feed' AND x <> '' THEN (CASE WHEN busy THEN 'queue' ELSE 'feed now' END)
      WHEN kind = 'typed' AND x <> '' AND NOT {same("s", "t", "x")} THEN (CASE WHEN busy THEN 'pend' ELSE 'typed now' END)
      WHEN kind = 'done' AND busy THEN (CASE WHEN qx IS NOT NULL THEN 'feed next'
        WHEN coalesce(px = box AND ps = cs AND pt = ct, false) AND NOT {same("ps", "pt", "px")} THEN 'typed next' ELSE 'idle' END)
      ELSE 'none' END AS act
    FROM st JOIN r ON r.user_id = st.user_id AND r.rn = st.rn + 1) z
)
SELECT user_id, asked AS n, started, origin, ls AS source, lt AS target, lx AS text FROM st WHERE started IS NOT NULL"""
    q["delta_batches"] = f"""
WITH w AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS request_id, regexp_extract_all(text, '{fx.REPLY_WORD}', 0) AS ws FROM documents),
d AS (SELECT request_id, ws, list_transform(range(1, len(ws) + 1), lambda i:
        {{'last': (i - 1) * 12 + length(ws[i]) % 10, 'pos': [i]}}) AS steps FROM w WHERE len(ws) > 0),
f AS (SELECT request_id, ws, list_reduce(steps, lambda a, x: CASE WHEN x['last'] - a['last'] >= {K.DELTA_INTERVAL_MS}
        THEN {{'last': x['last'], 'pos': list_concat(a['pos'], x['pos'])}} ELSE a END)['pos'] AS pos FROM d),
e AS (SELECT request_id, ws, CASE WHEN pos[-1] < len(ws) THEN list_concat(pos, [len(ws)]) ELSE pos END AS ends FROM f),
b AS (SELECT request_id, ws, generate_subscripts(ends, 1) - 1 AS batch_no, unnest(ends) AS last_i,
             unnest(list_concat([0], ends)[1 : len(ends)]) AS before FROM e)
SELECT request_id, batch_no, CAST(before AS BIGINT) AS first_seq, CAST(last_i - before AS BIGINT) AS n_deltas,
  array_to_string(ws[before + 1 : last_i], ' ') || ' ' AS text FROM b"""
    q["paired_events"] = f"""
WITH p AS (SELECT user_id, event_type, event_id * 3 AS press, (CAST(floor(value) AS BIGINT) % 7) * 90 AS hold,
                  lead(event_id * 3) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events),
taps AS (SELECT user_id, event_type <> 'click' AS modifier, press,
                press + CASE WHEN nxt IS NULL THEN hold ELSE least(hold, nxt - press - 1) END AS release FROM p),
ev AS (SELECT user_id, press AS t, CASE WHEN modifier THEN 0 ELSE 2 END AS kind FROM taps
       UNION ALL SELECT user_id, release, 1 FROM taps WHERE modifier),
g AS (SELECT user_id, list({{'t': t, 'kind': kind, 'down': NULL::BIGINT, 'chord': false, 'tap': NULL::BIGINT, 'fired': NULL::BIGINT,
        'fires': []::BIGINT[]}} ORDER BY t * 4 + kind) AS es FROM ev GROUP BY user_id),
s AS (SELECT user_id, list_concat([{{'t': NULL::BIGINT, 'kind': 2, 'down': NULL::BIGINT, 'chord': false, 'tap': NULL::BIGINT,
        'fired': NULL::BIGINT, 'fires': []::BIGINT[]}}], es) AS es FROM g),
step AS (SELECT user_id, list_reduce(es, lambda a, x: CASE
   WHEN x['kind'] = 0 THEN {{'t': x['t'], 'kind': 0, 'down': coalesce(a['down'], x['t']), 'chord': a['down'] IS NOT NULL AND a['chord'],
        'tap': a['tap'], 'fired': a['fired'], 'fires': a['fires']}}
   WHEN x['kind'] = 2 THEN {{'t': x['t'], 'kind': 2, 'down': a['down'], 'chord': a['chord'] OR a['down'] IS NOT NULL,
        'tap': NULL::BIGINT, 'fired': a['fired'], 'fires': a['fires']}}
   WHEN a['down'] IS NULL THEN a
   WHEN a['chord'] OR x['t'] - a['down'] > {K.TAP_MAX_HOLD_MS} THEN {{'t': x['t'], 'kind': 1, 'down': NULL::BIGINT, 'chord': false,
        'tap': NULL::BIGINT, 'fired': a['fired'], 'fires': a['fires']}}
   WHEN coalesce(x['t'] - a['tap'] BETWEEN {K.TAP_MIN_GAP_MS} AND {K.TAP_MAX_GAP_MS}, false) THEN
        (CASE WHEN a['fired'] IS NULL OR x['t'] - a['fired'] >= {K.TAP_REFRACTORY_MS}
         THEN {{'t': x['t'], 'kind': 1, 'down': NULL::BIGINT, 'chord': false, 'tap': NULL::BIGINT, 'fired': x['t'],
               'fires': list_append(a['fires'], x['t'])}}
         ELSE {{'t': x['t'], 'kind': 1, 'down': NULL::BIGINT, 'chord': false, 'tap': NULL::BIGINT, 'fired': a['fired'],
               'fires': a['fires']}} END)
   ELSE {{'t': x['t'], 'kind': 1, 'down': NULL::BIGINT, 'chord': false, 'tap': x['t'], 'fired': a['fired'], 'fires': a['fires']}}
   END)['fires'] AS fires FROM s)
SELECT user_id, unnest(fires) AS fire_ms FROM step"""
    q["audit_summary"] = f"""{_audit_rows()}
SELECT provider, model, status, count(*) AS n_requests, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM audit_rows GROUP BY provider, model, status"""
    q["length_profile"] = f"""
SELECT lang, count(*) AS n_docs, CAST(sum(CASE WHEN n > {K.MAX_CHARS} THEN 1 ELSE 0 END) AS BIGINT) AS n_over_limit,
  max(n) AS max_chars, CAST(sum(n) AS BIGINT) AS total_chars, quantile_disc(n, 0.5) AS median_chars
FROM (SELECT lang, length({trim("text")}) AS n FROM documents) d GROUP BY lang"""
    nothing = "'' AS provider, '' AS source, '' AS target, CAST(NULL AS BIGINT) AS characters"
    dl_model = f"CASE WHEN user_id % 2 = 0 THEN {lit(K.DEFAULT_LOCAL_MODEL)} ELSE 'my own model' END"
    q["audit_log_parse"] = f"""{_audit_rows()},
t AS (SELECT * FROM audit_rows WHERE status NOT IN ('REFUSED', 'EMPTY', 'DIRECT', 'SETTINGS_ERROR')),
e AS (SELECT *, CAST((CAST(floor(value) AS BIGINT) % 5) * 25 AS BIGINT) AS p, event_id % 5 AS k FROM events)
SELECT {K.EPOCH_2026_US} + n_chars * 1000 AS at_us, 'translation started' AS event, provider, source, target, CAST(n_chars AS BIGINT) AS characters,
  '' AS model, CAST(NULL AS BIGINT) AS progress, '' AS error, '' AS message, '' AS output FROM t
UNION ALL
SELECT {K.EPOCH_2026_US} + n_chars * 1000 + 1, (CASE WHEN provider = 'llm' THEN 'LLM' ELSE 'local' END) ||
    (CASE WHEN status = 'OK' THEN ' translation completed' ELSE ' translation failed' END), {nothing}, model, NULL,
  CASE WHEN status = 'OK' THEN '' ELSE error END, '', '' FROM t WHERE status <> 'PAIR_UNSUPPORTED'
UNION ALL
SELECT {K.EPOCH_2026_US} + event_id * 7, CASE k WHEN 0 THEN 'model download output' WHEN 1 THEN 'model download stdout' WHEN 2 THEN 'model download failed'
    WHEN 3 THEN 'runtime installer output' ELSE 'runtime preparation failed' END, {nothing}, CASE WHEN k < 3 THEN {dl_model} ELSE '' END,
  CASE WHEN k = 0 THEN p END,
  CASE k WHEN 2 THEN 'exit status 1' || chr(10) || 'last: ' || event_type WHEN 4 THEN event_type || ': no python' ELSE '' END,
  CASE WHEN k = 0 THEN 'at ' || CAST(p AS VARCHAR) || '; model=x error=none' ELSE '' END,
  CASE k WHEN 1 THEN 'first' || chr(10) || chr(10) || '  second; error=2 ' || event_type WHEN 3 THEN event_type || chr(13) || chr(10) || 'done' ELSE '' END
FROM e"""
    return q


def oracle_sql() -> dict[str, str]:
    return _q()
