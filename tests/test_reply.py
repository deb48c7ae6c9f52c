import json

import pytest

from transloom.operators import reply as R

SSE_OK = ('data: {"choices":[{"delta":{"content":"你好"}}]}\n\n'
          'data: {"choices":[{"delta":{"content":"，世界！"}}]}\n\n'
          'data: [DONE]\n\n')
REPLIES = [
    # id, status, content type, body, expected (status, text)
    ("json", 200, "application/json", '{"choices":[{"message":{"content":"你好，世界！"}}]}', ("OK", "你好，世界！")),
    ("sse", 200, "text/event-stream", SSE_OK, ("OK", "你好，世界！")),
    ("sse_crlf", 200, "Text/Event-Stream; charset=utf-8",
     ': c\r\nevent: x\r\ndata: {"choices":[{"delta":{"content":" a"}}]}\r\n\r\ndata: [DONE]\r\n\r\n', ("OK", "a")),
    ("err_mid", 200, "text/event-stream",
     'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"error":{"message":" slow down "}}\n\n',
     ("STREAM_ERROR", "")),
    ("err_after_done", 200, "text/event-stream",
     'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: [DONE]\n\ndata: {"error":{"message":"x"}}\n\n',
     ("OK", "a")),
    ("null_error", 200, "text/event-stream", 'data: {"error":null,"choices":[{"delta":{"content":"b"}}]}', ("OK", "b")),
    ("bad_json", 200, "text/event-stream", 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {oops\n\n',
     ("PARSE_ERROR", "")),
    ("fallback", 200, "text/event-stream", 'data: {"choices":[{"message":{"content":"m"}}]}', ("OK", "m")),
    ("multi_line", 200, "text/event-stream", 'data: {"choices":[{"delta":\ndata: {"content":"q"}}]}\n\n', ("OK", "q")),
    ("only_done", 200, "text/event-stream", "data: [DONE]\n\n", ("NO_TRANSLATION", "")),
    ("no_choices", 200, "application/json", '{"choices":[]}', ("NO_TRANSLATION", "")),
    ("blank", 200, "application/json", '{"choices":[{"message":{"content":"  "}}]}', ("NO_TRANSLATION", "")),
    ("wrong_type", 200, "application/json", '{"choices":[{"message":{"content":5}}]}', ("PARSE_ERROR", "")),
    ("not_json", 200, "text/html", "<html>", ("PARSE_ERROR", "")),
    ("http", 429, "application/json", '{"error":{"message":" quota "}}', ("HTTP_ERROR", "")),
]


def _df(spark):
    return spark.createDataFrame([(i, s, c, b) for i, s, c, b, _ in REPLIES],
                                 "request_id string, http_status int, content_type string, body string")


def test_decode_replies_cases(spark):
    got = {r.request_id: (r.status, r.text) for r in R.decode_replies(_df(spark)).collect()}
    assert got == {i: e for i, _, _, _, e in REPLIES}


def test_http_error_message(spark):
    got = {r.request_id: r.error for r in R.decode_replies(_df(spark)).collect()}
    assert got["http"] == "LLM 返回错误 (429): quota"
    assert got["err_mid"] == "LLM 流式响应错误: slow down"


def test_strict_json_and_line_ends(spark):
    ok = '{"choices":[{"message":{"content":"a"}}]}'
    cases = [
        ("trailing", "application/json", ok + " trailing garbage", "PARSE_ERROR", ""),
        ("closed", "application/json", ok + "]", "PARSE_ERROR", ""),
        ("two", "application/json", ok + "," + ok, "PARSE_ERROR", ""),
        ("repeated", "application/json", '{"choices":[],"choices":[{"message":{"content":"last"}}]}', "OK", "last"),
        ("second", "application/json", '{"choices":[{"message":{"content":"a"}},{"message":{"content":5}}]}', "PARSE_ERROR", ""),
        ("second_null", "application/json", '{"choices":[{"message":{"content":"a"}},null]}', "OK", "a"),
        ("delta_ignored", "application/json", '{"choices":[{"delta":5,"message":{"content":"a"}}],"error":7}', "OK", "a"),
        ("empty", "application/json", "", "PARSE_ERROR", ""),
        ("stream_trailing", "text/event-stream", 'data: {"choices":[]} x\n\n', "PARSE_ERROR", ""),
        ("stream_number", "text/event-stream", "data: 5\n\n", "PARSE_ERROR", ""),
        ("stream_second", "text/event-stream", 'data: {"choices":[{"delta":{"content":"a"}},{"delta":5}]}\n\n', "PARSE_ERROR", ""),
        ("double_cr", "text/event-stream",
         'data: {"choices":[{"delta":{"content":"a"}}]}\r\r\n\r\r\ndata: {"choices":[{"delta":{"content":"b"}}]}', "OK", "ab"),
        ("done_then_long", "text/event-stream", 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: [DONE]\n\ndata: ' + "x" * 100_000,
         "OK", "a"),
    ]
    df = spark.createDataFrame([(i, 200, c, b) for i, c, b, _, _ in cases],
                               "request_id string, http_status int, content_type string, body string")
    got = {r.request_id: (r.status, r.text) for r in R.decode_replies(df).collect()}
    assert got == {i: (s, t) for i, _, _, s, t in cases}


def test_no_reply_row_is_lost_and_attempts_are_not_merged(spark):
    rows = [("null_body", 0, 200, "text/event-stream", None), ("null_json", 0, 200, "application/json", None),
            ("null_status", 0, None, "text/event-stream", "data: x"), ("null_type", 0, 200, None, '{"choices":[]}'),
            ("twice", 0, 200, "text/event-stream", 'data: {"choices":[{"delta":{"content":"first"}}]}'),
            ("twice", 1, 200, "text/event-stream", 'data: {"choices":[{"delta":{"content":"retry"}}]}'),
            ("worse", 0, 200, "application/json", '{"choices":[{"message":{"content":"good"}}]}'), ("worse", 2, 500, "text/html", "down"),
            ("same", 0, 200, "application/json", '{"choices":[{"message":{"content":"x"}}]}'),
            ("same", 0, 200, "application/json", '{"choices":[{"message":{"content":"x"}}]}')]
    df = spark.createDataFrame(rows, "request_id string, attempt long, http_status int, content_type string, body string")
    out = R.decode_replies(df).collect()
    got = {r.request_id: (r.status, r.text) for r in out}
    assert len(out) == len(got) == 7
    assert got == {"null_body": ("NO_TRANSLATION", ""), "null_json": ("PARSE_ERROR", ""), "null_status": ("NO_STATUS", ""),
                   "null_type": ("NO_TRANSLATION", ""), "twice": ("OK", "retry"), "worse": ("HTTP_ERROR", ""), "same": ("OK", "x")}


def test_http_error_keeps_the_whole_text(spark):
    df = spark.createDataFrame([("r", 500, "text/html", "é" * 400)], "request_id string, http_status int, content_type string, body string")
    r = R.decode_replies(df).collect()[0]
    assert r.error_full.endswith("é" * 400) and len(r.error.encode()) < len(r.error_full.encode())


def test_send_lands_every_reply(spark):
    from transloom.operators.send import send_requests

    def answer(endpoint, payload, seconds):
        text = json.loads(payload)["messages"][1]["content"]
        if "hang" in text:
            raise TimeoutError(f"no answer in {seconds} s")
        return 200, "application/json", json.dumps({"choices": [{"message": {"content": text[-5:]}}]})

    df = spark.createDataFrame([("r1", "hello", "en", "zh", "m", "https://h/"), ("r2", "hang", "en", "zh", "m", "https://h/")],
                               "request_id string, text string, source string, target string, model string, llm_base_url string")
    landed = send_requests(R.llm_payload(df), answer, timeout_s=3.0)
    got = {r.request_id: (r.status, r.text) for r in R.decode_replies(landed).collect()}
    assert got == {"r1": ("OK", "hello"), "r2": ("NO_STATUS", "")}
    assert {r.request_id: r.body for r in landed.collect()}["r2"] == "no answer in 3.0 s"


def test_sse_events_framing(spark):
    ev = R.sse_events(_df(spark)).where("request_id = 'sse_crlf'").orderBy("ev").collect()
    assert [r.data for r in ev] == ['{"choices":[{"delta":{"content":" a"}}]}', "[DONE]"]


def test_reply_guard(spark):
    rows = R.reply_guard(_df(spark), cap=20, line_cap=30).collect()
    got = {r.request_id: r.guard for r in rows}
    assert got["json"] == "REPLY_TOO_LARGE" and got["only_done"] == "OK"


def test_payload_reference_case(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("r1", "Hello, world!", "en", "zh", "m", "https://h.example/")],
                               "request_id string, text string, source string, target string, model string, "
                               "llm_base_url string")
    row = R.llm_payload(df).collect()[0]
    assert row.endpoint.endswith("/v1/chat/completions")
    p = json.loads(row.payload)
    assert p["stream"] is True and p["temperature"] == 0 and p["model"] == "m"
    assert p["messages"][1]["content"] == "将以下英语文本翻译为简体中文：\n\nHello, world!"


def test_names_match_in_any_case(spark):
    rows = [("a", 200, "application/json", '{"Choices":[{"Message":{"Content":"hi"}}]}'),
            ("last", 200, "application/json", '{"choices":[{"message":{"content":"x"}}],"CHOICES":[{"message":{"content":"y"}}]}'),
            ("inside", 200, "application/json", json.dumps({"choices": [{"message": {"content": 'say "Message": and \\"Error": {'}}]})),
            ("sse", 200, "text/event-stream", 'data: {"Choices":[{"DELTA":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{"Content" : "b"}}]}\n\n'),
            ("fails", 200, "text/event-stream", 'data: {"ERROR":{"Message":"no"}}\n\n'),
            ("http", 500, "", '{"Error":{"MESSAGE":" broken "}}'), ("typed", 200, "", '{"Choices":[{"Message":{"Content":5}}]}')]
    df = spark.createDataFrame(rows, "request_id string, http_status int, content_type string, body string")
    got = {r.request_id: (r.status, r.text, r.error) for r in R.decode_replies(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        "a": ("OK", "hi"), "last": ("OK", "y"), "inside": ("OK", 'say "Message": and \\"Error": {'), "sse": ("OK", "ab"),
        "fails": ("STREAM_ERROR", ""), "http": ("HTTP_ERROR", ""), "typed": ("PARSE_ERROR", "")}
    assert got["http"][2].endswith("broken") and got["fails"][2].endswith("no")


def test_requests_are_sent_in_waves(spark, monkeypatch):
    """What got no answer, or one that another attempt may better, is sent again; nothing else is."""
    from transloom.operators.send import headers, send_in_waves

    def answer(endpoint, payload, seconds, head):
        text = json.loads(payload)["messages"][1]["content"]
        attempt_file = f"{folder}/{text[-4:]}"
        with open(attempt_file, "a") as f:
            f.write("x")
        with open(attempt_file) as f:
            n = len(f.read())
        if "hang" in text and n < 3:
            raise TimeoutError("no answer")
        if "busy" in text and n < 2:
            return 429, "application/json", '{"error":{"message":"slow down"}}'
        if "deny" in text:
            return 401, "application/json", '{"error":{"message":"no"}}'
        if "down" in text:
            return 503, "text/plain", "down"
        return 200, "application/json", json.dumps({"choices": [{"message": {"content": f"{text[-4:]} {head.get('Authorization')}"}}]})

    import tempfile
    folder = tempfile.mkdtemp(prefix="transloom-sent-")
    monkeypatch.setenv("TRANSLOOM_TEST_KEY", " k1 ")  # the workers inherit it
    rows = [(w, w, "en", "zh", "m", "https://h/") for w in ("good", "hang", "busy", "deny", "down")]
    df = spark.createDataFrame(rows, "request_id string, text string, source string, target string, model string, llm_base_url string")
    landed = send_in_waves(R.llm_payload(df), answer, key_env="TRANSLOOM_TEST_KEY")
    sent = {r.request_id: r["count"] for r in landed.groupBy("request_id").count().collect()}
    assert sent == {"good": 1, "hang": 3, "busy": 2, "deny": 1, "down": 3}
    got = {r.request_id: (r.status, r.attempt) for r in R.decode_replies(landed).collect()}
    assert got == {"good": ("OK", 0), "hang": ("OK", 2), "busy": ("OK", 1), "deny": ("HTTP_ERROR", 0), "down": ("HTTP_ERROR", 2)}
    assert headers("k") == {"Content-Type": "application/json", "Authorization": "Bearer k"} and "Authorization" not in headers("  ") | headers(None)
