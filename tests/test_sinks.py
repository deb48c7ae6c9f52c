import os
import tempfile

from transloom.operators import audit
from transloom.operators.settings import normalize_settings
from transloom.sources import dims
from transloom.sources import requests as rq
from transloom.sources.requests import read_settings_files


def test_read_settings_files(spark):
    root = tempfile.mkdtemp(prefix="transloom-settings-")
    with open(os.path.join(root, "acme.json"), "w") as f:
        f.write('{"provider":"llm","llmBaseUrl":"https://x/"}')
    with open(os.path.join(root, "beta.json"), "w") as f:
        f.write('{"shortcutEnabled":false}')
    got = {r.tenant: (r.provider, r.llm_base_url, r.clipboard_enabled)
           for r in normalize_settings(read_settings_files(spark, root)).collect()}
    assert got == {"acme": ("llm", "https://x", True), "beta": ("local", "", False)}


def test_append_audit_is_idempotent_per_run(spark):
    rows = spark.createDataFrame([("r1", "local", "m", "en", "zh", 5, "OK")],
                                 "request_id string, provider string, model string, source string, target string, "
                                 "n_chars int, status string")
    path = os.path.join(tempfile.mkdtemp(prefix="transloom-audit-"), "audit")
    audit.append_audit(rows, path, "run-1")
    audit.append_audit(rows, path, "run-1")
    audit.append_audit(rows, path, "run-2")
    table = spark.read.parquet(path)
    assert table.count() == 2
    assert sorted(r.run_id for r in table.select("run_id").collect()) == ["run-1", "run-2"]


LINES = ['{"id":1,"text":"hello","source":"en","target":"zh"}', "{oops", '{"id":3}', '{"id":4,"text":5}', "", "[1]",
         '{"id":"x","text":"t"} trailing']


def test_request_lines_answer_with_their_error(spark):
    root = tempfile.mkdtemp(prefix="transloom-lines-")
    with open(os.path.join(root, "a.jsonl"), "w") as f:
        f.write("\n".join(LINES) + "\n")
    rows = rq.read_request_lines(spark, root)
    got = sorted((r.request_id, r.text, r.source, r.target, r.error is None) for r in rows.collect())
    assert got == sorted([("1", "hello", "en", "zh", True), ("", "", "en", "zh", False), ("3", "", "en", "zh", True),
                          ("4", "", "en", "zh", False), ("", "", "en", "zh", False), ("", "", "en", "zh", False)])
    refused = rq.refused_lines(rows)
    assert refused.columns == ["id", "text", "error"] and refused.count() == 4
    q = (rq.stream_request_lines(spark, root).writeStream.format("memory").queryName("s1_lines")
         .option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    q.awaitTermination(60)
    assert spark.table("s1_lines").count() == 6


def test_response_lines_round_trip(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="transloom-out-"), "out")
    rq.write_response_lines(spark.createDataFrame([("1", "你好", ""), ("2", "", "bad")], "id string, text string, error string"), root)
    assert sorted((r.id, r.text, r.error) for r in spark.read.json(root).collect()) == [("1", "你好", ""), ("2", "", "bad")]


def test_ready_markers_from_files(spark):
    root = tempfile.mkdtemp(prefix="transloom-ready-")
    for name in ("facebook--nllb-200-distilled-600M.ready", "other.txt"):
        open(os.path.join(root, name), "w").close()
    assert [r.marker for r in dims.ready_markers_from_files(spark, root).collect()] == ["facebook--nllb-200-distilled-600M.ready"]
