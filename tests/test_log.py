"""the program's log read back, however its files are cut."""
import os
import tempfile

import pytest

from transloom.operators import audit

LOG = """lines from before the first record
still before
2026/07/01 10:00:00.000001 translation started; provider=local source=en target=zh characters=12
2026/07/01 10:00:01.500000 local translation failed; model=my model error=first line
second line; model=not a field
2026/07/01 10:00:02.000000 runtime installer output:
Collecting torch

  done: ok
2026/07/01 10:00:03.000000 model download output; model=a/b progress=42 message=part: 42%| model=z
2026/07/01 10:00:04.000000 application window started
2026/07/01 10:00:05.000000 configuration saved; provider=llm local_model=my own model clipboard=true quick_open=false shortcut=Ctrl+Alt close_to_tray=true always_on_top=false
2026/07/01 10:00:06.000000 local model service ready; base=/a b/c python=/usr/bin/python
2026/07/01 10:00:07.000000 runtime preparation failed: exec: "x": not found
2026/07/01 10:00:08.000000 model download stdout; model=m output=one
2026/13/45 is no time
"""


def parsed(spark, path):
    rows = audit.parse_records(audit.log_records(audit.read_log(spark, path))).collect()
    return sorted(rows, key=lambda r: r.at_us or 0)


@pytest.mark.parametrize("part_bytes", [None, 64, 300])
def test_the_program_log(spark, part_bytes):
    root = tempfile.mkdtemp(prefix="transloom-log-")
    with open(os.path.join(root, "app.log"), "w", newline="") as f:
        f.write(LOG)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if part_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(part_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = parsed(spark, root)
        if part_bytes == 64:
            assert audit.read_log(spark, root).select("part").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    before, started, failed, installer, output, window, saved, ready, prepare, stdout = rows
    assert before.at_us is None and before.event == "lines from before the first record"
    assert (started.event, started.provider, started.source, started.target, started.characters) == ("translation started", "local", "en", "zh", 12)
    assert started.at_us % 1_000_000 == 1
    assert (failed.event, failed.model, failed.error) == ("local translation failed", "my model", "first line\nsecond line; model=not a field")
    assert (installer.event, installer.output, installer.error) == ("runtime installer output", "Collecting torch\n\n  done: ok", "")
    assert (output.event, output.model, output.progress, output.message) == ("model download output", "a/b", 42, "part: 42%| model=z")
    assert window.event == "application window started" and window.model == ""
    assert (saved.provider, saved.local_model, saved.clipboard, saved.shortcut, saved.always_on_top) == ("llm", "my own model", "true", "Ctrl+Alt", "false")
    assert saved.model == "" and (ready.base, ready.python) == ("/a b/c", "/usr/bin/python")
    assert (prepare.event, prepare.error) == ("runtime preparation failed", 'exec: "x": not found')
    assert (stdout.model, stdout.output, stdout.error) == ("m", "one\n2026/13/45 is no time", "")
