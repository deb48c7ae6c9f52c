from transloom.operators import progress as P


def test_log_records_reference_blob(spark):
    blob = "model.safetensors: 12%|x\rmodel.safetensors: 13%|x\r\nwarning\nfinished"
    df = spark.createDataFrame([(1, blob), (2, "a\n"), (3, "")], "log_id long, blob string")
    rows = P.log_records(df).orderBy("log_id", "n").collect()
    recs = [r.record for r in rows if r.log_id == 1]
    assert recs == ["model.safetensors: 12%|x", "model.safetensors: 13%|x", "warning", "finished"]
    assert [r.record for r in rows if r.log_id == 2] == ["a"]
    assert [r for r in rows if r.log_id == 3] == []


def test_progress_parse_reference_lines(spark):
    lines = ["model.safetensors: 42%|████ | 420M/1.0G", "UserWarning: something odd",
             "\x1b[2Kconfig.json: 999%|", "Downloading 7% done", "   "]
    df = spark.createDataFrame([("l", "m", i, x) for i, x in enumerate(lines)],
                               "log_id string, model string, n long, line string")
    got = [(r.percent, r.message) for r in P.parse(df).orderBy("n").collect()]
    assert got == [(42, "正在下载 model.safetensors · 当前文件 42%"), (-1, "UserWarning: something odd"),
                   (-1, "config.json: 999%|"), (7, "正在下载模型文件 · 当前文件 7%")]


def test_changes_drop_consecutive_repeats_across_blocks(spark):
    lines = ["a: 10%|", "a: 10%|", "", "a: 10%|", "a: 20%|", "b", "b", "a: 20%|"]
    df = spark.createDataFrame([("l", "m", i, x) for i, x in enumerate(lines)],
                               "log_id string, model string, n long, line string")
    for block in (1, 2, 3, 1 << 22):
        kept = [r.n for r in P.changes(P.parse(df), block=block).orderBy("n").collect()]
        assert kept == [0, 4, 5, 7], block


def test_log_tail_gathers_the_end_only(spark):
    import random

    from transloom.operators.progress import log_tail
    rng = random.Random(8)
    logs = {"long": [f"line {i}" for i in range(3000)] + ["x" * 50_000], "many": ["y" * rng.randint(0, 30) for _ in range(4000)],
            "blank": [""] * 700, "one": ["only"], "none": ["z" * 10] * 3 + [""] * 5}
    df = spark.createDataFrame([(k, 3 * i, line) for k, lines in logs.items() for i, line in enumerate(lines)],
                               "log_id string, n long, line string")
    for block in (16, 1 << 12):
        out = log_tail(df, 100, block)
        assert {r.log_id: r.tail_text for r in out.collect()} == {k: "\n".join(v)[-200:] for k, v in logs.items()}, block
