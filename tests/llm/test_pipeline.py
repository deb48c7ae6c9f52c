"""The pipeline, stage by stage, against plain versions."""

from collections import Counter

import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_operators import (lower, plain_components, plain_fingerprint, plain_lines, rows_of, shingle_set, split_words)
from transloom.llm import quality


def test_stages(spark, docs, tmp_path):
    import hashlib

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            assert {d for d, _ in before} == {r["doc_id"] for r in docs.collect()}
            continue
        assert docs.columns == columns
        after = rows_of(docs)
        if name == "quality rules":
            assert Counter(after) == Counter((d, j[8]) for d, t in before if (j := quality.judge(t))[7])
        if name == "line dedup":
            want = Counter({(d, sha): n for (d, _, _, sha), n in plain_lines(before).items()})
            assert Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in after) == want
        if name == "near dedup":
            fps = [(d, plain_fingerprint(t)) for d, t in before]
            assert {d for d, _ in after} == set(plain_components(fps)) and len(after) == len(set(plain_components(fps)))
        if name == "decontamination":
            items = [q for r in bench if (q := shingle_set(r["text"]))]
            assert {d for d, _ in after} == {d for d, t in before if all(
                10 * len(q & shingle_set(t)) < 8 * len(q) for q in items)}
    assert lower("ABC") == "abc" and split_words(" a  b ") == ["a", "b"]


def test_awkward_rows(spark, awkward, empty, tmp_path):
    for k, start in enumerate((awkward, empty)):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{k}-{i}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() >= (1 if k == 0 else 0)
        for _, stage in corpus_pipeline.STAGES:  # each stage on the rows as they are
            stage(spark, start.select(*corpus_pipeline.COLUMNS), SF).count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and "sequence_id" in out.columns
