import os
import random
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from transloom.operators import memory as tm
from transloom.operators import segment
from transloom import constants as K
from transloom.operators.backends import HFBackend, PseudoBackend, batches_of, cut_output
from transloom.operators.translate import round_trip, translate_parts, translate_requests
from transloom.sources import fixtures as fx
from transloom.sources.tables import table


def _ready(spark):
    docs = table(spark, SF_SMALL, "documents")
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("request_id"), "text",
                       F.lit("t").alias("tenant"), F.lit("en").alias("source"), F.lit("zh").alias("target"),
                       F.lit("Helsinki-NLP/opus-mt-en-zh").alias("model"))


def test_split_is_lossless(spark):
    parts = segment.paragraphs(_ready(spark))
    back = parts.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "part"))), lambda p: p["part"]),
                     "").alias("joined"))
    bad = back.join(_ready(spark), "request_id").where(F.col("joined") != F.col("text")).count()
    assert bad == 0


def test_reassembled_equals_python_backend(spark):
    got = {r.request_id: r.text for r in translate_requests(_ready(spark)).collect()}
    docs = {r.request_id: r.text for r in _ready(spark).collect()}
    be = PseudoBackend("m")
    import re
    for rid, text in docs.items():
        parts = [p for p in re.split(r"(\n+)", text) if p]
        out = "".join(p if p.startswith("\n") else be.translate([p], "en", "zh")[0] for p in parts)
        assert got[rid] == out.strip(" \t\n\r\x0b\f　 "), rid


def test_result_independent_of_partitioning(spark):
    a = translate_requests(_ready(spark).repartition(1)).orderBy("request_id").collect()
    b = translate_requests(_ready(spark).repartition(7)).orderBy("request_id").collect()
    assert a == b


def test_second_run_sends_nothing_new(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="transloom-mem-"), "memory")
    parts = segment.paragraphs(_ready(spark))
    table = tm.MemoryTable(spark, path)
    first = translate_parts(parts, table)
    assert first.count() == parts.count()
    memory = table.rows()
    unique = segment.unique_segments(parts)
    assert tm.misses(unique, memory).count() == 0
    assert tm.hits(unique, memory).count() == unique.count()


def test_memory_seed_hits(spark):
    mem = fx.memory_seed(table(spark, SF_SMALL, "benchmark"), table(spark, SF_SMALL, "documents"))
    unique = segment.unique_segments(segment.paragraphs(_ready(spark)))
    hits = tm.hits(unique, mem).count()
    misses = tm.misses(unique, mem).count()
    assert hits + misses == unique.count() and hits
    marked = [r.text for r in translate_requests(_ready(spark), mem).collect() if fx.MEMORY_MARK.strip() in r.text]
    assert marked  # the flagship reads the memory's translations, not the double's


def test_backend_error_becomes_row(spark):
    df = spark.createDataFrame([("r1", "hello", "en", "zh", "m")],
                               "request_id string, text string, source string, target string, model string")
    out = translate_requests(df, kind="nope").collect()
    assert out[0].text == "" and "unknown backend" in out[0].error


def test_round_trip(spark):
    nllb = "facebook/nllb-200-distilled-600M"
    settings = spark.createDataFrame([("t", '{"localModel":"%s"}' % nllb)], "tenant string, raw string")
    for r in round_trip(_ready(spark).withColumn("model", F.lit(nllb)).limit(5), settings).collect():
        assert r.forward.startswith("[zh]") and r.back.startswith("[en] [zh]") and r.error == ""
    plain = spark.createDataFrame([("t", "{}")], "tenant string, raw string")
    for r in round_trip(_ready(spark).limit(5), plain).collect():  # the small model has no way back
        assert r.forward.startswith("[zh]") and r.back == "" and r.error == K.MSG_PAIR_UNSUPPORTED


class _Short:
    def translate(self, texts, source, target):
        return ["x"] * (len(texts) - 1)


class _Words:
    """A tokenizer and model double: ids are word numbers, the output repeats the input ids."""
    all_special_ids = [0]

    def __init__(self):
        self.words, self.batches = ["<s>"], []
        self.tokenizer = self

    def __call__(self, text, add_special_tokens=True):
        ids = [self.words.index(w) if w in self.words else self.words.append(w) or len(self.words) - 1 for w in text.split()]
        return {"input_ids": [0] * add_special_tokens + ids}

    def decode(self, ids, skip_special_tokens=True):
        return " ".join(self.words[i] for i in ids if i)

    def generate(self, texts, budget, target_code):
        self.batches.append((len(texts), budget))
        if any("boom" in t for t in texts):
            raise RuntimeError("boom")
        return [[0, *self(t, False)["input_ids"], 0] for t in texts]


def test_hf_adapter_batches_and_keeps_order():
    made = []
    be = HFBackend("m", loader=lambda model, cache: made.append(_Words()) or made[-1])
    texts = ["one two three", "four five six", " ".join(f"w{i}" for i in range(900)), ""]
    assert be.translate(texts, "en", "zh") == texts
    assert max(n for n, _ in made[0].batches) > 1 and sum(n for n, _ in made[0].batches) == 5
    failing = HFBackend("m", loader=lambda model, cache: _Words(), tokens=60)
    out = failing.translate(["boom now", " ".join(f"v{i}" for i in range(100))], "en", "zh")
    assert isinstance(out[0], RuntimeError) and out[1].startswith("v0 v1")


def test_batches_are_filled_to_a_token_budget():
    """Short texts of all lengths: at most a tenth of the calls that batches of one output budget took, little padding."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 60))) for _ in range(1000)]
    made = []
    be = HFBackend("m", loader=lambda model, cache: made.append(_Words()) or made[-1])
    assert be.translate(texts, "en", "zh") == texts
    sizes = [len(t.split()) for t in texts]
    by_budget = sum(-(-sizes.count(n) // 16) for n in set(sizes))  # as before: batches of 16 of one budget
    assert be.calls == len(made[0].batches) <= by_budget / 10
    assert 1 - be.real / be.padded < 0.25
    assert [j for b in batches_of(sizes, 100) for j in b] == sorted(range(1000), key=lambda j: (sizes[j], j))
    assert all(len(b) * max(sizes[j] for j in b) <= 100 for b in batches_of(sizes, 100))


def test_each_output_is_cut_at_its_own_budget():
    class Long(_Words):
        def generate(self, texts, budget, target_code):
            self.batches.append((len(texts), budget))
            return [[0, *range(1, budget + 1)] for _ in texts]  # a mark, then as many ids as it may

    made = []
    be = HFBackend("m", loader=lambda model, cache: made.append(Long()) or made[-1])
    made[0].words += [f"o{i}" for i in range(600)]
    out = be.translate(["x", " ".join("y" for _ in range(100))], "en", "zh")
    assert made[0].batches == [(2, 416)] and [len(t.split()) for t in out] == [32, 416]
    assert cut_output([0, 5, 6, 7], {0}, 2) == [0, 5, 6] and cut_output([5, 6, 7], {0}, 2) == [5, 6]


def test_wrong_number_of_translations_is_an_error(spark, monkeypatch):
    import pandas as pd

    from transloom.operators import backends, translate
    monkeypatch.setattr(backends, "open_backend", lambda *a: _Short())
    pdf = pd.DataFrame({"source": ["en"] * 2, "target": ["zh"] * 2, "model": ["m"] * 2, "segment": ["a", "b"], "translation": [None, None]})
    out = list(translate._translate_batches("x", None)([pdf]))[0]
    assert list(out["translation"]) == ["", ""] and all("1 translations" in e for e in out["error"])


def test_missing_translation_is_an_error_row(spark):
    parts = segment.paragraphs(_ready(spark).limit(3))
    none = spark.createDataFrame([], "source string, target string, model string, segment string, translation string, error string")
    for r in segment.reassemble(segment.fan_out(parts, none)).collect():
        assert r.text == "" and r.error == K.MSG_MISSING_TRANSLATION
