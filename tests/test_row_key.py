"""Requests are told apart by their row, not by their id; settings by tenant; refused lines keep their reason."""
from collections import Counter

from pyspark.sql import functions as F

from transloom import constants as K
from transloom.operators import segment
from transloom.operators.settings import tenant_settings
from transloom.operators.translate import round_trip, translate_requests
from transloom.plans.corpus import translate_corpus
from transloom.sources.requests import parse_request_lines

SF = "/root/testdata/sf0.01"
REQUEST = "request_id string, tenant string, text string, source string, target string"


def _settings(spark, *rows):
    return spark.createDataFrame(list(rows), "tenant string, raw string")


def _texts(df):
    return Counter((r.request_id, r.status, r.text) for r in df.collect())


def test_requests_without_an_id_or_of_one_id_stay_apart(spark):
    rows = [("", "t", "no id A", "en", "zh"), ("", "t", "no id B", "en", "zh"), (None, "t", "null A", "en", "zh"),
            (None, "t", "null B", "en", "zh"), ("x", "t", "first", "en", "zh"), ("x", "t", "second\n\nline", "en", "zh"),
            ("x", None, "first", "en", "zh"), ("y", "t", "twice\n\nasked", "en", "zh"), ("y", "t", "twice\n\nasked", "en", "zh")]
    got = _texts(translate_corpus(spark.createDataFrame(rows, REQUEST), _settings(spark, ("t", "{}"))))
    zh = lambda s: "\n\n".join(f"[zh] {p}" for p in s.split("\n\n"))
    assert got == Counter((i, "OK", zh(text)) for i, _, text, _, _ in rows)


def test_columns_are_told_apart_in_the_row_key(spark):
    rows = [("a", None, "b", "en", "zh"), ("a", "", "b", "en", "zh"), (None, "a", "b", "en", "zh"), ("ab", "", "", "en", "zh"),
            ("", "ab", "", "en", "zh")]
    keyed = segment.with_row_key(spark.createDataFrame(rows, REQUEST))
    assert keyed.select(*segment.ROW_KEY).distinct().count() == len(rows)
    assert keyed.where(F.col("_h1") == F.col("_h2")).count() == 0


def test_equal_requests_are_combined_before_the_shuffle(spark):
    """A request that is asked 50,000 times is translated and told once, and answered 50,000 times."""
    one = spark.createDataFrame([("", "t", "hot\n\ntext", "en", "zh", "m")], REQUEST + ", model string")
    many = one.crossJoin(spark.range(50_000).select()).repartition(6)
    out = translate_requests(many)
    assert out.count() == 50_000 and out.distinct().collect()[0].text == "[zh] hot\n\n[zh] text"
    plan = translate_requests(many)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_set" in plan


def test_round_trip_of_requests_that_share_an_id(spark):
    nllb = "facebook/nllb-200-distilled-600M"
    rows = [("", "t", f"text {i % 2}", "en", "zh", nllb) for i in range(3)]
    out = round_trip(spark.createDataFrame(rows, REQUEST + ", model string"), _settings(spark, ("t", '{"localModel":"%s"}' % nllb)))
    assert Counter((r.original, r.back) for r in out.collect()) == {("text 0", "[en] [zh] text 0"): 2, ("text 1", "[en] [zh] text 1"): 1}


def test_one_settings_row_per_tenant(spark):
    s = _settings(spark, ("same", '{"targetLanguage":"ja"}'), ("same", '{"targetLanguage":"ja"}'), ("two", '{"targetLanguage":"ja"}'),
                  ("two", '{"targetLanguage":"fr"}'), ("null", None), ("null", "{}"))
    got = {r.tenant: (r.target_language, r.settings_error) for r in tenant_settings(s).collect()}
    assert got == {"same": ("ja", ""), "two": ("zh", K.MSG_SETTINGS_CONFLICT), "null": ("zh", K.MSG_SETTINGS_CONFLICT)}
    asked = spark.createDataFrame([("1", "two", "hi", "en", "zh"), ("2", "same", "hi", "en", "zh")], REQUEST)
    out = {r.request_id: (r.status, r.error) for r in translate_corpus(asked, s).collect()}
    assert out == {"1": ("SETTINGS_ERROR", K.MSG_SETTINGS_CONFLICT), "2": ("OK", "")}


def test_refused_lines_keep_their_reason(spark):
    lines = spark.createDataFrame([("{oops",), ('{"id":"a","text":5}',), ('{"id":"b","text":"hi"}',), ('{"text":"one"}',), ('{"text":"two"}',)],
                                  "value string")
    out = translate_corpus(parse_request_lines(lines), _settings(spark, ("t", "{}"))).collect()
    assert Counter((r.request_id, r.status, r.text, r.error) for r in out) == Counter([
        ("", "REFUSED", "", K.MSG_BAD_REQUEST), ("a", "REFUSED", "", K.MSG_BAD_REQUEST), ("b", "OK", "[zh] hi", ""),
        ("", "OK", "[zh] one", ""), ("", "OK", "[zh] two", "")])


def test_no_join_key_carries_much_of_the_corpus(spark):
    """What goes into the translation join: no key has over 1 % of the rows' bytes, separators included."""
    from transloom.plans import catalog
    parts = segment.paragraphs(catalog._ready_local(spark, SF))
    keyed = segment.join_keys(parts).select("is_sep", "segment", F.octet_length("part").alias("bytes"))
    total, seps = keyed.agg(F.sum("bytes"), F.count_if("is_sep")).first()
    assert seps > 1000 and keyed.where("is_sep").select("segment").distinct().count() > 0.9 * seps
    assert keyed.groupBy("segment").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] < 0.01 * total
