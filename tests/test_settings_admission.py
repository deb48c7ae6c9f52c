from transloom.operators import admission as A
from transloom.operators.settings import normalize_settings


def _settings(spark, rows):
    return spark.createDataFrame(rows, "tenant string, raw string")


def test_settings_reference_cases(spark):
    s = _settings(spark, [("a", '{"provider":"unknown"}'), ("b", '{"shortcutEnabled":false}'),
                          ("c", '{"provider":"local"}'),
                          ("d", '{"provider":"llm","llmBaseUrl":" https://x/v1// ","llmModel":" m ","localModel":" "}')])
    got = {r.tenant: r for r in normalize_settings(s).collect()}
    assert got["a"].provider == "local" and got["a"].local_model == "Helsinki-NLP/opus-mt-en-zh"
    assert (got["a"].source_language, got["a"].target_language) == ("en", "zh")
    assert got["b"].clipboard_enabled is False
    assert got["c"].quick_open_enabled is True and got["c"].clipboard_enabled is True
    assert (got["d"].llm_base_url, got["d"].llm_model, got["d"].local_model) == (
        "https://x/v1", "m", "Helsinki-NLP/opus-mt-en-zh")


def test_admission_order_and_limit(spark):
    rows = [("empty", "t", " \t　", "en", "zh"), ("long", "t", "a" * 12001, "en", "zh"),
            ("limit", "t", " " + "a" * 12000 + " ", "en", "zh"), ("same", "t", " hi ", "en", "en"),
            ("both_blank", "t", "hi", "", ""), ("src_blank", "t", "hi", "", "zh")]
    req = spark.createDataFrame(rows, "request_id string, tenant string, text string, source string, target string")
    free = {r.request_id: (r.status, r.over_limit) for r in A.admit(req).collect()}
    assert free["long"] == ("ADMITTED", True) and free["limit"] == ("ADMITTED", False)
    got = {r.request_id: r.status for r in A.admit(req, max_chars=12000).collect()}
    assert got == {"empty": "EMPTY", "long": "TOO_LONG", "limit": "ADMITTED", "same": "DIRECT",
                   "both_blank": "DIRECT", "src_blank": "ADMITTED"}
    direct = {r.request_id: r.text for r in A.direct_results(A.admit(req)).collect()}
    assert direct == {"same": "hi", "both_blank": "hi"}


def test_capability_chain(spark):
    s = _settings(spark, [("llm_nourl", '{"provider":"llm","llmModel":"m"}'),
                          ("llm_nomodel", '{"provider":"llm","llmBaseUrl":"https://x"}'),
                          ("helsinki", "{}"), ("nllb", '{"localModel":"facebook/nllb-200-distilled-600M"}'),
                          ("custom", '{"localModel":"acme/x"}')])
    rows = [("1", "llm_nourl", "hi", "en", "zh"), ("2", "llm_nomodel", "hi", "en", "zh"),
            ("3", "helsinki", "hi", "fr", "zh"), ("4", "helsinki", "hi", "en", "zh"),
            ("5", "nllb", "hi", "pt", "zh"), ("6", "nllb", "hi", "fr", "de"), ("7", "custom", "hi", "fr", "de"),
            ("8", "nobody", "hi", "", "zh")]
    req = spark.createDataFrame(rows, "request_id string, tenant string, text string, source string, target string")
    got = {r.request_id: (r.status, r.source) for r in A.resolve(req, s).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "1": "LLM_NO_URL", "2": "LLM_NO_MODEL", "3": "PAIR_UNSUPPORTED", "4": "READY", "5": "LANG_UNMAPPED",
        "6": "READY", "7": "MODEL_NOT_READY", "8": "READY"}
    assert got["8"][1] == "en"  # missing tenant takes the default source


def test_null_language_takes_the_default_and_null_text_is_empty(spark):
    s = _settings(spark, [("nllb", '{"localModel":"facebook/nllb-200-distilled-600M","sourceLanguage":"fr"}')])
    rows = [("1", "nllb", "hello there", None, "zh"), ("2", "nllb", None, "en", "zh"), ("3", None, "hello", "en", None)]
    req = spark.createDataFrame(rows, "request_id string, tenant string, text string, source string, target string")
    got = {r.request_id: (r.status, r.source, r.target) for r in A.resolve(req, s).collect()}
    assert got == {"1": ("READY", "fr", "zh"), "2": ("EMPTY", "en", "zh"), "3": ("READY", "en", "zh")}


def test_refused_settings_are_a_status(spark):
    s = _settings(spark, [("cut", '{"provider":5,"llmModel":'), ("typed", '{"provider":5}'), ("list", "[]"), ("none", None),
                          ("null", '{"provider":null,"localModel":null}'), ("flag", '{"clipboardEnabled":"no"}'),
                          ("case", '{"Provider":"llm","LLMBASEURL":"https://x/","llmmodel":"m"}'),
                          ("both", '{"PROVIDER":"local","provider":"llm"}'),
                          ("legacy", '{"clipboardEnabled":true,"shortcutEnabled":"ignored"}')])
    got = {r.tenant: (r.settings_error != "", r.provider, r.llm_base_url) for r in normalize_settings(s).collect()}
    assert {t for t, v in got.items() if v[0]} == {"cut", "typed", "list", "none", "flag"}
    assert got["case"] == (False, "llm", "https://x") and got["both"][1] == "llm" and got["null"] == (False, "local", "")
    req = spark.createDataFrame([("1", "cut", "hi", "en", "zh")], "request_id string, tenant string, text string, source string, target string")
    assert A.resolve(req, s).collect()[0].status == "SETTINGS_ERROR"
