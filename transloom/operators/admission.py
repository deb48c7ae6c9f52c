"""Admission, defaults, routing and capability checks.

All of it is one narrow projection plus joins to small dimensions, so it sits
inside a single whole-stage-codegen span ahead of any shuffle. Rejected rows
are kept with a status; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.text import go_trim, safe_name
from transloom.operators.settings import DEFAULTS_ROW, tenant_settings
from transloom.session import stored
from transloom.sources import dims

# Status codes (ours); the user-facing message for each is a fixed value.
REFUSED, EMPTY, TOO_LONG, DIRECT, ADMITTED = "REFUSED", "EMPTY", "TOO_LONG", "DIRECT", "ADMITTED"
LLM_NO_URL, LLM_NO_MODEL = "LLM_NO_URL", "LLM_NO_MODEL"
PAIR_UNSUPPORTED, MODEL_NOT_READY, LANG_UNMAPPED, READY, SETTINGS_ERROR = (
    "PAIR_UNSUPPORTED", "MODEL_NOT_READY", "LANG_UNMAPPED", "READY", "SETTINGS_ERROR")

STATUS_MESSAGES = {
    EMPTY: K.MSG_EMPTY, TOO_LONG: K.MSG_TOO_LONG, LLM_NO_URL: K.MSG_LLM_NO_URL,
    LLM_NO_MODEL: K.MSG_LLM_NO_MODEL, SETTINGS_ERROR: K.MSG_SETTINGS_ERROR, PAIR_UNSUPPORTED: K.MSG_PAIR_UNSUPPORTED,
    MODEL_NOT_READY: K.MSG_MODEL_NOT_READY, LANG_UNMAPPED: K.MSG_LANG_UNMAPPED,
}


def status_message(status) -> F.Column:
    out = F.lit("")
    for code, msg in STATUS_MESSAGES.items():
        out = F.when(status == code, F.lit(msg)).otherwise(out)
    return out


def row_message() -> F.Column:
    """The message of a row that ``resolve`` stopped: why its line or its tenant's settings were refused, else its status's."""
    status = F.col("status")
    return F.when(status == REFUSED, F.col("refused")).when(status == SETTINGS_ERROR, F.col("settings_error")) \
        .otherwise(status_message(status))


def admit(requests: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Ordered checks on the trimmed text and the raw language pair.

    A NULL text, source or target counts as empty. ``over_limit`` reports texts above the
    interactive limit of 12,000 code points; they are translated like any other unless
    ``max_chars`` is set, which rejects longer ones as TOO_LONG. A line that its source refused (``error``) is REFUSED
    and keeps its reason.

    Blank text is told by its first character that is not white space, so a plan that needs no length trims nothing.
    """
    requests = requests.withColumns({c: F.coalesce(c, F.lit("")) for c in ("text", "source", "target")})
    refused = F.coalesce("error", F.lit("")) if "error" in requests.columns else F.lit("")
    n = F.length(go_trim("text"))
    status = F.when(refused != "", F.lit(REFUSED)).when(~F.col("text").rlike(K.NOT_WHITE_SPACE), F.lit(EMPTY))
    if max_chars is not None:
        status = status.when(n > max_chars, F.lit(TOO_LONG))
    status = status.when(F.col("source") == F.col("target"), F.lit(DIRECT)).otherwise(F.lit(ADMITTED))
    return requests.select("*", n.alias("n_chars"), (n > K.MAX_CHARS).alias("over_limit"), refused.alias("refused"), status.alias("status"))


def direct_results(admitted: DataFrame) -> DataFrame:
    """Same-language requests return the trimmed text unchanged."""
    return admitted.where(F.col("status") == DIRECT).select(
        "request_id", go_trim("text").alias("text"),
        F.lit(K.DIRECT_PROVIDER).alias("provider"), F.lit(K.DIRECT_MODEL).alias("model"))


def with_settings(admitted: DataFrame, settings_raw: DataFrame) -> DataFrame:
    """Tenant settings (normalised); tenants without settings get the defaults.

    Settings hold one row per tenant (``tenant_settings`` sees to it). They are written once, so the planner knows their size:
    it broadcasts them under its threshold (the corpus text is then not shuffled) and
    shuffles, splitting skewed tenants, above it. A tenant whose settings can't be read
    keeps the reason in ``settings_error``.
    """
    s = stored(tenant_settings(settings_raw), "settings")
    joined = admitted.join(s, "tenant", "left")
    return joined.select(
        *admitted.columns,
        *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS_ROW.items()],
        F.coalesce("settings_error", F.lit("")).alias("settings_error"),
    )


def fill_languages(admitted_with_settings: DataFrame) -> DataFrame:
    """After admission, an empty source/target takes the tenant default."""
    df = admitted_with_settings
    go_on = F.col("status") == ADMITTED
    return df.withColumns({
        "source": F.when(go_on & (F.col("source") == ""), F.col("source_language")).otherwise(F.col("source")),
        "target": F.when(go_on & (F.col("target") == ""), F.col("target_language")).otherwise(F.col("target")),
    })


def route(filled: DataFrame) -> DataFrame:
    """P4 + P5: provider, model and the ordered capability checks."""
    spark = filled.sparkSession
    markers = dims.ready_markers(spark)
    df = filled.withColumn("model", F.when(F.col("provider") == "llm", F.col("llm_model"))
                           .otherwise(F.col("local_model")))
    df = df.join(markers, F.concat(safe_name(df["local_model"]), F.lit(".ready")) == markers["marker"], "left")
    downloaded = F.col("marker").isNotNull()
    codes = [c for c, _, _ in K.LANGUAGES]
    is_llm = F.col("provider") == "llm"
    capability = (
        F.when(F.col("status") == REFUSED, F.lit(REFUSED))
        .when(F.col("settings_error") != "", F.lit(SETTINGS_ERROR))  # nothing starts on refused settings
        .when(F.col("status") != ADMITTED, F.col("status"))
        .when(is_llm & (go_trim("llm_base_url") == ""), F.lit(LLM_NO_URL))
        .when(is_llm & (go_trim("llm_model") == ""), F.lit(LLM_NO_MODEL))
        .when(is_llm, F.lit(READY))
        .when((F.col("local_model") == K.DEFAULT_LOCAL_MODEL)
              & ((F.col("source") != "en") | (F.col("target") != "zh")), F.lit(PAIR_UNSUPPORTED))
        .when(~downloaded, F.lit(MODEL_NOT_READY))
        .when(F.lower("local_model").contains("nllb")
              & ~(F.col("source").isin(codes) & F.col("target").isin(codes)), F.lit(LANG_UNMAPPED))
        .otherwise(F.lit(READY)))
    return df.withColumn("status", capability).drop("marker")


def resolve(requests: DataFrame, settings_raw: DataFrame, max_chars: int | None = None) -> DataFrame:
    """P1 -> J3 -> P3 -> P4/P5 in order; ``raw_source`` and ``raw_target`` keep the pair as asked for."""
    admitted = admit(requests, max_chars)
    admitted = admitted.withColumns({"raw_source": F.col("source"), "raw_target": F.col("target")})
    return route(fill_languages(with_settings(admitted, settings_raw)))


def language_lookup(requests: DataFrame) -> DataFrame:
    """Prompt names (unknown code falls back to the code) and NLLB codes (unknown is NULL)."""
    spark = requests.sparkSession
    src = dims.languages(spark).select(F.col("code").alias("s_code"), F.col("name_zh").alias("s_name"),
                                       F.col("nllb_code").alias("s_nllb"))
    tgt = dims.languages(spark).select(F.col("code").alias("t_code"), F.col("name_zh").alias("t_name"),
                                       F.col("nllb_code").alias("t_nllb"))
    df = (requests.join(src, requests["source"] == src["s_code"], "left")
          .join(tgt, requests["target"] == tgt["t_code"], "left"))
    return df.select(
        "request_id", "source", "target",
        F.coalesce("s_name", "source").alias("source_name"),
        F.coalesce("t_name", "target").alias("target_name"),
        F.col("s_nllb").alias("source_nllb"), F.col("t_nllb").alias("target_nllb"),
    )


def provider_label(provider) -> F.Column:
    p = F.col(provider) if isinstance(provider, str) else provider
    return (F.when(p == "local", F.lit(K.PROVIDER_LABEL_LOCAL))
            .when(p == "llm", F.lit(K.PROVIDER_LABEL_LLM)).otherwise(F.lit(K.PROVIDER_LABEL_OTHER)))


def elapsed_label(elapsed_ms) -> F.Column:
    """Seconds to one decimal, rounded half up on whole milliseconds."""
    ms = F.col(elapsed_ms) if isinstance(elapsed_ms, str) else elapsed_ms
    tenths = F.floor((ms + 50) / 100).cast("bigint")
    return F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
