"""Settings normalisation (P9, S3) and the model catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.functions.json import allow_repeated_keys, boxed, kind, string_or_absent, unboxed
from transloom.functions.text import go_trim, safe_name, trim_right_slashes
from transloom.sources import dims

TEXT_KEYS = ("provider", "localModel", "llmBaseUrl", "llmModel", "llmApiKey", "quickOpenShortcut", "sourceLanguage",
             "targetLanguage")
FLAG_KEYS = ("clipboardEnabled", "quickOpenEnabled", "closeToTray", "alwaysOnTop", "minimalMode", "darkMode")
LEGACY_FLAG = "shortcutEnabled"

# Normalised defaults, used for tenants that have no settings row.
DEFAULTS_ROW = {
    "provider": K.DEFAULT_PROVIDER,
    "local_model": K.DEFAULT_LOCAL_MODEL,
    "llm_base_url": "",
    "llm_model": "",
    "clipboard_enabled": True,
    "quick_open_enabled": True,
    "source_language": K.DEFAULT_SOURCE,
    "target_language": K.DEFAULT_TARGET,
}


def _value(entries: Column, key: str) -> Column:
    """The value of a key: the exact spelling first, else any spelling that differs in case."""
    exact = F.filter(entries, lambda e: e["key"] == key)
    alike = F.filter(entries, lambda e: F.lower(e["key"]) == key.lower())
    return F.coalesce(F.try_element_at(exact, F.lit(-1)), F.try_element_at(alike, F.lit(-1)))["value"]


def normalize_settings(settings_raw: DataFrame, keep: tuple = ()) -> DataFrame:
    """Defaults for missing keys, legacy clipboard key, provider/model/URL clean-up.

    A document that is no JSON object, or holds a value of the wrong type, is refused:
    ``settings_error`` says so, and the other columns hold the defaults. JSON null keeps
    the default. Keys match in any case, the exact spelling first.
    """
    allow_repeated_keys(settings_raw.sparkSession)
    s = settings_raw.select("tenant", *keep, boxed(F.coalesce("raw", F.lit(""))).alias("_box")).withColumn("_v", unboxed(F.col("_box")))
    s = s.withColumn("_e", F.map_entries(F.when(kind(F.col("_v")).startswith("OBJECT"),
                                                F.variant_get("_v", "$", "map<string,variant>"))))
    keys = (*TEXT_KEYS, *FLAG_KEYS, LEGACY_FLAG)
    s = s.select("tenant", *keep, F.col("_e").isNotNull().alias("_ok"), *[_value(F.col("_e"), k).alias(k) for k in keys])
    no_flag = F.col("clipboardEnabled").isNull()  # only then is the legacy key read
    typed = F.col("_ok")
    for k in TEXT_KEYS:
        typed = typed & string_or_absent(F.col(k), "$")
    for k in FLAG_KEYS:
        typed = typed & kind(F.col(k)).isin("MISSING", "VOID", "BOOLEAN")
    typed = typed & (~no_flag | kind(F.col(LEGACY_FLAG)).isin("MISSING", "VOID", "BOOLEAN"))
    s = s.withColumn("_ok", typed)
    text = lambda k: F.when(F.col("_ok"), F.try_variant_get(F.col(k), "$", "string"))
    flag = lambda k: F.when(F.col("_ok"), F.try_variant_get(F.col(k), "$", "boolean"))
    model = F.coalesce(text("localModel"), F.lit(K.DEFAULT_LOCAL_MODEL))
    source, target = F.coalesce(text("sourceLanguage"), F.lit("")), F.coalesce(text("targetLanguage"), F.lit(""))
    return s.select(
        "tenant", *keep,
        F.when(text("provider") == "llm", F.lit("llm")).otherwise(F.lit("local")).alias("provider"),
        F.when(go_trim(model) == "", F.lit(K.DEFAULT_LOCAL_MODEL)).otherwise(model).alias("local_model"),
        trim_right_slashes(go_trim(F.coalesce(text("llmBaseUrl"), F.lit("")))).alias("llm_base_url"),
        go_trim(F.coalesce(text("llmModel"), F.lit(""))).alias("llm_model"),
        F.coalesce(flag("clipboardEnabled"), F.when(no_flag, flag(LEGACY_FLAG)), F.lit(True)).alias("clipboard_enabled"),
        F.coalesce(flag("quickOpenEnabled"), F.lit(True)).alias("quick_open_enabled"),
        F.when(source == "", F.lit(K.DEFAULT_SOURCE)).otherwise(source).alias("source_language"),
        F.when(target == "", F.lit(K.DEFAULT_TARGET)).otherwise(target).alias("target_language"),
        F.when(F.col("_ok"), F.lit("")).otherwise(F.lit(K.MSG_SETTINGS_ERROR)).alias("settings_error"),
    )


def one_per_tenant(settings_raw: DataFrame) -> DataFrame:
    """S3: one row per tenant, ``(tenant, raw, conflict)``. Equal documents of a tenant count once; if they differ,
    none of them is followed: ``conflict`` is true and ``raw`` the smallest in byte order."""
    raw = F.coalesce("raw", F.lit(""))
    return settings_raw.groupBy("tenant").agg(F.min(raw).alias("raw"), (F.min(raw) != F.max(raw)).alias("conflict"))


def tenant_settings(settings_raw: DataFrame) -> DataFrame:
    """Normalised settings, one row per tenant; different documents of one tenant are a ``settings_error``."""
    one = one_per_tenant(settings_raw)
    usable = one.select("tenant", F.when(F.col("conflict"), F.lit("{}")).otherwise(F.col("raw")).alias("raw"), "conflict")
    return normalize_settings(usable, keep=("conflict",)).withColumn(
        "settings_error", F.when(F.col("conflict"), F.lit(K.MSG_SETTINGS_CONFLICT)).otherwise(F.col("settings_error"))).drop("conflict")


def model_catalog(settings_raw: DataFrame) -> DataFrame:
    """Per tenant, both models with downloaded / selected / default flags."""
    spark = settings_raw.sparkSession
    s = tenant_settings(settings_raw).select("tenant", "local_model")
    # The catalog is a fixed list: expand it per tenant by a narrow explode, no join.
    fixed = F.array(*[F.struct(F.lit(mid).alias("model"), F.lit(name).alias("name"), F.lit(size).alias("size"),
                               F.lit(default).alias("is_default"))
                      for mid, name, _desc, size, default in K.MODELS])
    cat = s.select("tenant", "local_model", F.inline(fixed))
    markers = dims.ready_markers(spark)
    cat = cat.join(markers, F.concat(safe_name(cat["model"]), F.lit(".ready")) == markers["marker"], "left")
    return cat.select(
        "tenant", "model", "name", "size",
        F.col("marker").isNotNull().alias("downloaded"),
        (F.col("local_model") == F.col("model")).alias("selected"),
        F.col("is_default").alias("is_default"),
    )
