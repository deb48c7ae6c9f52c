"""JSON values read strictly: the whole text must be one value, as a strict decoder asks.

``try_parse_json`` stops after the first value and takes trailing text; here the value is parsed
between brackets with a mark behind it, so anything that follows it breaks the array or
moves the mark. A repeated key takes its last value (``allow_repeated_keys``).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def allow_repeated_keys(spark: SparkSession) -> None:
    """Ask the session's VARIANT parser to keep the last of repeated keys instead of failing."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def plain_keys(text, *keys: str) -> Column:
    """JSON text with every spelling of these keys in lower case, as a decoder reads it that matches names in any case.
    A quoted word before a colon is a key: inside a string its quotes are escaped. Text without such a key is not touched."""
    text = F.col(text) if isinstance(text, str) else text
    before, after = r'(?<!\\)"', r'"(?=\s*:)'
    out = text
    for key in keys:
        out = F.regexp_replace(out, f"{before}(?i:{key}){after}", f'"{key}"')
    odd = rf"{before}(?=[A-Za-z]*[A-Z])(?i:{'|'.join(keys)}){after}"
    return F.when(text.rlike(odd), out).otherwise(text)


def boxed(text) -> Column:
    """Step 1: VARIANT ``[value, mark]``, NULL if the text is no JSON. Make it a column, then ``unboxed``."""
    text = F.col(text) if isinstance(text, str) else text
    mark = F.concat(F.lit('"'), F.xxhash64(text).cast("string"), F.lit('"'))
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]")))


def unboxed(box: Column) -> Column:
    """Step 2: the value, NULL unless it is the only one."""
    parts = F.try_variant_get(box, "$", "array<variant>")
    return F.when(F.size(parts) == 2, F.variant_get(box, "$[0]", "variant"))


def kind(v: Column, path: str = "$") -> Column:
    """'MISSING', 'VOID' (JSON null), or the variant type name."""
    return F.coalesce(F.schema_of_variant(F.variant_get(v, path, "variant")), F.lit("MISSING"))


def absent(k: Column) -> Column:
    return k.isin("MISSING", "VOID")


def string_or_absent(v: Column, path: str) -> Column:
    k = kind(v, path)
    return absent(k) | (k == "STRING")


def object_or_absent(v: Column, path: str) -> Column:
    k = kind(v, path)
    return absent(k) | k.startswith("OBJECT")


def string(v: Column, path: str) -> Column:
    return F.coalesce(F.variant_get(v, path, "string"), F.lit(""))
