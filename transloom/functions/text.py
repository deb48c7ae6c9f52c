"""Scalar text functions (Column -> Column), all JVM-side built-ins.

Lengths and cuts count Unicode code points, as Spark's ``length`` and
``substring`` do, except ``byte_cut`` which cuts UTF-8 bytes on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transloom import constants as K

_TRIM_PATTERN = rf"\A{K.WHITE_SPACE_CLASS}+|{K.WHITE_SPACE_CLASS}+\z"


# The Unicode White_Space set of the trim rule (transloom.constants.WHITE_SPACE_CLASS), for Python code.
GO_SPACE = ("\t\n\x0b\f\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def go_trim(c) -> Column:
    """strip leading/trailing Unicode White_Space (Spark's trim strips only U+0020). The pattern reads the whole text, so
    a named column whose first and last character are none is left as it is."""
    trimmed = F.regexp_replace(_col(c), _TRIM_PATTERN, "")
    if not isinstance(c, str):
        return trimmed
    edges = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(edges.rlike(K.WHITE_SPACE_CLASS), trimmed).otherwise(F.col(c))


def is_blank(c) -> Column:
    return go_trim(c) == F.lit("")


def char_count(c) -> Column:
    """Code points of the trimmed text."""
    return F.length(go_trim(c))


def shorten(c, n: int) -> Column:
    """at most ``n`` code points, else the first ``n`` plus an ellipsis."""
    c = _col(c)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(K.ELLIPSIS)))


def tail(c, n: int) -> Column:
    """trimmed; longer than ``n`` code points keeps an ellipsis and the last ``n``."""
    t = go_trim(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.lit(K.ELLIPSIS), F.substring(t, -n, n)))


def byte_cut(c, n_bytes: int = K.ERROR_BYTES) -> Column:
    """first ``n_bytes`` UTF-8 bytes; a split code point becomes U+FFFD."""
    c = _col(c)
    cut = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, n_bytes).cast("string"))
    return F.when(F.octet_length(c) <= n_bytes, c).otherwise(cut)


def safe_name(c) -> Column:
    """model id to marker file stem: '/' and '\\' to '--', ':' to '-'."""
    c = _col(c)
    return F.replace(F.replace(F.replace(c, F.lit("/"), F.lit("--")), F.lit("\\"), F.lit("--")),
                     F.lit(":"), F.lit("-"))


def html_escape(c) -> Column:
    """escape & first, then <, >, \"."""
    out = _col(c)
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def strip_ansi(c) -> Column:
    """remove ANSI escape sequences, then trim."""
    return go_trim(F.regexp_replace(_col(c), K.ANSI_ESCAPE, ""))


def error_text(c) -> Column:
    """drop a leading 'Error:' (any case) and the blanks after it."""
    c = _col(c)
    return F.when(c.isNull() | (c == ""), F.lit(K.MSG_UNKNOWN_FAILURE)).otherwise(
        F.regexp_replace(c, K.ERROR_PREFIX, ""))


def trim_right_slashes(c) -> Column:
    return F.regexp_replace(_col(c), r"/+\z", "")


def endpoint(base_url) -> Column:
    """chat-completions endpoint from a base URL (suffix checks ignore case)."""
    base = trim_right_slashes(base_url)
    low = F.lower(base)
    return (F.when(low.endswith(K.COMPLETIONS_PATH), base)
            .when(low.endswith(K.V1_PATH), F.concat(base, F.lit(K.COMPLETIONS_PATH)))
            .otherwise(F.concat(base, F.lit(K.V1_PATH + K.COMPLETIONS_PATH))))


def paragraph_parts(c) -> Column:
    """paragraphs and the newline runs between them, in order, none empty."""
    return F.regexp_extract_all(_col(c), F.lit(K.PARAGRAPH_PARTS), 1)
