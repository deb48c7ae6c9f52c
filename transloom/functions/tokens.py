"""Token-array functions (Column -> Column) built from Spark higher-order functions.

Token ids only exist inside a model's tokenizer, so production runs the repair
steps in Python inside the translate stage (``operators.repair``). These are the
SQL twins: they serve tables that already hold id arrays, and they are what the
DuckDB oracle checks. All of them are linear in the array length for typical
input; none of them should be filtered on in the plan that computes it (the
optimizer copies the lambda tree into the filter) -- materialise first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transloom import constants as K

# Pseudo tokenizer: runs of anything but the ASCII blanks both regex engines agree on.
WORD_PATTERN = r"[^\t\n\f\r ]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """Whitespace tokens of a text (the pseudo backend's tokenizer)."""
    return F.regexp_extract_all(_col(c), F.lit(WORD_PATTERN), 0)


def chunk_array(a, size: int = K.CHUNK_TOKENS) -> Column:
    """consecutive slices of ``size``; an empty array gives no chunk."""
    a = _col(a)
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(size)),
                                             lambda i: F.slice(a, i + 1, size))).otherwise(F.array())


def source_token_count(ids, special=None, cap: int = K.MODEL_INPUT_CAP) -> Column:
    """non-special ids after truncation to ``cap``, at least 1."""
    kept = F.slice(_col(ids), 1, cap)
    if special is not None:
        kept = F.filter(kept, lambda x: ~F.array_contains(_col(special), x))
    return F.greatest(F.lit(1), F.size(kept))


def generation_budget(n) -> Column:
    """min(512, max(32, 4n + 16)) new tokens."""
    return F.least(F.lit(K.OUTPUT_CAP), F.greatest(F.lit(K.OUTPUT_FLOOR), _col(n) * 4 + 16))


def strip_special(ids, special) -> Column:
    """drop leading and trailing special ids, keep inner ones."""
    a = _col(ids)
    content = F.transform(a, lambda x: ~F.array_contains(_col(special), x))
    first = F.array_position(content, True)
    last = F.size(a) + 1 - F.array_position(F.reverse(content), True)
    return F.when(first == 0, F.slice(a, 1, 0)).otherwise(F.slice(a, first.cast("int"), (last - first + 1).cast("int")))


def collapse_repetition(ids, source_count, min_repeats: int = K.REPEAT_MIN) -> Column:
    """F16: collapse a degenerate repeated tail (closed form, linear in practice).

    Applies only when ``len >= max(4, 4 * source_count)``. The period is the
    smallest ``p <= len / min_repeats`` whose last ``(min_repeats - 1) * p``
    positions satisfy ``a[i] = a[i - p]``; the unit then repeats
    ``1 + floor(run / p)`` times, ``run`` being the longest such suffix. The
    result keeps the part before the repeats plus one unit.
    """
    a = _col(ids)
    n = F.size(a)
    need = (min_repeats - 1)

    def periodic(p):
        return F.forall(F.sequence(n - p * need + 1, n), lambda i: F.element_at(a, i) == F.element_at(a, i - p))

    candidates = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / min_repeats).cast("int"))),
                          lambda p: (p * min_repeats <= n) & periodic(p))
    p = F.try_element_at(candidates, F.lit(1))
    mismatches = F.filter(F.sequence(p + 1, n), lambda i: F.element_at(a, i) != F.element_at(a, i - p))
    last_bad = F.coalesce(F.array_max(mismatches), p)
    repeats = F.floor((n - last_bad) / p).cast("int") + 1
    keep = n - repeats * p
    collapsed = F.concat(F.slice(a, 1, F.greatest(keep, F.lit(0))), F.slice(a, n - p + 1, p))
    guarded = (n >= F.greatest(F.lit(4), _col(source_count) * 4)) & (F.size(candidates) > 0)
    return F.when(guarded, collapsed).otherwise(a)


def collapse_repetition_df(df, ids: str, source_count, out: str, min_repeats: int = K.REPEAT_MIN):
    """``collapse_repetition`` staged over projections, so the period search runs once per row."""
    a = F.col(ids)
    n = F.size(a)
    need = min_repeats - 1

    def periodic(p):
        return F.forall(F.sequence(n - p * need + 1, n), lambda i: F.element_at(a, i) == F.element_at(a, i - p))

    d = df.withColumn("_p", F.try_element_at(F.filter(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / min_repeats).cast("int"))),
        lambda p: (p * min_repeats <= n) & periodic(p)), F.lit(1)))
    p = F.col("_p")
    d = d.withColumn("_bad", F.coalesce(F.array_max(F.filter(
        F.sequence(p + 1, n), lambda i: F.element_at(a, i) != F.element_at(a, i - p))), p))
    keep = n - (F.floor((n - F.col("_bad")) / p).cast("int") + 1) * p
    collapsed = F.concat(F.slice(a, 1, F.greatest(keep, F.lit(0))), F.slice(a, n - p + 1, p))
    guarded = (n >= F.greatest(F.lit(4), _col(source_count) * 4)) & p.isNotNull()
    return d.withColumn(out, F.when(guarded, collapsed).otherwise(a)).drop("_p", "_bad")
