"""Output repair inside the translate stage (F15, F16), per generated id list.

Token ids exist only inside the model's Python worker, so these run there, per
row. ``transloom.functions.tokens`` holds the SQL twins used on tables; both
use the same closed form.
"""

from __future__ import annotations

import numpy as np

from transloom import constants as K


def strip_special(ids: list, special: set) -> list:
    """drop leading and trailing special ids."""
    keep = [i for i, t in enumerate(ids) if t not in special]
    if not keep:
        return []
    return ids[keep[0]:keep[-1] + 1]


def collapse_repetition(ids: list, source_count: int, min_repeats: int = K.REPEAT_MIN) -> list:
    """F16: if the output is at least max(4, 4 * source_count) long and ends in a unit that
    repeats ``min_repeats`` or more times, keep one unit (smallest such period wins).

    For a period p, let m be the last position whose id differs from the id p places
    before. What follows m has period p, so the unit stands ``(n - m - 1) // p + 1`` times
    at the end.
    """
    n = len(ids)
    if n < max(4, 4 * source_count):
        return ids
    a = np.asarray(ids)
    for p in range(1, n // min_repeats + 1):
        differs = np.flatnonzero(a[p:] != a[:-p])
        m = int(differs[-1]) + p if len(differs) else p - 1
        units = (n - m - 1) // p + 1
        if units >= min_repeats:
            return ids[:n - units * p] + ids[n - p:]
    return ids
