"""Quality rules, line first.

Every line is judged on its own (navigation, boilerplate, symbols, shouting, punctuation); failing lines
are removed; a document that loses too large a share of its words is rejected, and so is one that fails
the base rules on its whole text. All work is per document, so nothing is shuffled.

Punctuation alone is judged on the paragraph where lines are hard-wrapped: a line goes on in the next one when it is
at most ``MAX_WRAP`` characters long and the next line's first word would have taken it past three quarters of the
width of its block (the longest line between blank, failing or longer lines; at least ``MIN_WRAP``). One sentence end
in the paragraph is enough for all its lines. An item of a list (a line that begins with a bullet, or a number and '.' or
')') is not asked for a sentence end.

What that means for texts that aren't prose: lists with markers stay; verse, source code, and lists of long lines without
markers and stops (ingredients, say) lose their lines, and a text that is mostly such is rejected.

Edge cases: a null text counts as empty; an empty or blank text has no words and fails the base rules; repeated
rows and ids are judged row by row; other columns of the input are ignored by ``quality_report`` and kept by
``clean_documents``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transloom.llm.common import slices
from transloom.session import ship_package

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document is rejected when its failing lines hold more than this share of its words.
MAX_LOST = 0.3
#: Lines of fewer words are not asked for a sentence end, nor judged as shouting or symbols.
FEW_WORDS = 5

#: Width of a block of hard-wrapped lines, in characters.
MIN_WRAP, MAX_WRAP = 40, 120

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Patterns in the common subset of regular expressions, so that SQL engines can use them too.
SENTENCE_END = r"[.!?…。！？:;][\"'»”’)\]]*([\x20\x09-\x0D]|$)"
#: What else ends a sentence: closing marks that SENTENCE_END lacks, wide marks (no space follows them), the marks of
#: other scripts, and a space or the line's end after Thai or Lao, which are written without marks.
OTHER_END = (r"[.!?…:;][\"'»”’)\]“‘«‹›」』）】]*(\s|$)|[。！？｡．：；]"
             r"|[।॥۔؟؛։׃܀-܂߹፡።፤፧፨၊။។៕།༎᠃᠉᙮᱾᱿꓿꘎꘏꯫꧉\u037E\u0387‼⁇⁈⁉‽][\"'»”’)\]“‘«‹›」』）】]*(\s|$)"
             r"|[\u0E01-\u0EFF][\"'»”’)\]]*(\s|$)")
SEPARATORS = ["|", "›", "»", ">", "•", "·", "/"]
BOILERPLATE = (r"\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses? cookies|"
               r"accept (all )?cookies|enable javascript|javascript is (disabled|required)|lorem ipsum|"
               r"click here|subscribe to our newsletter|skip to (main )?content|powered by)\b")
LIST_ITEM = r"^[\x20\x09]*([-*+•‣–]|[0-9]{1,3}[.)])[\x20\x09]+[^\x20\x09-\x0D]"
DECORATED = r"[*]{3}|[$]{3}|#{3}|%{3}|&{3}|!!"

_SENTENCE_END, _OTHER_END, _DECORATED = re.compile(SENTENCE_END), re.compile(OTHER_END), re.compile(DECORATED)
_LIST_ITEM = re.compile(LIST_ITEM)
_BOILERPLATE = re.compile(BOILERPLATE, re.IGNORECASE | re.ASCII)
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = frozenset(x.encode() for x in SEPARATORS)


def _shouts(line: str, raw: bytes) -> bool:
    """At least 20 letters, more than 7 in 10 of them capitals."""
    if 10 * (len(raw) - len(raw.translate(None, _LOWER))) >= 3 * len(line):
        return False  # enough small letters already, whatever the rest is
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 20 and 10 * sum(map(str.isupper, letters)) > 7 * len(letters)


def line_fault(line: str) -> str | None:
    """The first rule that a line fails, or None. A line without a word has no fault."""
    raw = line.encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    if not n:
        return None
    n_separators = sum(map(_SEPARATORS.__contains__, found))
    if n_separators >= 2 and 4 * n_separators >= n:
        return "navigation"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    if n < FEW_WORDS:
        return None
    if _DECORATED.search(line) and 2 * sum(1 for w in found if _DECORATED.search(w.decode("utf-8", "surrogatepass"))) > n:
        return "symbols"
    if _shouts(line, raw):
        return "shouting"
    if not _ends_sentence(line) and not _LIST_ITEM.match(line):
        return "punctuation"
    return None


def _ends_sentence(line: str) -> bool:
    return bool(_SENTENCE_END.search(line) or _OTHER_END.search(line))


def line_faults(lines: list[str]) -> list[str | None]:
    """The fault of each line of a text; a hard-wrapped line is asked for the sentence end of its paragraph."""
    by_line = {line: line_fault(line) for line in set(lines)}
    faults = [by_line[line] for line in lines]
    if "punctuation" not in by_line.values():
        return faults
    bare = [line.strip(WHITE) for line in lines]
    wraps = [0 < len(b) <= MAX_WRAP and f in (None, "punctuation") for b, f in zip(bare, faults)]
    start = 0
    while start < len(lines):
        stop = start + 1
        if wraps[start]:
            while stop < len(lines) and wraps[stop]:
                stop += 1
            _excuse(bare, faults, start, stop)
        start = stop
    return faults


def _excuse(bare: list[str], faults: list[str | None], start: int, stop: int) -> None:
    """Takes the fault from the lines ``start`` to ``stop``, a block, whose paragraph has a sentence end."""
    if "punctuation" not in faults[start:stop]:
        return
    wide = max(map(len, bare[start:stop]))
    first = start
    for i in range(start, stop):
        if i + 1 < stop and wide >= MIN_WRAP and 4 * (len(bare[i]) + 1 + len(bare[i + 1].split(None, 1)[0])) > 3 * wide:
            continue
        if first < i and any(map(_ends_sentence, bare[first:i + 1])):
            faults[first:i + 1] = [None] * (i + 1 - first)
        first = i + 1


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window that is found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # Names of windows of 1, 2, 4, ... words: equal names mean equal windows, so the count is exact.
    names, size = ids, 1
    while size < window:
        step = min(size, window - size)
        pair = names[:len(names) - step] * (names.max() + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1]
        size += step
    again = np.bincount(names)[names] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def judge(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost, kept, clean text)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in WHITE)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines, seen, n_dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(WHITE):
            n_dup += line in seen
            seen.add(line)
    n_repeat = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    good = [line for line, fault in zip(lines, line_faults(lines)) if fault is None]
    n_good = sum(len(line.encode("utf-8", "surrogatepass").split()) for line in good) if len(good) < len(lines) else n_words
    lost = 1 - n_good / n_words if n_words else 0.0
    return (n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, lost,
            not base_failed and lost <= MAX_LOST, "\n".join(good))


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "kept")


def _report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    for batch in slices(batches):
        rows = list(zip(*(judge(t)[:8] for t in batch.column(1).to_pylist()))) or [()] * 8
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds))],
                                         ["doc_id", *REPORT])


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, ``base_failed``, the share of words lost to line rules, ``kept``."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _report, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                 "n_repeat_words bigint, base_failed boolean, lost_share double, kept boolean")


def clean_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The kept documents, all columns, with their failing lines removed. A null text is never kept."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            judged = [judge(t) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array([j[8] for j in judged], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(
                pa.array([j[7] for j in judged], pa.bool_()))

    schema = T.StructType([T.StructField(f.name, T.StringType() if i == at else f.dataType, True)
                           for i, f in enumerate(docs.schema.fields)])
    return docs.mapInArrow(clean, schema)
