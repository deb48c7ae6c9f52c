"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled from labelled texts; a text is cut into
blocks and every block is compressed with every dictionary; the language with the smallest total wins. The
prediction is rejected (flagged) when the runner-up is almost as small.

Texts are folded first (lower case, runs without letters become one space), so that junk symbols, digits and
shouting do not count as language.

The dictionaries are fitted on a bounded sample of labelled rows: at most ``sample_docs`` documents of each
language, those with the smallest hash; of each an equal share of ``dict_bytes``, taken as ``SLICES`` pieces spread over the
whole text (a shorter text whole, what it leaves goes to the others). So the bound that acts is ``dict_bytes`` per language, and every sampled
document is in it. At most ``max_langs`` languages are learned, those with the most labelled rows: prediction costs one
compression for each. Prediction reads whole texts, per document, without a shuffle; all texts are measured alike, at the
same levels.

Edge cases: null text, or a text without a letter: ``und``, score 0. Equal sizes go to the language that is
first in order of name. Without any labelled row every text is ``und``. With one learned language every text
with a letter gets it, score 1. Repeated rows are predicted row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.llm.common import slices
from transloom.session import ship_package

SAMPLE_DOCS = 200
SLICES = 4
MAX_LANGS = 256
DICT_BYTES = 128 * 1024
BLOCK_BYTES = 4_096
#: Every text is compressed at each of these levels and the sizes are added: short texts often tie at one.
LEVELS = (7, 3)
#: Below this relative distance to the runner-up a prediction is flagged as rejected.
NARROW = 0.02

_NO_LETTER = re.compile(rb"[^a-z\x80-\xff]+")


def fold(text: str) -> bytes:
    return _NO_LETTER.sub(b" ", text.lower().encode("utf-8", "surrogatepass"))


def spread(text: str, chars: int, slices: int = SLICES) -> str:
    """About ``chars`` characters of a text: it whole, or equal pieces from its beginning to its end."""
    if len(text) <= chars:
        return text
    size = max(1, chars // slices)
    return " ".join(text[i * (len(text) - size) // max(1, slices - 1):][:size] for i in range(slices))


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, max_langs: int = MAX_LANGS) -> dict[str, bytes]:
    """Dictionary content by language. Of each language ``sample_docs`` texts, cut to ``dict_bytes`` in all, reach the driver."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    largest = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    counts = {r[0]: r[1] for r in largest}
    if not counts:
        return {}
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * sample_docs / n))]),
                        F.col(lang_col))
    mark = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).bitwiseAND(0x7FFFFFFF)
    best = Window.partitionBy("lang").orderBy("mark", "text")
    drawn = rows.select(F.col(lang_col).alias("lang"), mark.alias("mark"), rate.alias("rate"), F.col(text_col).alias("text")) \
        .where(F.col("mark") < F.col("rate") * float(1 << 31)) \
        .withColumn("place", F.row_number().over(best)).where(F.col("place") <= sample_docs)
    # no text needs to move more than a whole dictionary
    size, piece = F.length("text"), max(1, dict_bytes // SLICES)
    spread_out = F.concat_ws(" ", *[F.substr("text", (F.floor((size - piece) * i / (SLICES - 1)) + 1).cast("int"), F.lit(piece))
                                    for i in range(SLICES)])
    drawn = drawn.select("lang", "place", F.when(size <= dict_bytes, F.col("text")).otherwise(spread_out).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in drawn.orderBy("lang", "place").toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: fill(v, dict_bytes) for k, v in texts.items()}


def fill(texts: list[str], dict_bytes: int) -> bytes:
    """Dictionary content: an equal share of each text, what short ones leave shared among the longer ones."""
    out, left = {}, dict_bytes
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share = left // (len(texts) - done)
        out[i] = fold(spread(texts[i], share))[:share]
        left -= len(out[i])
    return b" ".join(out[i] for i in range(len(texts)))[:dict_bytes]


class Identifier:
    """Compressors for each language, ready to use in one task."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.compressors = [[self._compressor(content[k], level) for level in LEVELS] for k in self.langs]

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        learned = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        learned.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=learned, write_content_size=False,
                                        write_checksum=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, relative distance of the runner-up)."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        folded = fold(text)
        blocks = [folded[i:i + BLOCK_BYTES] for i in range(0, len(folded), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for c in own for b in blocks) for own in self.compressors]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.langs[0], 1.0
        first, second = sizes[order[0]], sizes[order[1]]
        return self.langs[order[0]], (second - first) / second


def predict(docs: DataFrame, content: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text",
            narrow: float = NARROW, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, the ``extra`` columns, lang_pred, score in [0, 1], rejected."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(content)
    extra = extra or {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Identifier(held.value)
        for batch in slices(batches):
            found = [known.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            langs, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([s < narrow for s in scores], pa.bool_())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *[c.alias(k) for k, c in extra.items()],
                       F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
