"""Order-dependent reads within a key that stay parallel when one key is hot.

A plain ``lag`` over ``Window.partitionBy(key)`` puts every row of a key into
one task. Here each key is cut into blocks of the (numeric) order column;
windows run per ``(key, block)``, and only one summary row per block crosses
block borders. A key holding a third of all rows is then spread over as many
tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 22  # order-column units per block


def _block(order: str, block: int):
    return F.floor(F.col(order) / F.lit(block)).cast("bigint")


def keyed_lag(df: DataFrame, keys: list[str], order: str, cols: list[str], block: int = DEFAULT_BLOCK,
              prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>``: the value of ``c`` on the previous row (by ``order``) of the same key.

    The last row of each block is a plain ``max_by`` aggregate of the input (partial before its
    shuffle); the rows themselves are shuffled once, for the window and the join alike.
    """
    blk = "_blk"
    d = df.withColumn(blk, _block(order, block))
    last = d.groupBy(*keys, blk).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy(blk)
    carry = last.select(*keys, blk, F.lag("_last").over(wb).alias("_carry"))
    w = Window.partitionBy(*keys, blk).orderBy(order)
    d = d.join(carry, [*keys, blk], "left").withColumn("_in", F.lag(F.struct(*cols)).over(w))
    before = F.coalesce("_in", "_carry")
    return d.select(*df.columns, *[before[c].alias(prefix + c) for c in cols])


def runs(df: DataFrame, keys: list[str], order: str, t: str, max_gap: int, block: int = DEFAULT_BLOCK,
         name: str = "run") -> DataFrame:
    """Add ``name``: the order value of the first row of the row's run. A run of a key ends where
    ``t`` grows by more than ``max_gap``; it may go on over any number of blocks."""
    blk = "_blk"
    w = Window.partitionBy(*keys, blk).orderBy(order)
    d = df.withColumn(blk, _block(order, block)).withColumns({"_lag": F.lag(t).over(w)})
    d = d.withColumn("_start", F.when(F.col(t) - F.col("_lag") > max_gap, F.col(order)))  # unknown for a block's first row
    edge = d.groupBy(*keys, blk).agg(F.min(order).alias("_head"), F.min_by(t, F.col(order)).alias("_t0"),
                                     F.max_by(t, F.col(order)).alias("_t1"), F.max("_start").alias("_last"))
    wb = Window.partitionBy(*keys).orderBy(blk)
    new = F.lag("_t1").over(wb).isNull() | (F.col("_t0") - F.lag("_t1").over(wb) > max_gap)
    edge = edge.withColumn("_own", F.when(new, F.col("_head")))  # the block's first row starts a run
    upto = wb.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_open", F.coalesce("_own", F.last(F.coalesce("_last", "_own"), ignorenulls=True).over(upto)))
    d = d.withColumn("_in", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.join(edge.select(*keys, blk, "_open"), [*keys, blk], "left").select(
        *df.columns, F.coalesce("_in", "_open").alias(name))
