"""Connected components over an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import cut


def _forest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each Arrow batch of edges becomes stars around the smallest node: same components, no more edges than nodes."""
    for pdf in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        yield pd.DataFrame([(x, r) for x in list(parent) if (r := root(x)) != x], columns=["u", "v"], dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint edges of distinct nodes -> (node, root): each node that is not its component's smallest one."""
    now = cut(edges.mapInPandas(_forest, "u bigint, v bigint").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(state)
        now = cut(_small_star(_large_star(now)), "edges")
