"""URL filters by a sort-merge range join.

A host is written as its reversed labels, each followed by a dot (``www.example.com`` becomes
``com.example.www.``), so a rule's host with all its subdomains is one interval of keys: those that
start with the rule's key. Urls and rules are dealt into key ranges, sorted, and swept once; a stack
holds the rules whose interval is open. Intervals nest, so the stack is the chain of ancestors of the
current key and the longest fitting rule is found on it.

Ranges are cut at sampled keys (as a range partitioner does; the sample only sets the cuts). A rule is
copied to each range that its interval touches: at a cut only the nested chain is open, so copies are
at most ``rules + chain length * ranges``. A key that fills several ranges is dealt over all of them.

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule; a url without
a path fits no rule, since each rule's path starts with ``/``; repeated urls each get their own row;
an empty table gives no rows; other columns of the input are ignored. An empty rule table, or a url that
no rule fits, gets the default verdict.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import lower_ascii, pieces, width
from transloom.session import ship_package

#: Urls in one key range, about.
RANGE_ROWS = 200_000
#: Sampled keys per range, at most about this many go to the driver for each range.
SAMPLE_PER_RANGE = 64

Rule = tuple[str, str, str]  # host, path, verdict


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns of a url."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw_host) + 1), r"^[^?#]*", 0)
    return lower_ascii(raw_host), path


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def _sweep(batches: Iterable[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by range, key, rules first; emits a row per url."""
    bucket = None
    stack: list[tuple[str, dict[str, str], set[int]]] = []  # key, path -> verdict, path lengths
    for pdf in batches:
        out = []
        for b, key, path, is_url, page_id, host, verdict in zip(
                pdf["bucket"], pdf["key"], pdf["path"], pdf["is_url"], pdf["page_id"], pdf["host"], pdf["verdict"]):
            if b != bucket:
                bucket, stack = b, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                stack[-1][1][path] = verdict
                stack[-1][2].add(len(path))
                continue
            best = None
            for k, rules, lengths in stack:
                for n in lengths:
                    if n <= len(path) and path[:n] in rules:
                        rank = (len(k) - 1 + n, len(k))
                        if best is None or rank > best[0]:
                            best = (rank, k, path[:n], rules[path[:n]])
            if best is None:
                out.append((page_id, host, path, None, default))
            else:
                out.append((page_id, host, path, ".".join(reversed(best[1][:-1].split("."))) + best[2], best[3]))
        if out:
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per url: id, host, path, the longest fitting rule and its verdict (else ``default``)."""
    spark = pages.sparkSession
    ship_package(spark)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    as_key = lambda h: F.concat(F.array_join(F.reverse(F.split(h, r"\.", -1)), "."), F.lit("."))
    urls = urls.withColumn("key", as_key(F.col("host")))
    n_rows = urls.count()
    n = pieces(n_rows, range_rows, width(spark, 1) if n_rows else 1)
    share = min(1.0, n * SAMPLE_PER_RANGE / max(1, n_rows))
    drawn = sorted(tuple(r) for r in urls.select("key", "path").sample(False, share, 17).collect())
    cuts = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    held = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, path: pd.Series, salt: pd.Series) -> pd.Series:
        out = []
        for k, p, s in zip(key, path, salt):
            low, high = bisect_left(held.value, (k, p)), bisect_right(held.value, (k, p))
            out.append(low + s % (high - low + 1))
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(held.value, (k,)), bisect_right(held.value, (k + "\U0010ffff",)) + 1))
                          for k in key])

    salt = F.xxhash64("page_id", "host", "path").bitwiseAND(0x7FFFFFFF).cast("int")
    urls = urls.select(range_of("key", "path", salt).alias("bucket"), "key", "path", F.lit(True).alias("is_url"),
                       "page_id", "host", F.lit(None).cast("string").alias("verdict"))
    rules = rules.select(as_key(lower_ascii(F.col("host"))).alias("key"), "path", "verdict")
    rules = rules.groupBy("key", "path").agg(F.min("verdict").alias("verdict"))
    rules = rules.select(F.explode(ranges_of("key")).alias("bucket"), "key", "path", F.lit(False).alias("is_url"),
                         F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("host"), "verdict")
    dealt = urls.unionByName(rules).repartition(n, "bucket").sortWithinPartitions("bucket", "key", "is_url", "path")
    return dealt.mapInPandas(lambda it: _sweep(it, default),
                             "page_id bigint, host string, path string, rule string, verdict string")
