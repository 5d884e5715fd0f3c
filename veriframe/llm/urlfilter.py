"""URL rules by a sort-merge range join (operator 1).

A host's key is its labels in reverse, each closed with a dot (`com.example.a.`), so that a rule's host and its subdomains
are one interval of keys, and intervals nest or are apart. Bounds sampled from the keys part the key space into ranges; a
range in which one host dominates is dealt over several tasks. A rule goes to each range that its interval meets. Each task
sweeps its rules and urls in key order and keeps the stack of rules whose intervals are open; of those whose path starts the
url's, the longest wins (longer host and path together, then longer host, then block).

The sampled bounds decide only where a row is worked on. Null urls and urls without `://` have empty host and path and get
the default verdict. Null page_ids and repeated rows give a row each; repeated rules count once. Without rules all urls get
the default; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import ascii_lower, partitions

SAMPLE = 20_000  # rows for the bounds
ALLOW = "allow"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def sweep(frames):
    """Rules (kind 0) and urls (kind 1), sorted by range, key and kind; a url's row gets its rule."""
    where, stack = None, []
    for pdf in frames:
        rule, verdict = [], []
        for at, deal, k, kind, p, r, v in zip(pdf["range"], pdf["deal"], pdf["key"], pdf["kind"], pdf["path"], pdf["rule"], pdf["verdict"], strict=True):
            if (at, deal) != where:
                where, stack = (at, deal), []
            while stack and not k.startswith(stack[-1][0]):
                stack.pop()
            best = None
            if kind == 0:
                stack.append((k, p, (len(k) - 1 + len(p), len(k), v != ALLOW), r, v))
            else:
                for s in stack:
                    if p.startswith(s[1]) and (best is None or s[2] > best[2]):
                        best = s
            rule.append(best[3] if best else None)
            verdict.append(best[4] if best else ALLOW)
        urls = pdf["kind"] == 1
        yield pd.DataFrame({"page_id": pdf["page_id"], "host": pdf["host"], "path": pdf["path"], "rule": rule, "verdict": verdict})[urls]


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; rules has host, path and verdict (allow or block)."""
    spark = pages.sparkSession
    n = partitions(spark)
    urls = pages.select(F.col("page_id").cast("long"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = urls.withColumn("key", key(F.col("host")))
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna().distinct()
    rules = rules.withColumn("rule", F.concat("host", "path")).withColumn("key", key(F.col("host")))

    total = urls.count()
    some = urls.select("key") if total <= SAMPLE else urls.filter(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(total)) < SAMPLE).select("key")
    keys = sorted(r[0] for r in some.limit(2 * SAMPLE).collect())
    cuts = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    bounds = sorted(set(cuts))
    deals = [1] + [cuts.count(b) for b in bounds]  # a host over several cuts fills as many tasks
    starts = [sum(deals[:i]) for i in range(len(deals))]

    def found(k):
        return bisect.bisect_right(bounds, k)

    @F.pandas_udf("int")
    def first(k: pd.Series) -> pd.Series:
        return k.map(found).astype("int32")

    @F.pandas_udf("int")
    def last(k: pd.Series) -> pd.Series:  # of the interval of keys that start with k
        return k.map(lambda x: found(x + "\U0010ffff")).astype("int32")

    width, offset = F.array(*map(F.lit, deals)), F.array(*map(F.lit, starts))
    spread = F.pmod(F.xxhash64("page_id", "path"), F.element_at(width, F.col("range") + 1)).cast("int")
    none = F.lit(None).cast("string")
    left = urls.withColumn("range", first("key")).withColumn("deal", spread).select("range", "deal", "key", F.lit(1).alias("kind"), "page_id", "host", "path", none.alias("rule"), none.alias("verdict"))
    right = rules.withColumn("range", F.explode(F.sequence(first("key"), last("key"))))
    right = right.withColumn("deal", F.explode(F.sequence(F.lit(0), F.element_at(width, F.col("range") + 1) - 1)))
    right = right.select("range", "deal", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "rule", "verdict")
    task = F.pmod(F.element_at(offset, F.col("range") + 1) + F.col("deal"), F.lit(n)).cast("int")
    both = left.unionByName(right).withColumn("task", task)
    dealt = both.repartitionById(n, F.col("task")).sortWithinPartitions("range", "deal", "key", "kind").drop("task")
    return dealt.mapInPandas(sweep, "page_id long, host string, path string, rule string, verdict string")
