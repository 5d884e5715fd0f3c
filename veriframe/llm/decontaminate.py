"""Benchmark decontamination by size-partitioned MinHash containment search (operator 6), in DataFrame operations only.

Words are runs without ASCII white space, A-Z lower-cased; a shingle is five of them (an item of fewer words is one shingle
of all of them). An item is contained in a document if at least 0.8 of its distinct shingles occur in it.

Candidates: of an item with n shingles at most n - ceil(0.8 n) may be missing, so one of any n - ceil(0.8 n) + 1 occurs in
each document that contains it. The signature is that many least hashes, so its length follows the item's size, and the
search has no misses however long the document is. Items are parted into size classes (powers of two); a document only
probes with hashes up to the largest signature hash of the classes it is long enough to contain.
Verification: the shingles themselves, as strings, are intersected for each candidate pair.

Null or blank texts contain nothing and blank items are in nothing. Rows with null ids take part; repeated rows of a
document or item count once. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import ascii_lower, packed, stash

SIZE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 500_000  # signature hashes or candidate ids of up to 16 bytes


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def once(c: Column) -> Column:
    """Makes an array a column of its own, so that a lambda over it doesn't compute it again for each element."""
    return F.explode(F.array(c))


def grams(column: str, size: int, make) -> Column:
    """make(the size neighbours) from each place of an array column."""
    last = F.size(column) - (size - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make(*(F.element_at(F.col(column), i + j) for j in range(size))))


def _join(big: DataFrame, small: DataFrame, rows: int, on, how: str = "inner") -> DataFrame:
    """Broadcasts the small side only if its counted rows are few; else both are shuffled."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def _need(n: Column) -> Column:
    return F.ceil(n * F.lit(THRESHOLD) - F.lit(1e-9))


def _key(docs: DataFrame) -> dict[str, Column]:
    """A row's key: its id and the hash of its text, as ids can be null or repeated."""
    return {"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__th": F.xxhash64(F.col("text").cast("string"))}


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """__k, __th, doc_id, item_id, n_item and n_shared of rows that contain an item."""
    key = ["__k", "__th"]
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text")).withColumns(_key(docs))
    items = items.select(F.col("item_id").cast("long"), once(words(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(SIZE)))
    shingle, shingle_hash = F.lit(None).cast("array<string>"), F.lit(None).cast("array<bigint>")
    for size in range(1, SIZE + 1):
        here = F.col("len") == size
        shingle = F.when(here, grams("w", size, lambda *x: F.concat_ws(" ", *x))).otherwise(shingle)
        shingle_hash = F.when(here, grams("w", size, lambda *x: F.xxhash64(*(F.xxhash64(y) for y in x)))).otherwise(shingle_hash)
    items = items.select("item_id", "len", F.array_distinct(shingle).alias("shingles"), F.array_sort(F.array_distinct(shingle_hash)).alias("hashes"))
    items = items.withColumn("n", F.size("shingles")).withColumn("need", _need(F.col("n")))
    items = stash(items.dropDuplicates(["item_id", "shingles"]), "items")

    sig = items.withColumn("sig", F.slice("hashes", 1, (F.col("n") - F.col("need") + 1).cast("int")))
    classes = sig.groupBy("len", F.floor(F.log2("n")).alias("class")).agg(F.max(F.element_at("sig", -1)).alias("top"), F.min("need").alias("need"))
    classes = classes.orderBy("len", "class").collect()  # at most 5 lengths x 32 sizes
    sig = sig.select(F.explode("sig").alias("h"), "item_id", "need")
    n_sig = sig.count()

    probes = docs.select(*key, once(F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).alias("w"))
    found = []
    for size in sorted({c["len"] for c in classes}):
        top, count = F.lit(None).cast("bigint"), F.size("w") - (size - 1)
        for c in classes:
            if c["len"] == size:
                top = F.greatest(top, F.when(count >= c["need"], F.lit(c["top"])))
        short = probes.select(*key, "w", count.alias("count"), top.alias("top")).filter("top is not null")
        hashes = F.filter(grams("w", size, lambda *x: F.xxhash64(*x)), lambda h: h <= F.col("top"))
        found.append(short.select(*key, "count", F.explode(hashes).alias("h")))
    if not found:
        found = [docs.limit(0).select(*key, F.lit(0).alias("count"), F.lit(0).cast("bigint").alias("h"))]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    pairs = _join(rows, sig, n_sig, "h").filter("count >= need").select(*key, "item_id").distinct()
    pairs = stash(pairs, "candidates")

    texts = _join(docs, pairs.select(*key).distinct(), pairs.count(), key, "left_semi")
    texts = texts.select(*key, "doc_id", once(words(F.col("text"))).alias("w"))
    both = pairs.join(texts, key).join(items.withColumnRenamed("item_id", "item"), F.col("item_id").eqNullSafe(F.col("item")))
    own = F.lit(None).cast("array<string>")
    for size in sorted({c["len"] for c in classes}):
        own = F.when(F.col("len") == size, grams("w", size, lambda *x: F.concat_ws(" ", *x))).otherwise(own)
    shared = F.size(F.array_intersect(F.col("shingles"), own))
    both = both.select(*key, "doc_id", "item_id", F.col("n").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"), "need")
    return both.filter("n_shared >= need")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs doc_id, item_id of documents that contain an item, with n_item, n_shared and containment."""
    share = F.expr("n_shared / n_item")
    both = _contained(docs, items).groupBy("doc_id", "item_id").agg(F.max_by("n_item", share).alias("n_item"), F.max_by("n_shared", share).alias("n_shared"))
    return both.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, by_row: bool = False) -> DataFrame:
    """docs without the rows that contain an item; unless by_row, also without all other rows of their doc_id (null is one)."""
    key = ["__k", "__th"] if by_row else ["__k"]
    hit = stash(_contained(docs, items).select(*key).distinct(), "hits")
    keyed = docs.select(packed(docs), *(c.alias(k) for k, c in _key(docs).items()))
    return _join(keyed, hit, hit.count(), key, "left_anti").select("row.*")
