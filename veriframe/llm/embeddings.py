"""Embedding near-duplicates by int8 tile products with rigorous error bounds (operator 9).

Vectors are scaled to length 1 and quantised to int8 with a scale of their own; eps is the length of what that loses. For
two vectors |cos - q| <= |x^| eps_y + eps_x |y^| + eps_x eps_y, q the product of the quantised ones. Tiles of TILE rows are
multiplied in int8 (exactly, as small whole numbers in float); pairs whose upper bound misses the threshold are done, pairs
whose lower bound reaches it are links, and only the rest are computed again in double precision.
An item of work is a tile and a span of later ones: the tile is held, the others stream past it in batches of BATCH bytes.
Items have keys of their own, so tasks are even whatever the data; equal vectors are one row with a multiplicity. An item
gives each vector's number of links and a spanning forest of them, which takes in a block of products after the other: links
are never gathered, however many a hot group has.

Each vector goes to about half as many items as there are tiles, in the type it came in (floats stay floats), so tiles are as
large as MOST bytes allow, but small enough that all tasks have work. Work and shuffle are quadratic in distinct vectors by
the method's nature. A worker holds one tile (as doubles and as the float copy of its int8 form), a batch, and BLOCK products.
Vectors that are null, empty, zero, or hold null or non-finite components link with nothing (n_links 0, their own component).
Vectors of different lengths don't link. Repeated vec_ids give a row each; a null vec_id takes part and links by its vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from veriframe.llm.common import byte_batches, components, partitions, stash

TILE, MOST = 1024, 1 << 26  # rows of a tile at least, and bytes of its doubles at most
BATCH, BLOCK = 1 << 21, 1 << 20  # bytes of an Arrow batch, and products looked at together
THRESHOLD = 0.95
SLACK = 1e-6  # covers the rounding of the bounds themselves


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, the length of each reconstruction, and the length of what it loses; x has rows of length 1."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(x - back, axis=1)


class Tile:
    """Unit rows of one length with their int8 form, as floats for exact products; `at` are their places in the item."""

    def __init__(self, v: np.ndarray, at: np.ndarray):
        v = v.astype(np.float64)
        v /= np.abs(v).max(1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        q, self.scale, self.eps = quantise(v)
        self.v, self.at, self.q = v, at, q.astype(np.float32 if 127**2 * v.shape[1] < 1 << 24 else np.float64)  # exact sums

    def __len__(self) -> int:
        return len(self.at)


def links(x: Tile, y: Tile, threshold: float):
    """Rows i of x and j of y (i < j if they are the same tile) with cosine >= threshold, in portions of at most BLOCK products."""
    nx, ny = 1 + x.eps, 1 + y.eps
    wide = max(1, min(len(y), BLOCK >> 7))
    for left in range(0, len(x), step := max(1, BLOCK // wide)):
        for right in range(0, len(y), wide):
            if x is y and right + wide <= left:
                continue
            s, t = slice(left, left + step), slice(right, right + wide)
            dot = x.q[s] @ y.q[t].T
            # the least product that could reach the threshold, a row and a column factor at most away
            err = nx[s].max() * y.eps[t].max() + x.eps[s].max() * ny[t].max() + x.eps[s].max() * y.eps[t].max()
            low = ((threshold - err - SLACK) / (x.scale[s].max() * y.scale[t].max())).astype(np.float32) if threshold > err else -np.inf
            a, b = np.nonzero(dot >= low * (1 - 1e-5))
            i, j = a + left, b + right
            if x is y:
                a, b, i, j = (z[i < j] for z in (a, b, i, j))
            q = dot[a, b].astype(np.float64) * x.scale[i] * y.scale[j]
            e = nx[i] * y.eps[j] + x.eps[i] * ny[j] + x.eps[i] * y.eps[j] + SLACK
            maybe = q + e >= threshold
            i, j, sure = i[maybe], j[maybe], (q - e >= threshold)[maybe]
            open_ = np.flatnonzero(~sure)
            for at in range(0, len(open_), fine := max(1, BLOCK // x.v.shape[1])):
                o = open_[at : at + fine]
                sure[o] = np.einsum("ij,ij->i", x.v[i[o]], y.v[j[o]]) >= threshold
            if sure.any():
                yield i[sure], j[sure]


def by_length(v: pa.ListArray, at: np.ndarray) -> dict[int, Tile]:
    """A list column's rows as a Tile for each length that occurs; at are the rows' places."""
    begin = v.offsets.to_numpy()
    dims, flat = np.diff(begin), v.values.to_numpy(zero_copy_only=False)
    return {int(d): Tile(flat[begin[:-1][dims == d][:, None] + np.arange(d)], at[dims == d]) for d in np.unique(dims)}


class Item:
    """One item of work: links of each row so far, and a forest of them."""

    def __init__(self):
        self.first, self.tiles, self.size = [], None, 0
        self.no, self.mult, self.links, self.up = (np.zeros(0, np.int64) for _ in range(4))

    def _rows(self, batch: pa.RecordBatch) -> np.ndarray:
        at = np.arange(len(self.no), len(self.no) + batch.num_rows)
        self.no, self.mult = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((self.no, "no"), (self.mult, "n")))
        self.links, self.up = np.concatenate([self.links, np.zeros(len(at), np.int64)]), np.concatenate([self.up, at])
        return at

    def hold(self, batch: pa.RecordBatch) -> None:
        """Rows of the tile held."""
        for d, t in by_length(batch.column("v"), self._rows(batch)).items():
            self.first.append((d, t))

    def close(self, itself: bool, threshold: float) -> None:
        """The tile is whole; itself: its own pairs belong to this item."""
        self.tiles = {}
        for d in {d for d, _ in self.first}:
            parts = [t for e, t in self.first if e == d]
            whole = parts[0]
            for name in ("v", "q", "scale", "eps", "at"):
                setattr(whole, name, np.concatenate([getattr(t, name) for t in parts]))
            self.tiles[d] = whole
            if itself:
                self._take(whole, whole, threshold)
        self.first = []

    def stream(self, batch: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
        """Rows of later tiles, against the tile; what was found for them goes out, they are not kept."""
        n = len(self.no)
        for d, t in by_length(batch.column("v"), self._rows(batch)).items():
            if d in self.tiles:
                self._take(t, self.tiles[d], threshold)
        out = self.found(n)
        self.no, self.mult, self.links, self.up = (x[:n] for x in (self.no, self.mult, self.links, self.up))
        return out

    def _take(self, x: Tile, y: Tile, threshold: float) -> None:
        for i, j in links(x, y, threshold):
            i, j = x.at[i], y.at[j]
            np.add.at(self.links, i, self.mult[j])
            np.add.at(self.links, j, self.mult[i])
            self._join(i, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes links into the forest; each tree hangs from its smallest place, one step deep."""
        a, b = self.up[i], self.up[j]
        while (a != b).any():
            i, j = i[a != b], j[a != b]
            a, b = a[a != b], b[a != b]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up != (up := self.up[self.up])).any():
                self.up = up
            a, b = self.up[i], self.up[j]

    def found(self, start: int = 0) -> pa.RecordBatch:
        """no, links and up of the rows from a place on that have links."""
        hit = start + np.flatnonzero(self.links[start:] > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.no[hit]), pa.array(self.links[hit]), pa.array(self.no[self.up[hit]])], ["no", "links", "up"])


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding)."""
    spark = rows.sparkSession
    byte_batches(spark, BATCH)
    kind = "float" if isinstance(rows.schema["embedding"].dataType, ArrayType) and isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))  # one zero
    rows = stash(rows.select("vec_id", "fine", F.when(F.col("fine"), plain).alias("v")), "vectors")
    classes = rows.filter("fine").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    # a number for each distinct vector: by range of its hash, so that only the ranges' sizes meet in one place
    n = partitions(spark)
    numbered = stash(classes.withColumn("r", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()), "classes")
    per = numbered.groupBy("r").agg(F.count("*").alias("count"), F.max(F.size("v")).alias("dims")).collect()  # a row for each partition
    sizes = {r["r"]: r["count"] for r in per}
    first = {r: sum(c for q, c in sizes.items() if q < r) for r in sizes}
    total = sum(sizes.values())
    tile = max(TILE, min(-(-total // math.ceil(math.sqrt(2 * n))), MOST // (8 * max((r["dims"] for r in per), default=1))))
    tiles = max(1, -(-total // tile))
    base = F.element_at(F.create_map(*(F.lit(z) for r in first for z in (r, first[r]))), F.col("r")) if first else F.lit(0)
    numbered = numbered.withColumn("no", base + F.col("id").bitwiseAND((1 << 33) - 1)).withColumn("tile", F.floor(F.col("no") / tile))
    # work item (i, g): tile i with those after it in the g-th span of tiles; in its own span also with itself
    span = max(1, tiles * (tiles + 1) // 2 // (4 * n))
    spans = -(-tiles // span)
    tile = F.col("tile")
    held = F.transform(F.sequence(F.floor(tile / span), F.lit(spans - 1).cast("long")), lambda g: F.struct((tile * spans + g).alias("work"), F.lit(False).alias("late"), (g == F.floor(tile / span)).alias("itself")))
    past = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), tile), lambda i: i < tile), lambda i: F.struct((i * spans + F.floor(tile / span)).alias("work"), F.lit(True).alias("late"), F.lit(False).alias("itself")))
    dealt = numbered.select("no", "n", "v", F.explode(F.concat(held, past)).alias("at")).select("at.*", "no", "n", "v")
    dealt = dealt.repartition(max(n, min(tiles * spans, 4 * n)), "work").sortWithinPartitions("work", "late", "no")

    def run(batches):
        work, item, itself = None, None, False
        for b in batches:
            key = b.column("work").to_numpy() * 2 + b.column("late").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(key):
                stop = int(np.searchsorted(key, key[at], "right"))
                part, late = b.slice(at, stop - at), bool(key[at] & 1)
                if key[at] >> 1 != work:
                    if item is not None:
                        if item.tiles is None:
                            item.close(itself, threshold)
                        yield item.found()
                    work, item = key[at] >> 1, Item()
                if not late:
                    itself = part.column("itself")[0].as_py()
                    item.hold(part)
                else:
                    if item.tiles is None:
                        item.close(itself, threshold)
                    yield item.stream(part, threshold)
                at = stop
        if item is not None:
            if item.tiles is None:
                item.close(itself, threshold)
            yield item.found()

    found = stash(dealt.select("work", "late", "itself", "no", "n", "v").mapInArrow(run, "no long, links long, up long"), "tiles")
    counts = found.groupBy("no").agg(F.sum("links").alias("links"))
    roots = components(found.filter("no <> up").select(F.col("no").alias("a"), F.col("up").alias("b")))
    named = numbered.select("no", "v", "n", "rep").join(counts, "no", "left").join(roots.withColumnRenamed("node", "no"), "no", "left")
    named = named.withColumn("root", F.coalesce("root", "no")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    low = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(low, "root").select(F.col("v").alias("cv"), "links", "component")
    out = rows.join(named, rows["v"] == named["cv"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
