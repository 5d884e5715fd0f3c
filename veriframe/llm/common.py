"""What the corpus operators share: reading tables, stashing intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on one machine (tests) may do without naming one."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="veriframe-")
        sc.setCheckpointDir(d)
    return d


def stash(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df once to the shared folder and reads it back.

    The lineage is cut and, unlike checkpoint(), the plan runs once and the files are columnar and compressed;
    a lost executor takes nothing with it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Deletes a table that stash() wrote, when nothing reads it any more."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame) -> Column:
    """All columns of df as one, row, so that columns added beside it can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def byte_batches(spark: SparkSession, size: int = 1 << 20, rows: int = 50_000) -> None:
    """Arrow batches of about `size` bytes: many rows of numbers, or few long texts."""
    small_batches(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go as soon as the query that made them has ended; whoever needs its rows has stashed them."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def binary(column) -> list:
    """Values of a string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches, keys: list[str]):
    """Numpy columns of a sorted stream, cut so that rows with equal keys are never parted.

    Only the last group of a batch is carried over: memory is that of a batch and of the largest group.
    """
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if rest is not None:
            got = {n: np.concatenate([rest[n], v]) for n, v in got.items()}
        n = len(got[keys[0]])
        same = np.ones(n, bool)
        for k in keys:
            same &= got[k] == got[k][-1]
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = {k: v[cut:] for k, v in got.items()}
        if cut:
            yield {k: v[:cut] for k, v in got.items()}
    if rest is not None and len(rest[keys[0]]):
        yield rest


def starts(got: dict, keys: list[str]) -> np.ndarray:
    """First row of each group, and the number of rows at the end."""
    n = len(got[keys[0]])
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= got[k][1:] != got[k][:-1]
    return np.append(np.flatnonzero(new), n)


class Forest:
    """Union-find over a bounded group; the roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


EDGES = 1 << 18  # edges that a task links at once


def span(batches):
    """Edges (node, smallest node) that connect what the edges (a, b) of a stream connect, EDGES of them at a time."""
    names, held, size = ["a", "b"], [], 0

    def flush():
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in at.reshape(2, -1).T.tolist():
            forest.join(i, j)
        up = np.array([forest.root(i) for i in range(len(nodes))])
        moved = np.flatnonzero(up != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[up[moved]])], names)

    for b in batches:
        if b.num_rows:
            held.append(np.array([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            size += b.num_rows
        if size > EDGES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of the component and not listed itself.

    Alternating large-star and small-star steps, before which each task links the edges that it reads. Each step is a
    partial minimum and a join with it, so that a node with very many neighbours is split by adaptive execution rather
    than gathered. It ends when all edges are stars. Nodes without edges are not listed.
    """

    def spanned(e):
        return e.mapInArrow(span, "a long, b long")

    def large(e):
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))

    def small(e):  # a > b throughout
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()

    def settled(e):
        """Whether each node has one edge up, or only edges down."""
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("x")).select("x.*")
        return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least")).filter("up > 1 or up = 1 and least = 0").limit(1).count()

    now = stash(spanned(edges.select("a", "b").filter("a <> b")), "edges")
    for _ in range(rounds):
        if settled(now):
            break
        now = stash(spanned(small(large(now))), "stars")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.toDF("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) of all their nodes, root the smallest node of the component."""
    out = stars(edges)
    return out.unionByName(out.select("root", "root").toDF("node", "root").distinct())
