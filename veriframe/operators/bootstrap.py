"""Nested block resampling with seeded, reproducible draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.plans.frame import Field
from veriframe.plans.ranges import numbered
from veriframe.plans.staging import staged


def _labels(field: Field, dim: str, few: int | None) -> DataFrame:
    """The dim's distinct labels and their places from 0, in order, numbered by ranges."""
    return staged(numbered(field.df.select(F.col(f"`{dim}`").alias("__label")).distinct(), [], "__label", "__place", few), "labels")


def block_bootstrap(fields: list[Field], blocks: dict[str, int], n_iteration: int, *, exclude_dims: list[list[str]] | None = None, circular: bool = True, seed: int = 0, few: int | None = None) -> list[DataFrame]:
    """Copies of each field with its dims in blocks resampled, a copy for each value of the column iteration.

    blocks gives the block size of dims, outer ones first. A dim's places in a copy are cut in blocks, and each block's start
    is drawn from a hash of the seed, the iteration, the dim, the block's number and those of the outer blocks that it lies
    in; all fields share the draws. A block as long as the dim leaves it as it is. exclude_dims names for each field the dims
    that stay as they are in it. A field without an outer dim takes the inner draws of the outer dim's first block. Places are
    of the dim's sorted labels over the first field that has it; every field must have as many. One field must have all dims.

    Draws are made a block at a time, and labels are only met when a copy's rows are; no dim passes through one task.
    """
    if n_iteration < 1 or not blocks or any(b < 1 for b in blocks.values()):
        raise ValueError("block sizes and the number of iterations must be positive")
    exclude = [[] for _ in fields] if exclude_dims is None else exclude_dims
    if not isinstance(exclude, list) or not all(isinstance(x, list) for x in exclude) or len(exclude) != len(fields):
        raise ValueError("exclude_dims is a list with a list of dims for each field")
    own = [[d for d in blocks if d in f.dims and d not in x] for f, x in zip(fields, exclude, strict=True)]
    if not any(len(dims) == len(blocks) for dims in own):
        raise ValueError("one field must have all dims of the blocks")
    labels, length = {}, {}
    for d in blocks:
        labels[d] = _labels(next(f for f, dims in zip(fields, own, strict=True) if d in dims), d, few)
        length[d] = labels[d].count()
        if blocks[d] > length[d]:
            raise ValueError(f"the block size of {d} is above its length")
    for f, dims in zip(fields, own, strict=True):
        if dims:
            sizes = f.df.agg(*(F.count_distinct(F.col(f"`{d}`")).alias(d) for d in dims)).first()
            if any(sizes[d] != length[d] for d in dims):
                raise ValueError("a dim must be of the same size in all fields")
    spark, out = fields[0].df.sparkSession, []
    for f, dims in zip(fields, own, strict=True):
        index = spark.range(1, n_iteration + 1).select(F.col("id").alias("iteration"))
        outer = []
        for d, b in blocks.items():
            n, number = length[d], f"__block_{d}"
            index = index.withColumn(number, F.explode(F.sequence(F.lit(0), F.lit((n - 1) // b))) if d in dims else F.lit(0))
            draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(d), "iteration", number, *outer), F.lit(n if circular else n - b + 1))
            index = index.withColumn(f"__start_{d}", F.lit(0).cast("long") if b == n else draw)
            outer.append(number)
        rows = f.df
        for d in dims:  # the rows of a block
            b, n = blocks[d], length[d]
            step = F.explode(F.sequence(F.lit(0), F.least(F.lit(b), n - F.col(f"__block_{d}") * b) - 1))
            index = index.withColumn("__step", step)
            index = index.withColumns({f"__to_{d}": (F.col(f"__block_{d}") * b + F.col("__step")).cast("long"), f"__from_{d}": F.pmod(F.col(f"__start_{d}") + F.col("__step"), F.lit(n))})
            rows = rows.join(labels[d].select(F.col("__label").alias(d), F.col("__place").alias(f"__from_{d}")), d)
        rows = rows.join(index, [f"__from_{d}" for d in dims]) if dims else rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_iteration))).cast("long").alias("iteration"))
        for d in dims:
            rows = rows.join(labels[d].select(F.col("__label").alias(f"__name_{d}"), F.col("__place").alias(f"__to_{d}")), f"__to_{d}")
        out.append(rows.select("iteration", *(F.col(f"__name_{d}" if d in dims else f"`{d}`").alias(d) for d in f.dims), F.col(f"`{f.value}`")))
    return out
