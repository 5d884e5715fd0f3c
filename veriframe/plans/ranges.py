"""Running sums and neighbours along an order, by ranges of it, so that no task works on all rows and no group becomes an array.

Rows are written once. If they are few, a window over each group does. Else they are dealt by ranges of (group, order), so a
group, however large, lies in as many neighbouring ranges as it fills, and a range hands on one row for each group in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.plans.frame import attach
from veriframe.plans.staging import staged

FEW = 200_000  # rows that one task may sort
RANGE = "__range"


def dealt(df: DataFrame, keep: list[str], by: str, descending: bool = False, few: int | None = None) -> DataFrame:
    """df with the number of the range that its row lies in, rising along the order within a group."""
    rows = staged(df, "rows")
    if rows.count() <= (FEW if few is None else few):
        return rows.withColumn(RANGE, F.lit(0))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc(by) if descending else F.asc(by)
    return staged(rows.repartitionByRange(n, *(F.asc(k) for k in keep), order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, keep: list[str], by: str, sums: dict[str, Column], descending: bool = False, few: int | None = None) -> DataFrame:
    """df with columns of the sums over its rows up to and with each one, within the groups of keep; by has no ties there."""
    df = dealt(df.withColumns({f"__v_{k}": c for k, c in sums.items()}), keep, by, descending, few)
    order = F.desc(by) if descending else F.asc(by)
    here = Window.partitionBy(*keep, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keep).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = df.groupBy(*keep, RANGE).agg(*(F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums))
    parts = parts.select(*keep, RANGE, *(F.sum(f"__s_{k}").over(before).alias(f"__b_{k}") for k in sums))
    out = attach(df.withColumns({k: F.sum(f"__v_{k}").over(here) for k in sums}), parts, [*keep, RANGE])
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"__b_{k}"), F.lit(0)) for k in sums}).drop(RANGE, *(f"__{x}_{k}" for k in sums for x in "vb"))


def previous(df: DataFrame, keep: list[str], by: str, value: str, name: str, few: int | None = None) -> DataFrame:
    """df with the value of the row before, within the groups of keep, as name; NULL in a group's first row. by has no ties."""
    df = dealt(df, keep, by, few=few)
    here = Window.partitionBy(*keep, RANGE).orderBy(by)
    before = Window.partitionBy(*keep).orderBy(RANGE)  # a row for each range
    parts = df.groupBy(*keep, RANGE).agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(by)).alias("__last"))
    parts = parts.select(*keep, RANGE, F.lag("__last").over(before).alias("__last"))
    out = attach(df.withColumn("__lag", F.lag(F.struct(F.col(value).alias("v"))).over(here)), parts, [*keep, RANGE])
    return out.withColumn(name, F.coalesce("__lag", "__last")["v"]).drop(RANGE, "__lag", "__last")


def numbered(df: DataFrame, keep: list[str], by: str, name: str, few: int | None = None) -> DataFrame:
    """df with each row's place, from 0, in its group; by has no ties there."""
    return running_sums(df, keep, by, {name: F.lit(1).cast("long")}, few=few).withColumn(name, F.col(name) - 1)
