"""Comparison of data with thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.plans.frame import Dims, Field, align, resolve_dims


def compare(d: Column, c: Column, mode: str, tolerance: float = 0.0) -> Column:
    """1.0 or 0.0; NULL where either side is missing."""
    t = float(tolerance or 0.0)
    if t < 0:
        raise ValueError("the tolerance must not be negative")
    modes = {">=": d >= c - t, ">": d > c + t, "<=": d <= c + t, "<": d < c - t, "==": F.abs(d - c) <= t, "!=": F.abs(d - c) > t}
    if mode not in modes:
        raise ValueError(f"mode is one of {sorted(modes)}")
    return F.when(d.isNotNull() & c.isNotNull(), modes[mode].cast("double"))


def comparative_discretise(data: Field, comparison: Field | float, mode: str, *, abs_tolerance: float | None = None) -> DataFrame:
    if isinstance(comparison, Field):
        df, dims = align(data=data, comparison=comparison)
        return df.select(*(d for d in dims if d in df.columns), compare(F.col("data"), F.col("comparison"), mode, abs_tolerance).alias("discretised"))
    return data.df.select(*data.dims, compare(data.column(), F.lit(float(comparison)), mode, abs_tolerance).alias("discretised"))


def _thresholds(thresholds) -> list[float]:
    out = [float(t) for t in thresholds]
    if out != sorted(out):
        raise ValueError("thresholds must not decrease")
    return out


def binary_discretise(data: Field, thresholds, mode: str, *, abs_tolerance: float | None = None, autosqueeze: bool = False) -> DataFrame:
    """A row for each threshold; a single number, or one threshold with autosqueeze, gives no threshold column."""
    single = isinstance(thresholds, (int, float))
    ts = _thresholds([thresholds] if single else thresholds)
    rows = data.df.withColumn("threshold", F.explode(F.array(*map(F.lit, ts))))
    out = rows.select(*data.dims, "threshold", compare(data.column(), F.col("threshold"), mode, abs_tolerance).alias("discretised"))
    return out.drop("threshold") if single or (autosqueeze and len(ts) == 1) else out


def binary_discretise_proportion(data: Field, thresholds, mode: str, *, reduce_dims: Dims = None, preserve_dims: Dims = None, abs_tolerance: float | None = None, autosqueeze: bool = False) -> DataFrame:
    """All thresholds in one pass: an average for each, then one row for each."""
    single = isinstance(thresholds, (int, float))
    ts = _thresholds([thresholds] if single else thresholds)
    keep = resolve_dims(data.dims, reduce_dims, preserve_dims)
    means = data.df.groupBy(*keep).agg(*(F.avg(compare(data.column(), F.lit(t), mode, abs_tolerance)).alias(f"m{i}") for i, t in enumerate(ts)))
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"m{i}").alias("proportion")) for i, t in enumerate(ts))))
    out = means.select(*keep, pairs.alias("x")).select(*keep, "x.threshold", "x.proportion")
    return out.drop("threshold") if single or (autosqueeze and len(ts) == 1) else out


def proportion_exceeding(data: Field, thresholds, *, reduce_dims: Dims = None, preserve_dims: Dims = None) -> DataFrame:
    return binary_discretise_proportion(data, thresholds, ">=", reduce_dims=reduce_dims, preserve_dims=preserve_dims)
