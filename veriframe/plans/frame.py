"""Fields: DataFrames whose key columns are named dimensions, and how measures resolve, align and reduce them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.exprs import nn
from veriframe.plans.checks import Watch, checked_weight, watched, weight_rules

Dims = str | Iterable[str] | None


class DimensionError(ValueError):
    """Dimensions don't fit together."""


@dataclass(frozen=True)
class Field:
    """One value column of a DataFrame with a row for each combination of its dimensions."""

    df: DataFrame
    dims: tuple[str, ...]
    value: str

    def column(self) -> Column:
        return nn(F.col(f"`{self.value}`"))

    def map(self, f: Callable[[Column], Column]) -> Field:
        return Field(self.df.withColumn(self.value, f(self.column())), self.dims, self.value)


def field(df: DataFrame, dims: Iterable[str], value: str) -> Field:
    return Field(df, tuple(dims), value)


def resolve_dims(dims: Iterable[str], reduce_dims: Dims = None, preserve_dims: Dims = None) -> list[str]:
    """The dimensions to keep: at most one of the two is given; 'all' is a keyword; neither reduces everything."""
    dims = list(dict.fromkeys(dims))
    if reduce_dims is not None and preserve_dims is not None:
        raise ValueError("give reduce_dims or preserve_dims, not both")
    given = reduce_dims if reduce_dims is not None else preserve_dims
    if given is None:
        return []
    if isinstance(given, str):
        named = dims if given == "all" else [given]
    else:
        named = list(given)
    if unknown := [d for d in named if d not in dims]:
        raise ValueError(f"unknown dimensions: {unknown}")
    return [d for d in dims if (d in named) == (preserve_dims is not None)]


def dims_complement(dims: Iterable[str], named: Dims) -> list[str]:
    """The dims that aren't named, in order."""
    return resolve_dims(dims, reduce_dims=[] if named is None else named)


def check_dims(dims: Iterable[str], expected: Iterable[str], mode: str = "equal") -> None:
    a, b = set(dims), set(expected)
    fits = {"equal": a == b, "subset": a <= b, "superset": a >= b, "proper subset": a < b, "proper superset": a > b, "disjoint": not a & b}
    if mode not in fits:
        raise ValueError(f"mode is one of {sorted(fits)}")
    if not fits[mode]:
        raise DimensionError(f"dimensions {sorted(a)} are not {mode} to {sorted(b)}")


def align(**fields: Field) -> tuple[DataFrame, list[str]]:
    """Inner join on shared dimensions, broadcast over the others: a value column for each name, and all dimensions.

    Fields of one DataFrame are read from the same row, without a join. Small sides are broadcast by Spark's own check.
    """
    out, dims = None, []
    by_frame: dict[int, list[tuple[str, Field]]] = {}
    for name, f in fields.items():
        by_frame.setdefault(id(f.df), []).append((name, f))
    for group in by_frame.values():
        own = list(dict.fromkeys(d for _, f in group for d in f.dims))
        keys = [d for d in own if d in group[0][1].df.columns]
        side = group[0][1].df.select(*(F.col(f"`{d}`") for d in keys), *(f.column().alias(name) for name, f in group))
        if out is None:
            out = side
        else:
            shared = [d for d in keys if d in out.columns]
            out = out.join(side, shared, "inner") if shared else out.crossJoin(side)
        dims += [d for d in own if d not in dims]
    return out, dims


def match_missing(df: DataFrame, *values: str) -> DataFrame:
    """Values become NULL in rows where any of them is."""
    known = F.lit(True)
    for v in values:
        known = known & F.col(v).isNotNull()
    return df.withColumns({v: F.when(known, F.col(v)) for v in values})


def attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, a missing key with a missing key; table has one row for each combination of them."""
    if not keys:
        return df.crossJoin(table)
    named = {k: f"__key_{i}" for i, k in enumerate(keys)}
    table = table.select(*(F.col(k).alias(v) for k, v in named.items()), *(c for c in table.columns if c not in named))
    return df.join(table, [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()], "left").drop(*named.values())


def wmean(x: Column, w: Column | None = None) -> Column:
    """Mean of the known values; weighted, NULL where no weight is left."""
    if w is None:
        return F.avg(x)
    total = F.sum(F.when(x.isNotNull(), w))
    return F.when(total != 0, F.sum(x * w) / total)


def wsum(x: Column, w: Column | None = None) -> Column:
    """Sum of the known values, 0 if there are none; weighted, NULL where no weight is left."""
    if w is None:
        return F.coalesce(F.sum(x), F.lit(0.0))
    return F.when(F.sum(F.when(x.isNotNull(), w)) != 0, F.sum(x * w))


def reduce(df: DataFrame, dims: list[str], keep: list[str], **values: Column) -> DataFrame:
    """Aggregates to the kept dimensions; with all of them kept, keys are taken to be unique."""
    return df.groupBy(*keep).agg(*(v.alias(k) for k, v in values.items()))


def aggregate(values: Field, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, method: str = "mean") -> DataFrame:
    if method not in ("mean", "sum"):
        raise ValueError("method is mean or sum")
    given = {"__x": values} | ({"__w": weights} if weights is not None else {})
    df, dims = align(**given)
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    if weights is not None and keep == dims:
        warnings.warn("weights are ignored, as every dimension is kept", UserWarning, stacklevel=2)
        return reduce(df, dims, keep, **{values.value: (wmean if method == "mean" else wsum)(F.col("__x"))})
    f = wmean if method == "mean" else wsum
    return reduce(df, dims, keep, **{values.value: f(F.col("__x"), checked_weight(F.col("__w")) if weights is not None else None)})


def watch_weights(weights: Field) -> tuple[Field, Watch]:
    """The weights, and a watch that warns of missing and negative ones once a query has read them."""
    df, watch = watched(weights.df, weight_rules(weights.column()))
    return Field(df, weights.dims, weights.value), watch


def check_weights(weights: Field, *, raise_error: bool = True) -> None:
    """One action: no missing and no negative weight, and one above zero; else an error, or a warning."""
    w = weights.column()
    row = weights.df.agg(F.coalesce(F.bool_or(w.isNull()), F.lit(False)), F.coalesce(F.bool_or(w < 0), F.lit(False)), F.coalesce(F.bool_or(w > 0), F.lit(False))).first()
    if row[0] or row[1] or not row[2]:
        message = "weights must be known, not negative, and not all zero"
        if raise_error:
            raise ValueError(message)
        warnings.warn(message, UserWarning, stacklevel=2)


def check_binary(values: Field) -> None:
    if values.df.filter(~values.column().isin(0.0, 1.0)).limit(1).count():
        raise ValueError(f"{values.value} must hold 0 and 1 only")


def pointwise(expr, name: str, reduce_dims: Dims, preserve_dims: Dims, weights: Field | None, **fields: Field) -> DataFrame:
    """The shape most measures share: align, evaluate expr over the named columns, take the (weighted) mean."""
    df, dims = align(**fields, **({"weight": weights} if weights is not None else {}))
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    w = checked_weight(F.col("weight")) if weights is not None else None
    got = expr(*(F.col(n) for n in fields))
    got = got if isinstance(got, dict) else {name: got}
    return reduce(df, dims, keep, **{k: wmean(v, w) for k, v in got.items()})
