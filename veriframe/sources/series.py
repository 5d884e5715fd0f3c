"""The plain measures for pandas-on-Spark series, and for pandas ones that are small enough to be at hand.

Series meet by their index, labels of only one of them are left out, and the measure is a Spark job that gives one number.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators import continuous
from veriframe.plans.frame import Field


def _frame(series, name: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Rows of (index columns, name)."""
    keys = tuple(f"__i{k}" for k in range(series.index.nlevels))
    named = series.rename(name).to_frame()
    if isinstance(series, pd.Series):
        named.index.names = keys
        return SparkSession.builder.getOrCreate().createDataFrame(named.reset_index()), keys
    return named.to_spark(index_col=list(keys)), keys


def _measure(score, fcst, obs, is_angular: bool) -> float | None:
    (f, keys), (o, others) = _frame(fcst, "fcst"), _frame(obs, "obs")
    if len(keys) != len(others):
        raise ValueError("the series have indexes of different depths")
    got = score(Field(f, keys, "fcst"), Field(o, others, "obs"), is_angular=is_angular).first()
    return None if got is None else got[0]


def mse(fcst, obs, *, is_angular: bool = False) -> float | None:
    """Mean squared error; None without a pair of known values."""
    return _measure(continuous.mse, fcst, obs, is_angular)


def rmse(fcst, obs, *, is_angular: bool = False) -> float | None:
    """Root of the mean squared error; None without a pair of known values."""
    return _measure(continuous.rmse, fcst, obs, is_angular)


def mae(fcst, obs, *, is_angular: bool = False) -> float | None:
    """Mean absolute error; None without a pair of known values."""
    return _measure(continuous.mae, fcst, obs, is_angular)


def series_of(field: Field):
    """A field as a pandas-on-Spark series with its dims as index."""
    table = field.df.select(*field.dims, F.col(f"`{field.value}`")).pandas_api(index_col=list(field.dims))
    return table[field.value]
