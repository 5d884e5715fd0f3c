"""Small generated fields to try measures on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.plans.frame import Field

#: Fixed values.
SIMPLE_FORECAST = [10.0, 10.0, 11.0, 13.0, 14.0, 17.0, 15.0, 14.0]
SIMPLE_OBSERVATIONS = [11.0, 11.0, 12.0, 14.0, 11.0, 14.0, 12.0, 11.0]


def _simple(spark: SparkSession, values: list[float], name: str) -> Field:
    return Field(spark.createDataFrame(list(enumerate(values)), f"i long, {name} double"), ("i",), name)


def simple_forecast(spark: SparkSession) -> Field:
    return _simple(spark, SIMPLE_FORECAST, "fcst")


def simple_observations(spark: SparkSession) -> Field:
    return _simple(spark, SIMPLE_OBSERVATIONS, "obs")


def simple_forecast_pandas() -> pd.Series:
    return pd.Series(SIMPLE_FORECAST)


def simple_observations_pandas() -> pd.Series:
    return pd.Series(SIMPLE_OBSERVATIONS)


def _grid(spark: SparkSession, large: bool) -> DataFrame:
    n_lat, n_lon, n_time = (364, 720, 240) if large else (10, 20, 10)
    cell = spark.range(n_lat * n_lon * n_time)
    lat = F.floor(F.col("id") / (n_lon * n_time))
    lon = F.pmod(F.floor(F.col("id") / n_time), F.lit(n_lon))
    hour = F.timestamp_add("HOUR", F.pmod("id", F.lit(n_time)), F.lit("2022-11-20T01:00:00").cast("timestamp_ntz"))
    return cell.select("id", (-90 + lat * 180.0 / (n_lat - 1)).alias("lat"), (lon * 360.0 / n_lon).alias("lon"), hour.alias("time"))


def continuous_observations(spark: SparkSession, *, large_size: bool = False, seed: int = 42) -> Field:
    df = _grid(spark, large_size).withColumn("obs", F.rand(seed) * 10)
    return Field(df.drop("id"), ("lat", "lon", "time"), "obs")


def continuous_forecast(spark: SparkSession, *, large_size: bool = False, lead_days: bool = False, seed: int = 42) -> Field:
    df = _grid(spark, large_size).withColumn("obs", F.rand(seed) * 10)
    if not lead_days:
        return Field(df.withColumn("fcst", F.col("obs") + 2 * F.randn(seed + 1)).drop("id", "obs"), ("lat", "lon", "time"), "fcst")
    both = df.withColumns({"__1": F.col("obs") + 2 * F.randn(seed + 1), "__2": F.col("obs") + 3 * F.randn(seed + 2)})
    lead = F.explode(F.array(*(F.struct(F.lit(i).alias("lead_time"), F.col(f"__{i}").alias("fcst")) for i in (1, 2))))
    return Field(both.select("lat", "lon", "time", lead.alias("x")).select("lat", "lon", "time", "x.*"), ("lat", "lon", "time", "lead_time"), "fcst")


def _cases(spark: SparkSession) -> DataFrame:
    return spark.range(8).select(F.pmod("id", F.lit(2)).alias("x"), F.pmod(F.floor(F.col("id") / 2), F.lit(2)).alias("y"), F.floor(F.col("id") / 4).alias("time"))


def cdf_forecast(spark: SparkSession, *, lead_days: bool = False, seed: int = 42) -> Field:
    """Logistic distributions with random centres at the thresholds 0, 0.1 to 9.9."""
    df = _cases(spark).withColumn("centre", 2 + 5 * F.rand(seed))
    if lead_days:
        df = df.withColumn("lead_day", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("centre", F.col("centre") + F.col("lead_day") * 0.1)
    df = df.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: i / 10.0)))
    dims = ("x", "y", "time", *(("lead_day",) if lead_days else ()), "threshold")
    return Field(df.withColumn("cdf", 1 / (1 + F.exp(-(F.col("threshold") - F.col("centre")) * 2))).select(*dims, "cdf"), dims, "cdf")


def cdf_observations(spark: SparkSession, seed: int = 43) -> Field:
    return Field(_cases(spark).withColumn("obs", F.rand(seed) * 10), ("x", "y", "time"), "obs")
