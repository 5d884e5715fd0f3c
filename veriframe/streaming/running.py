"""Measures as running aggregates over a stream of matched forecasts and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions.exprs import nn


def running_measures(pairs: DataFrame, time: str, *, fcst: str = "fcst", obs: str = "obs", keep: list[str] | None = None, window: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """mse, mae, additive_bias and count by time window; sums only, so state is one row for each window and key.

    Works on streaming and static frames alike. Rows later than delay are dropped by the watermark on a stream.
    """
    e = nn(F.col(fcst)) - nn(F.col(obs))
    rows = pairs.withWatermark(time, delay) if pairs.isStreaming else pairs
    at = F.window(time, window, slide) if slide else F.window(time, window)
    out = rows.groupBy(at.alias("window"), *(keep or [])).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("additive_bias"), F.count(e).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(keep or []), "mse", "mae", "additive_bias", "n")


def running_contingency(pairs: DataFrame, time: str, threshold: float, *, fcst: str = "fcst", obs: str = "obs", keep: list[str] | None = None, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of the contingency table by time window."""
    f, o = nn(F.col(fcst)) >= threshold, nn(F.col(obs)) >= threshold
    rows = pairs.withWatermark(time, delay) if pairs.isStreaming else pairs
    cells = {"tp": f & o, "tn": ~f & ~o, "fp": f & ~o, "fn": ~f & o}
    out = rows.groupBy(F.window(time, window).alias("window"), *(keep or [])).agg(*(F.count_if(c).alias(k) for k, c in cells.items()))
    return out.select(F.col("window.start").alias("window_start"), *(keep or []), *cells)
