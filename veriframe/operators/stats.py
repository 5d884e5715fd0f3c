"""Diebold-Mariano test for equal skill."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.plans.frame import Field


def acovf(x: np.ndarray) -> np.ndarray:
    """Autocovariances of all lags, divided by the length: the power spectrum's inverse transform, with as many zeros added as
    there are values, so that no lag wraps around."""
    d, n = x - x.mean(), len(x)
    spectrum = np.fft.rfft(d, 1 << max(2 * n - 1, 1).bit_length())
    return np.fft.irfft(spectrum * spectrum.conj())[:n] / n


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_cdf(t: float, dof: float) -> float:
    tail = _beta(dof / 2, 0.5, dof / (dof + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, dof: float) -> float:
    low, high = -1.0, 1.0
    while t_cdf(low, dof) > p:
        low *= 2
    while t_cdf(high, dof) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, dof) < p else (low, mid)
    return (low + high) / 2


def hln_statistic(d: np.ndarray, h: int) -> float:
    """With the small-sample correction; the variance of the mean takes the lags below h."""
    n, dev = len(d), d - d.mean()
    variance = (dev @ dev + 2 * sum(dev[k:] @ dev[:-k] for k in range(1, h))) / n**2
    if variance <= 0:
        return math.nan
    return d.mean() / math.sqrt(variance) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


def hg_statistic(d: np.ndarray, h: int) -> float:
    """From the spectral density at 0 of an exponential fit s exp(-3 lag / r) to the first autocovariances: for each r the
    best s is known, so r is found on a grid and then by golden sections."""
    n = len(d)
    lags = np.arange(max((n - 1) // 2, h), dtype=float)
    acv = acovf(d)[: len(lags)]
    lags = lags[: len(acv)]

    def fit(log_r):
        e = np.exp(-3 * lags / math.exp(log_r))
        s = max(float(e @ acv / (e @ e)), 0.0)
        return float(((s * e - acv) ** 2).sum()), s

    grid = np.linspace(math.log(1e-3), math.log(1e3 * len(lags) + 1e3), 600)
    best = int(np.argmin([fit(g)[0] for g in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    gold = (math.sqrt(5) - 1) / 2
    for _ in range(200):
        p, q = b - gold * (b - a), a + gold * (b - a)
        a, b = (a, q) if fit(p)[0] < fit(q)[0] else (p, b)
    log_r = (a + b) / 2
    s = fit(log_r)[1]
    all_lags = np.arange(1, n)
    density = s + 2 * float((s * np.exp(-3 * all_lags / math.exp(log_r))).sum())
    return d.mean() / math.sqrt(density / n) if density > 0 else math.nan


def diebold_mariano(diffs: Field, series_dim: str, time_dim: str, h: str, *, method: str = "HG", confidence_level: float = 0.95, statistic_distribution: str = "normal") -> DataFrame:
    """Of each series: mean, dm_test_stat, timeseries_len, confidence_gt_0, ci_upper and ci_lower.

    h names a column of diffs' frame with the horizon of each series. A series is one group: its length is that of a time
    series, not of the data.
    """
    if method not in ("HG", "HLN") or statistic_distribution not in ("normal", "t") or not 0 < confidence_level < 1:
        raise ValueError("method is HG or HLN, the distribution normal or t, the level between 0 and 1")
    rows = diffs.df.select(F.col(series_dim).alias("series"), F.col(time_dim).alias("__t"), diffs.column().alias("d"), F.col(h).cast("long").alias("h"))
    kind = dict(rows.dtypes)["series"]

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("__t")["d"].dropna().to_numpy(float)
        lag, n = int(pdf["h"].iloc[0]), len(d)
        if not 0 < lag:
            raise ValueError("h must be a positive integer")
        stat = math.nan
        if n and (d != 0).any() and lag < n:
            stat = (hg_statistic if method == "HG" else hln_statistic)(d, lag)
        mean = d.mean() if n else math.nan
        out = {"series": pdf["series"].iloc[0], "mean": mean, "dm_test_stat": stat, "timeseries_len": n, "confidence_gt_0": math.nan, "ci_upper": math.nan, "ci_lower": math.nan}
        if not math.isnan(stat):
            p = (1 + confidence_level) / 2
            normal = statistic_distribution == "normal"
            q = NormalDist().inv_cdf(p) if normal else t_quantile(p, n - 1)
            out["confidence_gt_0"] = NormalDist().cdf(stat) if normal else t_cdf(stat, n - 1)
            ends = (mean * (1 + q / stat), mean * (1 - q / stat)) if stat else (math.nan, math.nan)
            out["ci_upper"], out["ci_lower"] = ends
        return pd.DataFrame([out])

    got = rows.groupBy("series").applyInPandas(test, f"series {kind}, mean double, dm_test_stat double, timeseries_len long, confidence_gt_0 double, ci_upper double, ci_lower double")
    values = ["mean", "dm_test_stat", "confidence_gt_0", "ci_upper", "ci_lower"]
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in values}).withColumnRenamed("series", series_dim)
