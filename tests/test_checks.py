"""Argument checks that run with the query; window sums against brute force; filling by thresholds."""

import random

import numpy as np
import pandas as pd
import pytest

from veriframe.operators import categorical, cdf, continuous, plotdata, probability, spatial
from veriframe.plans.checks import watched
from veriframe.plans.frame import Field, aggregate, check_weights, dims_complement, watch_weights
from veriframe.sources import samples, series

RNG = random.Random(3)


def fields(spark, rows, columns="fow"):
    df = spark.createDataFrame([(i, *(None if v is None else float(v) for v in r)) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{c} double" for c in columns))
    return [Field(df, ("i",), c) for c in columns]


def fails(run, message):
    with pytest.raises(Exception, match=message):
        run().collect()


def test_rules_fail_with_the_query(spark):
    f, o, w = fields(spark, [(0.5, 1, 1), (1.5, 0, 1), (None, None, 1)])
    fails(lambda: probability.brier_score(f, o), "probabilities must lie")
    fails(lambda: plotdata.roc(f, o), "probabilities must lie")
    fails(lambda: categorical.probability_of_detection(o, f), "events must be 0 or 1")
    assert probability.brier_score(f, o, check_args=False).first().brier_score == 1.25
    fails(lambda: continuous.quantile_interval_score(f, o, o, 0.1, 0.9), "above the upper")
    assert continuous.quantile_interval_score(f, o, o, 0.1, 0.9, check_args=False).count() == 1
    for bad, message in (((-1.0,), "negative"), ((None,), "known")):
        x, y, w = fields(spark, [(1, 2, *bad), (2, 3, 1)])
        for run in (lambda: continuous.mse(x, y, weights=w), lambda: continuous.pbias(x, y, weights=w), lambda: aggregate(x, reduce_dims="i", weights=w)):
            fails(run, message)


def test_rules_warn_after_the_query(spark):
    x, _, w = fields(spark, [(1, 2, -1), (2, 3, None), (3, 4, -2)])
    seen, watch = watch_weights(w)
    seen.df.count()
    assert watch.failures() == {"weights must be known": 1, "weights must not be negative": 2}
    with pytest.warns(UserWarning, match="negative"):
        watch.warn()
    df, watch = watched(x.df, {"positive": x.column() > 0})
    df.collect()
    assert watch.failures() == {}
    with pytest.warns(UserWarning):
        check_weights(w, raise_error=False)
    good = fields(spark, [(1, 2, 1), (2, 3, 1)])
    with pytest.warns(UserWarning, match="ignored"):
        assert aggregate(good[0], preserve_dims="all", weights=good[2]).count() == 2
    assert dims_complement("abc", ["b"]) == ["a", "c"] and dims_complement("ab", None) == ["a", "b"]


def test_series(spark):
    f, o = samples.simple_forecast_pandas(), samples.simple_observations_pandas()
    assert series.mae(f, o) == 2.0 and series.mse(f, o) == pytest.approx(((f - o) ** 2).mean()) and series.rmse(f, o) == pytest.approx(((f - o) ** 2).mean() ** 0.5)
    turned = pd.Series([350.0, 10.0, None], index=["a", "b", "c"]), pd.Series([10.0, 350.0, 5.0, 7.0], index=["b", "a", "c", "z"])
    assert series.mae(*turned) == 0 and series.mae(turned[0], turned[1].shift(1), is_angular=True) == 20
    assert series.mse(pd.Series([None], dtype=float), pd.Series([1.0])) is None
    df = spark.createDataFrame([(i, j, float(i * j), float(i + j)) for i in range(4) for j in range(3)], "x long, y long, f double, o double")
    a, b = (series.series_of(Field(df, ("x", "y"), c)) for c in "fo")
    assert series.mse(a, b) == pytest.approx(np.mean([(i * j - i - j) ** 2 for i in range(4) for j in range(3)]))
    with pytest.raises(ValueError):
        series.mse(a, f)


def test_distribution_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 0.2), ("a", 2.0, None), ("b", 1.0, 0.5), ("b", 2.0, 0.4), ("c", 1.0, None), ("c", 2.0, None)], "k string, t double, p double")
    f = Field(df, ("k", "t"), "p")
    fails(lambda: cdf.decreasing_cdfs(f, "t", 0.05), "all known or all missing")
    whole = Field(df.filter("k <> 'a'"), ("k", "t"), "p")
    assert {r.k: r.decreasing for r in cdf.decreasing_cdfs(whole, "t", 0.05).collect()} == {"b": True, "c": False}
    twice = Field(df.unionByName(df.filter("k = 'b'")), ("k", "t"), "p")
    fails(lambda: cdf.fill_cdf(twice, "t", "linear"), "thresholds must be increasing")
    assert {r.k: r.increasing for r in cdf.coords_increasing(twice, "t").collect()} == {"a": True, "b": False, "c": True}
    for bad in (lambda: cdf.decreasing_cdfs(f, "t", -1), lambda: cdf.fill_cdf(f, "x", "linear")):
        with pytest.raises(ValueError):
            bad()
    assert cdf.within_bounds(f) and not cdf.within_bounds(Field(df.selectExpr("k", "t", "p * 3 as p"), ("k", "t"), "p"))


def test_adjusting(spark):
    """Missing values spread over their distribution; further thresholds change the trapezoidal measure."""
    points = {"a": [0.0, 0.6, 0.3, 1.0], "b": [0.0, None, 0.9, 1.0], "c": [0.1, 0.2, 0.3, 1.0]}
    df = spark.createDataFrame([(k, float(t), v) for k, vs in points.items() for t, v in enumerate(vs)], "k string, t double, p double")
    obs = Field(spark.createDataFrame([(k, 1.5) for k in points], "k string, o double"), ("k",), "o")
    f = Field(df, ("k", "t"), "p")

    def score(v, extra):
        ts = sorted({0.0, 1.0, 2.0, 3.0, 1.5, *extra})
        h = [(np.interp(t, range(4), v) - (t >= 1.5)) ** 2 for t in ts]
        return sum((a + b) / 2 * (t - s) for a, b, s, t in zip(h, h[1:], ts, ts[1:], strict=False))

    for extra in ((), (0.25, 1.2, 1.4, 2.9)):
        kinds = [points["a"], np.maximum.accumulate(points["a"]).tolist(), np.minimum.accumulate(points["a"][::-1])[::-1].tolist()]
        want = max(kinds, key=lambda v: score(v, extra))
        rows = cdf.adjust_fcst_for_crps(f, "t", obs, additional_thresholds=list(extra), integration_method="trapz").collect()
        got = {k: [r.p for r in sorted(rows, key=lambda r: r.t) if r.k == k] for k in points}
        assert got == {"a": want, "b": [None] * 4, "c": points["c"]}


@pytest.mark.parametrize("zero_padding", [False, True])
def test_window_sums(spark, zero_padding):
    h, w, size = 9, 7, (4, 3)
    cells = {(k, i, j): (RNG.random(), RNG.random()) for k in range(3) for i in range(h) for j in range(w)}
    gone = {(1, 0, 0), (1, 4, 4), (2, 3, 3)}  # cells without a row, or with a missing value
    df = spark.createDataFrame([(k, i + 5, j - 2, None if (k, i, j) == (2, 3, 3) else f, o) for (k, i, j), (f, o) in cells.items() if (k, i, j) not in {(1, 4, 4)}], "k long, y long, x long, f double, o double")
    f, o = (Field(df, ("k", "y", "x"), c) for c in "fo")
    sums = []
    for k in range(3):
        grid = np.zeros((2, h, w))
        for i in range(h):
            for j in range(w):
                here = cells[k, i, j]
                grid[:, i, j] = [here[0] > 0.6 and (k, i, j) not in gone - {(1, 0, 0)}, here[1] > 0.6 and (k, i, j) != (1, 4, 4)]
        if zero_padding:
            a, b = size[0] // 2, size[1] // 2
            grid = np.pad(grid, ((0, 0), (a, size[0] - a), (b, size[1] - b)))
        n = np.array([[grid[:, i : i + size[0], j : j + size[1]].sum((1, 2)) for j in range(grid.shape[2] - size[1] + 1)] for i in range(grid.shape[1] - size[0] + 1)])
        sums.append([(n[..., 0] ** 2).mean(), (n[..., 1] ** 2).mean(), ((n[..., 0] - n[..., 1]) ** 2).mean()])
    options = {"event_threshold": 0.6, "window_size": size, "spatial_dims": ("y", "x"), "zero_padding": zero_padding}
    by = {r.k: r.fss for r in spatial.fss_2d(f, o, preserve_dims="k", **options).collect()}
    assert by == pytest.approx({k: max(0, 1 - d / (a + b)) for k, (a, b, d) in enumerate(sums)})
    a, b, d = np.mean(sums, 0)
    assert spatial.fss_2d(f, o, **options).first().fss == pytest.approx(max(0, 1 - d / (a + b)))
    one = [Field(x.df.filter("k = 0").drop("k"), ("y", "x"), x.value) for x in (f, o)]
    assert spatial.fss_2d_single_field(*one, **options).first().fss == pytest.approx(by[0])
    with pytest.raises(ValueError):
        spatial.fss_2d_single_field(f, o, **options)
    wide = {**options, "window_size": (20, 20), "zero_padding": False}
    assert spatial.fss_2d(f, o, **wide).first().fss is None


@pytest.mark.parametrize("few", [None, 0])
def test_trapezoids_over_all_thresholds(spark, few):
    """Each case on the grid of all thresholds and observations: lines between own points, cut off at 0 and 1 beyond them."""
    cases = {}
    for k in range(12):
        ts = sorted(RNG.sample(range(1000), RNG.randint(2, 5)))
        cases[k] = [(t / 100, v) for t, v in zip(ts, sorted(round(RNG.uniform(0.1, 0.9), 3) for _ in ts), strict=True)]
    cases[3] = [(4.0, 0.5), (5.0, 0.5)]
    obs = {k: round(RNG.uniform(-2, 12), 2) for k in cases} | {4: cases[4][0][0], 5: 30.0, 6: -5.0}
    extra = [-7.0, 5.55, 40.0]
    grid = np.array(sorted({t for c in cases.values() for t, _ in c} | set(obs.values()) | {*extra, 1.0, 2.0}))  # the last two are of a case without values
    want = {}
    for k, points in cases.items():
        t, v = map(np.array, zip(*points, strict=True))
        i = np.clip(np.searchsorted(t, grid, "right") - 1, 0, len(t) - 2)
        f = np.clip(v[i] + (v[i + 1] - v[i]) * (grid - t[i]) / (t[i + 1] - t[i]), 0, 1)
        step = grid >= obs[k]
        under, over = np.where(step, 0, f**2), np.where(step, (f - 1) ** 2, 0)
        want[k] = [float(((x[1:] + x[:-1]) / 2 * np.diff(grid)).sum()) for x in (under, over)]
    df = spark.createDataFrame([(k, t, v) for k, c in cases.items() for t, v in c] + [(99, 1.0, None), (99, 2.0, 0.4)], "k long, t double, p double")
    o = spark.createDataFrame([*obs.items(), (99, 1.0)], "k long, o double")
    options = {"threshold_dim": "t", "additional_thresholds": extra, "integration_method": "trapz", "threshold_union": "all", "include_components": True, "few": few}
    got = {r.k: r for r in cdf.crps_cdf(Field(df, ("k", "t"), "p"), Field(o, ("k",), "o"), preserve_dims="k", **options).collect()}
    assert got.pop(99).crps is None
    assert {k: [r.underforecast_penalty, r.overforecast_penalty] for k, r in got.items()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    with pytest.raises(ValueError):
        cdf.crps_cdf(Field(df, ("k", "t"), "p"), Field(o, ("k",), "o"), threshold_dim="t", threshold_union="some")
