"""Measures against hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import bootstrap, categorical, cdf, continuous, discretise, isotonic, plotdata, probability, spatial, stats
from veriframe.plans.frame import Field, aggregate, check_binary, check_dims, check_weights, resolve_dims
from veriframe.sources import samples
from veriframe.streaming import running

NAN = float("nan")


def make(spark, rows, columns, dims, *values):
    df = spark.createDataFrame(rows, columns)
    return [Field(df, tuple(dims), v) for v in values]


def one(df, column=None):
    row = df.first()
    return row[column] if column else row[-1]


def test_resolve_dims():
    assert resolve_dims("ab") == [] and resolve_dims("ab", reduce_dims="all") == [] and resolve_dims("ab", preserve_dims="all") == ["a", "b"]
    assert resolve_dims("abc", reduce_dims=["b"]) == ["a", "c"] and resolve_dims("abc", preserve_dims="b") == ["b"] and resolve_dims("ab", reduce_dims=[]) == ["a", "b"]
    for bad in ({"reduce_dims": "a", "preserve_dims": "b"}, {"reduce_dims": "x"}):
        with pytest.raises(ValueError):
            resolve_dims("ab", **bad)
    check_dims("ab", "abc", "subset")
    with pytest.raises(ValueError):
        check_dims("ab", "abc")


def test_simple_and_separate_frames(spark):
    f, o = samples.simple_forecast(spark), samples.simple_observations(spark)
    assert one(continuous.mae(f, o)) == 2.0
    short = Field(o.df.filter("i < 4"), ("i",), "obs")
    assert one(continuous.mae(f, short)) == pytest.approx(1.0)


def test_aggregate_and_weights(spark):
    rows = [(x, y, v) for x, r in enumerate([[0, 0.5, 1], [2, NAN, 1], [97, 1, 1]]) for y, v in enumerate(map(float, r))]
    (v,) = make(spark, rows, "x long, y long, v double", "xy", "v")
    got = {r.y: r.v for r in aggregate(v, reduce_dims="x").collect()}
    assert got == {0: 33, 1: 0.75, 2: 1}
    assert {r.y: r.v for r in aggregate(v, reduce_dims="x", method="sum").collect()} == {0: 99, 1: 1.5, 2: 3}
    (w,) = make(spark, [(0, 1.0), (1, 1.0), (3, 1.0)], "y long, w double", "y", "w")
    assert {r.x: r.v for r in aggregate(v, reduce_dims="y", weights=w).collect()} == {0: 0.25, 1: 2, 2: 49}
    check_weights(w)
    with pytest.raises(ValueError):
        check_weights(make(spark, [(0, -1.0)], "y long, w double", "y", "w")[0])


def test_correlations(spark):
    rows = [(s, i, float(a), float(b)) for s, (fs, os) in {"w": ([1, 2, 3], [2, 4, 6]), "x": ([2, 1, 2], [5, 5, 5]), "y": ([1, 2, 3], [6, 5, 4])}.items() for i, (a, b) in enumerate(zip(fs, os, strict=True))]
    f, o = make(spark, rows, "s string, i long, f double, o double", "si", "f", "o")
    got = {r.s: r.pearsonr for r in continuous.pearsonr(f, o, preserve_dims="s").collect()}
    assert got["w"] == pytest.approx(1) and got["x"] is None and got["y"] == pytest.approx(-1)
    f, o = make(spark, [(0, 1.0, 10.0), (1, 2.0, 10.0), (2, 3.0, 30.0), (3, NAN, 5.0)], "i long, f double, o double", "i", "f", "o")
    assert one(continuous.spearmanr(f, o)) == pytest.approx(np.corrcoef([1, 2, 3], [2.5, 2.5, 4])[0, 1])
    assert one(continuous.nse(f, o)) == pytest.approx(1 - (81 + 64 + 27**2) / (2 * (50 / 3 - 10) ** 2 + (50 / 3 - 30) ** 2))


def test_pinball(spark):
    f, o = make(spark, [(0, 0, 5.0, 2.0), (0, 1, 3.0, 3.0), (1, 0, 7.0, 8.0), (1, 1, 2.0, 4.0)], "i long, j long, f double, o double", "ij", "f", "o")
    got = {(r.i, r.j): r.quantile_score for r in continuous.quantile_score(f, o, 0.7, preserve_dims="all").collect()}
    assert got == pytest.approx({(0, 0): 0.9, (0, 1): 0, (1, 0): 0.7, (1, 1): 1.4})
    with pytest.raises(ValueError):
        continuous.quantile_score(f, o, 1.0)


@pytest.mark.parametrize("positive", [None, "trapezoid"])
def test_threshold_weights_add_up(spark, positive):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 5, (60, 2)))] + [(99, NAN, 1.0)]
    f, o = make(spark, rows, "i long, f double, o double", "i", "f", "o")
    inf = math.inf
    parts = [((-inf, 1), None), ((1, inf), None)] if positive is None else [((-inf, 0), (-inf, 2)), ((2, inf), (0, inf))]
    for tw, whole in (
        (lambda a, b: continuous.tw_squared_error(f, o, a, interval_where_positive=b), continuous.mse(f, o)),
        (lambda a, b: continuous.tw_absolute_error(f, o, a, interval_where_positive=b), continuous.mae(f, o)),
        (lambda a, b: continuous.tw_quantile_score(f, o, 0.3, a, interval_where_positive=b), continuous.quantile_score(f, o, 0.3)),
    ):
        assert sum(one(tw(a, b)) for a, b in parts) == pytest.approx(one(whole))


def test_flip_flop_shares(spark):
    """Indices 4.5 (steps 4, 5 and 6 less a spread of 6, by 2) and missing; tests of the index itself are in test_ranges."""
    rows = [(k, i, v) for k, vs in {0: [2.0, 6.0, 1.0, 7.0], 1: [1.0, NAN, 2.0, 3.0]}.items() for i, v in enumerate(vs)]
    (d,) = make(spark, rows, "n long, i long, v double", ["n", "i"], "v")
    assert {r.n: r.flip_flop_index for r in continuous.flip_flop_index(d, "i").collect()} == {0: 4.5, 1: None}
    shares = continuous.flip_flop_index_proportion_exceeding(d, "i", [4.5, 5]).collect()
    assert {r.threshold: r.proportion for r in shares} == {4.5: 1.0, 5.0: 0.0}


def test_finley(spark):
    counts = spark.createDataFrame([(28, 2680, 72, 23, 2803)], "tp long, tn long, fp long, fn long, total long")
    t = categorical.Contingency(counts, [])
    assert one(t.heidke_skill_score()) == pytest.approx(0.355325, abs=1e-6) and one(t.gilberts_skill_score()) == pytest.approx(0.216046, abs=1e-6)
    assert one(t.cohens_kappa()) == one(t.heidke_skill_score()) and t.format_table().loc["Total", "Total"] == 2803
    empty = categorical.Contingency(spark.createDataFrame([(0, 5, 0, 0, 5)], "tp long, tn long, fp long, fn long, total long"), [])
    assert one(empty.hit_rate()) is None and one(empty.accuracy()) == 1
    names = [n for group in categorical.MEASURES for n in group]
    assert len(names) == 34 and set(names) <= set(dir(t))


def test_events_exclude_missing(spark):
    f, o = make(spark, [(0, 1.0, 1.0), (1, NAN, 1.0), (2, 0.0, 1.0), (3, 2.0, 0.0), (4, 0.0, 0.0)], "i long, f double, o double", "i", "f", "o")
    c = categorical.ThresholdEvents(0.5).make_contingency(f, o).get_counts().first()
    assert (c.tp, c.tn, c.fp, c.fn, c.total) == (1, 1, 1, 1, 4)


def test_pod(spark):
    f, o = make(spark, [(0, 1, 1.0), (1, 0, 1.0), (2, 1, 1.0), (3, 1, 0.0), (4, 0, NAN)], "i long, f int, o double", "i", "f", "o")
    assert one(categorical.probability_of_detection(f, o)) == pytest.approx(2 / 3) and one(categorical.probability_of_false_detection(f, o)) == 1
    with pytest.raises(ValueError):
        check_binary(make(spark, [(0, 2)], "i long, f int", "i", "f")[0])


def test_seeps_and_firm(spark):
    pairs = [(a, b) for b in (0.0, 5.0, 50.0) for a in (0.0, 5.0, 50.0)]
    f, o = make(spark, [(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, f double, o double", "i", "f", "o")
    got = [r.seeps for r in categorical.seeps(f, o, 0.5, 10.0, preserve_dims="all").orderBy("i").collect()]
    assert got == pytest.approx([0, 1, 1.6, 1, 0, 0.6, 4, 3, 0])
    got = [r.firm for r in categorical.firm(f, o, 0.7, [5], [1], preserve_dims="all").orderBy("i").collect()]
    assert got == pytest.approx([0, 0, 0.3, 0, 0, 0.3, 0.7, 0.7, 0])


def test_risk_matrix(spark):
    scaling = np.array([[0, 2, 3, 3], [0, 1, 2, 3], [0, 1, 1, 2], [0, 0, 0, 0]])
    got = categorical.scaling_to_weights(scaling, [1, 2, 3])
    assert got.tolist() == [[2, 3, 0], [0, 2, 3], [1, 0, 2]]
    w = categorical.weights_from_warning_scaling(spark, scaling, [1, 2, 3], "sev", ["a", "b", "c"], "p", [0.1, 0.3, 0.5])
    assert w.df.filter("p = 0.5 and sev = 'b'").first().weight == 3


def test_ensembles(spark):
    rows = [(0, [0.0, 4.0, 3.0, 7.0], 2.0), (1, [1.0, -1.0, 2.0, 4.0], 3.0), (2, [0.0, 1.0, 4.0, NAN], 1.0), (3, [2.0, 3.0, 4.0, 1.0], NAN), (4, [2.0, NAN, NAN, NAN], 4.0)]
    f, o = make(spark, rows, "stn long, m array<double>, o double", ["stn"], "m", "o")
    got = [r.crps for r in probability.crps_for_ensemble(f, o, preserve_dims="all").orderBy("stn").collect()]
    assert got[:3] == pytest.approx([2.5 - 44 / 32, 2 - 1, 4 / 3 - 16 / 18]) and got[3] is None and got[4] == 2
    fair = [r.crps for r in probability.crps_for_ensemble(f, o, method="fair", preserve_dims="all").orderBy("stn").collect()]
    assert fair[:3] == pytest.approx([2.5 - 44 / 24, 2 - 32 / 24, 4 / 3 - 16 / 12]) and fair[4] is None
    long = Field(f.df.select("stn", F.posexplode("m").alias("k", "v")), ("stn", "k"), "v")
    again = [r.crps for r in probability.crps_for_ensemble(long, o, "k", preserve_dims="stn").orderBy("stn").collect()]
    assert again == got
    parts = probability.crps_for_ensemble(f, o, include_components=True).first()
    assert parts.crps == pytest.approx(parts.underforecast_penalty + parts.overforecast_penalty - parts.spread)
    brier = probability.brier_score_for_ensemble(f, o, None, [2.5], fair_correction=False, preserve_dims="all").orderBy("stn").collect()
    assert [r.brier_score for r in brier][:2] == pytest.approx([0.75**2, 0.75**2])


def test_cdf_tools(spark):
    rows = [(s, x, v) for s, vs in {0: [0, 1], 1: [1, 1], 2: [NAN, 1]}.items() for x, v in zip([0.0, 1.0], map(float, vs), strict=True)]
    (c,) = make(spark, rows, "s long, threshold double, v double", ["s", "threshold"], "v")
    got = {r.s: r.integral for r in cdf.integrate_square_piecewise_linear(c, "threshold").collect()}
    assert got[0] == pytest.approx(1 / 3) and got[1] == 1 and got[2] is None
    (c,) = make(spark, [(0, float(t), v) for t, v in enumerate([NAN, 0.2, NAN, 0.6, NAN])], "s long, threshold double, v double", ["s", "threshold"], "v")
    fill = lambda m: [r.v for r in cdf.fill_cdf(c, "threshold", m).orderBy("threshold").collect()]
    assert fill("linear") == pytest.approx([0, 0.2, 0.4, 0.6, 0.8]) and fill("step") == [0, 0.2, 0.2, 0.6, 0.6]
    assert fill("forward") == [0.2, 0.2, 0.2, 0.6, 0.6] and fill("backward") == [0.2, 0.2, 0.6, 0.6, 0.6]
    (b,) = make(spark, [(0, float(t), v) for t, v in enumerate([0.1, 0.5, 0.3, 1.0])], "s long, threshold double, v double", ["s", "threshold"], "v")
    env = {(r.cdf_type, r.threshold): r.v for r in cdf.cdf_envelope(b, "threshold").collect()}
    assert env["upper", 2.0] == 0.5 and env["lower", 1.0] == 0.3 and env["original", 2.0] == 0.3
    assert one(cdf.decreasing_cdfs(b, "threshold", 0.1)) and not one(cdf.decreasing_cdfs(b, "threshold", 0.25))


def test_crps_cdf(spark):
    (f,) = make(spark, [(0, 0.0, 0.0), (0, 1.0, 1.0)], "s long, threshold double, v double", ["s", "threshold"], "v")
    (o,) = make(spark, [(0, 0.5)], "s long, o double", "s", "o")
    r = cdf.crps_cdf(f, o, include_components=True).first()
    assert r.crps == pytest.approx(1 / 12) and r.underforecast_penalty == pytest.approx(1 / 24)
    (w,) = make(spark, [(0.0, 0.0), (0.5, 1.0)], "threshold double, w double", ["threshold"], "w")
    assert one(cdf.crps_cdf(f, o, threshold_weight=w)) == pytest.approx(1 / 24)
    assert one(cdf.crps_cdf(f, o, integration_method="trapz")) == pytest.approx(0.125)


def test_roc(spark):
    p, y = make(spark, [(i, a, float(b)) for i, (a, b) in enumerate([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (NAN, 1)])], "i long, p double, y double", "i", "p", "y")
    assert plotdata.roc(p, y).first().AUC == pytest.approx(0.75)
    got = {r.threshold: (r.POD, r.POFD) for r in plotdata.roc(p, y, [0.3]).collect()}
    assert got == {0.0: (1, 1), 0.3: (1, 0.5), math.inf: (0, 0)}


@pytest.mark.parametrize("method", plotdata.METHODS)
def test_qq_methods(spark, method):
    rng = np.random.default_rng(1)
    a = rng.normal(size=11)
    f, o = make(spark, [(i, float(v), float(-v)) for i, v in enumerate(a)], "i long, f double, o double", "i", "f", "o")
    qs = [0.0, 0.13, 0.25, 0.5, 0.77, 1.0]
    got = {r.quantile: r.value for r in plotdata.qq(f, o, quantiles=qs, interpolation_method=method).filter("data_source = 'fcst'").collect()}
    assert [got[q] for q in qs] == pytest.approx(np.quantile(a, qs, method=method).tolist())


@pytest.mark.parametrize("case", [((0, 1), (0, 1), 10, 0.5, 0.974733, 0.972075), ((0, 1), (0, 2), 5, 0.5, 0.88913, 0.886119), ((0, 1), (1, 1), 10, 0.25, 0.81069, 0.811639)])
def test_fss(spark, case):
    (om, os), (fm, fs), w, t, inside, padded = case
    rng = np.random.RandomState(21)
    obs, fcst = rng.normal(om, os, (40, 60)), rng.normal(fm, fs, (40, 60))
    f, o = make(spark, [(y, x, float(fcst[y, x]), float(obs[y, x])) for y in range(40) for x in range(60)], "y int, x int, f double, o double", "yx", "f", "o")
    for zero, want in ((False, inside), (True, padded)):
        assert one(spatial.fss_2d(f, o, event_threshold=t, window_size=(w, w), spatial_dims=("y", "x"), zero_padding=zero)) == pytest.approx(want, rel=1e-5)


def test_diebold_mariano(spark):
    """Against the formula of the small-sample statistic; the distributions against numerical integrals of their densities."""
    rng = np.random.default_rng(6)
    series = {1: (2, rng.normal(0.4, 1, 9).tolist()), 2: (3, rng.normal(-0.2, 2, 14).tolist()), 3: (1, [0.0, 0.0, 0.0])}
    series[1][1][4] = NAN
    rows = [(s, f"{t:02d}", h, d) for s, (h, ds) in series.items() for t, d in enumerate(ds)]
    (d,) = make(spark, rows, "lead long, t string, h int, d double", ["lead", "t"], "d")
    for kind in ("normal", "t"):
        got = {r.lead: r for r in stats.diebold_mariano(d, "lead", "t", "h", method="HLN", confidence_level=0.9, statistic_distribution=kind).collect()}
        for s, (h, ds) in list(series.items())[:2]:
            x = np.array([v for v in ds if v == v])
            n, e = len(x), x - x.mean()
            variance = sum((1 if k == 0 else 2) * (e[k:] * e[: n - k]).sum() / n for k in range(h)) / n
            stat = x.mean() / np.sqrt(variance) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
            z = np.linspace(-200, stat, 2_000_001)
            density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) if kind == "normal" else (1 + z * z / (n - 1)) ** (-n / 2) * np.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2)) / np.sqrt(np.pi * (n - 1))
            assert got[s].dm_test_stat == pytest.approx(stat) and got[s].timeseries_len == n and got[s]["mean"] == pytest.approx(x.mean())
            assert got[s].confidence_gt_0 == pytest.approx(float(((density[1:] + density[:-1]) / 2).sum() * (z[1] - z[0])), abs=1e-5)
        assert got[3].dm_test_stat is None and got[3].confidence_gt_0 is None


def test_discretise_modes(spark):
    (d,) = make(spark, [(0, 1.0), (1, 1.05), (2, 2.0), (3, NAN)], "i long, v double", "i", "v")
    for mode, want in {">=": [1, 1, 1], ">": [0, 0, 1], "<=": [1, 1, 0], "<": [0, 0, 0], "==": [1, 1, 0], "!=": [0, 0, 1]}.items():
        got = [r.discretised for r in discretise.binary_discretise(d, 1.0, mode, abs_tolerance=0.1).orderBy("i").collect()]
        assert got == [*want, None]
    with pytest.raises(ValueError):
        discretise.binary_discretise(d, [2.0, 1.0], ">=")


def test_murphy(spark):
    f, o = make(spark, [(0, 1.0, 3.0), (1, 4.0, 2.0), (2, NAN, 1.0)], "i long, f double, o double", "i", "f", "o")
    r = plotdata.murphy_score(f, o, [2.5], functional="expectile", alpha=0.1, decomposition=True).first()
    assert (r.overforecast, r.underforecast) == pytest.approx((0.9 * 0.5 / 2, 0.1 * 0.5 / 2))


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01T00:{m:02d}:00", float(m), 10.0) for m in range(60)], "t string, fcst double, obs double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running.running_measures(stream, "t", window="30 minutes").writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(spark.table("running").select("n", "mae").collect())
    want = sorted(running.running_measures(df, "t", window="30 minutes").select("n", "mae").collect())
    assert got == want and [r.n for r in got] == [30, 30]


def test_samples(spark):
    assert samples.continuous_forecast(spark, lead_days=True).df.count() == 4000 and samples.cdf_forecast(spark).df.count() == 800
    assert samples.continuous_observations(spark).df.count() == 2000 and samples.cdf_observations(spark).df.count() == 8
