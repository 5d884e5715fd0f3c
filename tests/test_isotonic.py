"""Isotonic fits and bands against pooling in one list, with ranges so small that their lists have to be merged."""

import random

import numpy as np
import pytest

from veriframe.operators import isotonic
from veriframe.plans.frame import Field

RNG = random.Random(2)


def fields(spark, rows):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i long, f double, o double, w double").repartition(3)
    return [Field(df, ("i",), c) for c in "fow"]


def pooled(rows, functional):
    """Blocks of the sequence by forecast and falling observation: runs that don't rise pool, then neighbours that violate."""
    rows = sorted(((f, o, w) for f, o, w in rows), key=lambda r: (r[0], -r[1]))
    value = lambda part: part[0][1] if len(part) == 1 else functional([r[1] for r in part], [r[2] for r in part])
    blocks, i = [], 0
    while i < len(rows):
        part, last, i = [rows[i]], rows[i][1], i + 1
        now = None
        while True:
            while i < len(rows) and rows[i][1] <= last:
                last = rows[i][1]
                part.append(rows[i])
                i += 1
            now = value(part)
            if blocks and blocks[-1][0] >= now:
                part, last = blocks.pop()[1] + part, now
            elif i < len(rows) and rows[i][1] <= now:
                last = now
            else:
                break
        blocks.append((now, part))
    return {r[0]: b[0] for b in blocks for r in b[1]}


MEAN = lambda v, w: float(np.average(v, weights=w))
CASES = {
    "random": [(RNG.randint(0, 40), RNG.randint(0, 50), RNG.randint(1, 3)) for _ in range(300)],
    "rising": [(i, i + RNG.random() / 2, 1) for i in range(200)],
    "falling": [(i, -i, 1) for i in range(200)],
    "two halves": [(i, i % 100 - (150 if i >= 100 else 0), 1) for i in range(200)],
    "noisy": [(round(x := RNG.random(), 2), x + RNG.gauss(0, 0.3), RNG.random() + 0.1) for _ in range(400)],
    "one": [(1, 2, 3)],
    "equal": [(5, RNG.randint(0, 3), 1) for _ in range(30)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("size", [10_000, 45])
def test_mean(spark, case, size):
    f, o, w = fields(spark, CASES[case])
    for weight in (None, w) if case == "noisy" else (None,):
        want = pooled([(a, b, c if weight else 1) for a, b, c in CASES[case]], MEAN)
        got = {r.fcst: r for r in isotonic.isotonic_fit(f, o, weight=weight, range_rows=size).collect()}
        assert got.keys() == want.keys()
        for x, r in got.items():
            assert r.regression == pytest.approx(want[x], abs=1e-9) and r["count"] == sum(a == x for a, _, _ in CASES[case])


@pytest.mark.parametrize("case", ["random", "two halves", "equal"])
def test_quantile_and_solver(spark, case):
    f, o, w = fields(spark, CASES[case])
    want = pooled(CASES[case], lambda v, _: float(np.quantile(v, 0.3)))
    got = {r.fcst: r.regression for r in isotonic.isotonic_fit(f, o, functional="quantile", quantile_level=0.3).collect()}
    assert got == pytest.approx(want)
    # a quantile that isn't interpolated doesn't depend on the order of pooling, so small ranges give the same
    lower = lambda v, w: float(np.sort(v)[int(np.ceil(0.3 * len(v))) - 1])
    want = pooled(CASES[case], lower)
    for size in (10_000, 60):
        got = {r.fcst: r.regression for r in isotonic.isotonic_fit(f, o, functional=None, solver=lower, range_rows=size).collect()}
        assert got == pytest.approx(want)
    want = pooled(CASES[case], MEAN)
    got = {r.fcst: r.regression for r in isotonic.isotonic_fit(f, o, weight=w, functional=None, solver=MEAN, range_rows=60).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("size", [10_000, 60])
def test_counted_solver(spark, size):
    """It gets distinct values with their counts, whatever the number of pairs."""
    cases = [(a, round(b), 1) for a, b, _ in CASES["two halves"]] * 5
    f, o, _ = fields(spark, cases)
    distinct = len({b for _, b, _ in cases})

    def lower(v, w, c):
        assert len(v) <= distinct and (np.diff(v) > 0).all() and (w == 1).all()
        return float(v[np.searchsorted(np.cumsum(c), np.ceil(0.3 * c.sum()))])

    want = pooled(cases, lambda v, w: float(np.sort(v)[int(np.ceil(0.3 * len(v))) - 1]))
    got = {r.fcst: r.regression for r in isotonic.isotonic_fit(f, o, functional=None, solver=lower, counted=True, range_rows=size).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("functional", ["mean", "quantile"])
def test_band(spark, functional):
    """The draws are those of the operator; fits, interpolation and quantiles are made here anew."""
    rows = [(a, b, 1) for a, b, _ in CASES["random"][:120]]
    f, o, _ = fields(spark, rows)
    level = {"quantile_level": 0.5} if functional == "quantile" else {}
    options = {"functional": functional, **level, "bootstraps": 12, "confidence_level": 0.8, "min_non_nan": 9, "seed": 4, "report_bootstrap_results": True}
    keys = f.df.selectExpr("f", "o", "xxhash64(f, o, 1.0d, 4) as k").distinct().collect()
    pairs = {(r.f, r.o): r.k for r in keys}
    count = {p: sum((float(a), float(b)) == p for a, b, _ in rows) for p in pairs}
    drawn = isotonic.draws(np.array(list(pairs.values()), np.int64), np.array(list(count.values())), 12)
    points = np.array(sorted({float(a) for a, _, _ in rows}))
    fits = np.full((12, len(points)), np.nan)
    for b in range(12):
        sample = [(*p, 1) for p, n in zip(pairs, drawn[:, b], strict=True) for _ in range(n)]
        fit = pooled(sample, MEAN if functional == "mean" else lambda v, _: float(np.quantile(v, 0.5)))
        x = sorted(fit)
        fits[b] = np.interp(points, x, [fit[z] for z in x], left=np.nan, right=np.nan)
    enough = (~np.isnan(fits)).sum(0) >= 9
    lower, upper = (np.where(enough, np.nanquantile(fits, q, axis=0), np.nan) for q in (0.1, 0.9))
    base = pooled(rows, MEAN if functional == "mean" else lambda v, _: float(np.quantile(v, 0.5)))
    for size in (100_000, 400) if functional == "mean" else (100_000,):
        got = {r.fcst: r for r in isotonic.isotonic_fit(f, o, range_rows=size, **options).collect()}
        for i, x in enumerate(points):
            r = got[x]
            assert r.regression == pytest.approx(base[x])
            assert [np.nan if v is None else v for v in r.bootstrap_results] == pytest.approx(fits[:, i].tolist(), nan_ok=True)
            assert [np.nan if v is None else v for v in (r.lower, r.upper)] == pytest.approx([lower[i], upper[i]], nan_ok=True)
    assert isotonic.isotonic_band(f, o, bootstraps=3).columns == ["fcst", "regression", "count", "lower", "upper"]


def test_nothing_pools(spark, monkeypatch):
    """Ranges in order are read once: no merge is asked for."""
    f, o, _ = fields(spark, CASES["rising"])
    monkeypatch.setattr(isotonic, "merged", None)
    assert isotonic.isotonic_fit(f, o, range_rows=15).count() == 200


def test_arguments_and_missing(spark):
    f, o, w = fields(spark, [(1, float("nan"), 1), (float("nan"), 1, 1), (2, 3, float("nan"))])
    assert isotonic.isotonic_fit(f, o, weight=w).count() == 0 and isotonic.isotonic_fit(f, o, bootstraps=2).count() == 1
    for bad in ({"functional": "median"}, {"functional": "quantile"}, {"functional": "quantile", "quantile_level": 1}, {"functional": "quantile", "quantile_level": 0.5, "weight": w}, {"functional": None}, {"bootstraps": 0}, {"bootstraps": 1.5}, {"bootstraps": 2, "confidence_level": 1}):
        with pytest.raises(ValueError):
            isotonic.isotonic_fit(f, o, **bad)


def test_draws_keep_the_mean():
    got = isotonic.draws(np.arange(500), np.full(500, 3), 40)
    assert abs(got.mean() - 3) < 0.1 and abs(got.var() - 3) < 0.2 and (got == isotonic.draws(np.arange(500), np.full(500, 3), 40)).all()
