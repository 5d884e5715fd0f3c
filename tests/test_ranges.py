"""What works by ranges, with no rows too few for them, against plain Python."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import bootstrap, continuous, plotdata, stats
from veriframe.plans.frame import Field
from veriframe.plans.ranges import numbered, previous, running_sums

RNG = random.Random(8)


def test_sums_neighbours_and_places(spark):
    rows = [(k, i, RNG.choice([None, i * 2])) for k in ("a", "b", None) for i in RNG.sample(range(1000), 120 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    by = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append((i, v))
    for few in (0, None):
        got = {(r.k, r.i): r.p for r in previous(df, ["k"], "i", "v", "p", few).collect()}
        assert got == {(k, i): (s[j - 1][1] if j else None) for k, s in by.items() for j, (i, _) in enumerate(s)}
        got = {(r.k, r.i): r.n for r in numbered(df, ["k"], "i", "n", few).collect()}
        assert got == {(k, i): j for k, s in by.items() for j, (i, _) in enumerate(s)}
        for descending in (False, True):
            got = {(r.k, r.i): r.s for r in running_sums(df, ["k"], "i", {"s": F.col("v")}, descending, few).collect()}
            assert got == {(k, i): sum(v or 0 for j, v in s if (j >= i if descending else j <= i)) for k, s in by.items() for i, _ in s}


@pytest.mark.parametrize("few", [0, None])
def test_quantiles_of_all_methods(spark, few):
    values = [(g, float(RNG.choice([1, 2, 2, 5, 7, 11, RNG.random()])), RNG.random()) for g in range(3) for _ in range(RNG.choice([1, 2, 25]))] + [(9, float("nan"), 1.0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i long, g long, f double, o double")
    f, o = (Field(df, ("g", "i"), c) for c in "fo")
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for method in plotdata.METHODS if few is None else ("linear", "midpoint", "averaged_inverted_cdf"):
        got = {(r.g, r.data_source, r["quantile"]): r.value for r in plotdata.qq(f, o, quantiles=qs, interpolation_method=method, preserve_dims="g", few=few).collect()}
        assert len(got) == 4 * 2 * len(qs) and got[9, "obs", 0.5] is None
        for g in range(3):
            for side, at in (("fcst", 1), ("obs", 2)):
                want = np.quantile([v[at] for v in values if v[0] == g], qs, method=method)
                assert [got[g, side, q] for q in qs] == pytest.approx(want.tolist()), method


def flip_flop(v, angular):
    if len(v) < 3 or any(x is None for x in v):
        return None
    turn = lambda a, b: min(abs(a - b) % 360, 360 - abs(a - b) % 360) if angular else abs(a - b)
    return (sum(turn(a, b) for a, b in zip(v, v[1:], strict=False)) - (min(sector(v), 180) if angular else max(v) - min(v))) / (len(v) - 2)


def sector(v):
    a = sorted(x % 360 for x in v)
    return 360 - max([y - x for x, y in zip(a, a[1:], strict=False)] + [a[0] + 360 - a[-1]])


@pytest.mark.parametrize("few", [0, None])
def test_flip_flops_and_sectors(spark, few):
    day = datetime.date(2020, 1, 1)
    series = {k: [float(RNG.choice([0, 10, 350, 90, 720, -20, RNG.randint(0, 359)])) for _ in range(n)] for k, n in (("long", 200), ("short", 3), ("two", 2), ("one", 1))}
    series["gap"] = [1.0, None, 3.0, 4.0]
    df = spark.createDataFrame([(k, day + datetime.timedelta(i), x) for k, v in series.items() for i, x in enumerate(v)], "k string, d date, v double").repartition(3)
    data = Field(df, ("k", "d"), "v")
    for angular in (False, True):
        got = {r.k: r.flip_flop_index for r in continuous.flip_flop_index(data, "d", is_angular=angular, few=few).collect()}
        assert got == pytest.approx({k: flip_flop(v, angular) for k, v in series.items()})
    picks = {"first": [day + datetime.timedelta(i) for i in (0, 2, 1)], "again": [day, day + datetime.timedelta(1), day, day + datetime.timedelta(2)]}
    got = {(r.k, r.selection): r.flip_flop_index for r in continuous.flip_flop_index(data, "d", selections=picks, few=few).filter("k in ('long', 'short')").collect()}
    want = {(k, s): flip_flop([series[k][(x - day).days] for x in days], False) for k in ("long", "short") for s, days in picks.items()}
    assert got == pytest.approx(want)
    with pytest.raises(KeyError):
        continuous.flip_flop_index(data, "d", selections={"x": [day, datetime.date(1999, 1, 1)]})
    for skipna in (False, True):
        got = {r.k: r.sector_size for r in continuous.encompassing_sector_size(data, "d", skipna=skipna, few=few).collect()}
        want = {k: sector([x for x in v if x is not None]) if skipna or None not in v else None for k, v in series.items()}
        assert got == pytest.approx(want)


def test_autocovariances():
    for n in (1, 2, 3, 17, 1000):
        x = np.array([RNG.gauss(5, 2) for _ in range(n)])
        d = x - x.mean()
        direct = [float(d[k:] @ d[: n - k]) / n for k in range(n)]
        assert stats.acovf(x) == pytest.approx(direct, abs=1e-9) and len(stats.acovf(x)) == n


def test_exponential_fit():
    """The spectral statistic of a series whose autocovariances are fitted here on a fine grid."""
    rng = np.random.default_rng(1)
    d = np.convolve(rng.normal(0.3, 1, 203), np.ones(4) / 4, "valid")
    n = len(d)
    acv, lags = stats.acovf(d)[: (n - 1) // 2], np.arange((n - 1) // 2)
    best = min(((float(((s * e - acv) ** 2).sum()), s, r) for r in np.linspace(0.5, 60, 6000) for e in [np.exp(-3 * lags / r)] for s in [float(e @ acv / (e @ e))]))
    density = best[1] + 2 * best[1] * np.exp(-3 * np.arange(1, n) / best[2]).sum()
    assert stats.hg_statistic(d, 2) == pytest.approx(d.mean() / math.sqrt(density / n), rel=1e-3)


@pytest.mark.parametrize("circular", [True, False])
def test_nested_blocks(spark, circular):
    """Values tell where they come from: outer blocks are contiguous, inner ones too and the same within an outer block."""
    days, kinds, block = 11, 5, {"day": 4, "kind": 2}
    df = spark.createDataFrame([(f"{d:02d}", k, float(100 * d + k)) for d in range(days) for k in range(kinds)], "day string, kind long, v double")
    only = spark.createDataFrame([(k, float(k)) for k in range(kinds)], "kind long, w double")
    fields = [Field(df, ("day", "kind"), "v"), Field(df, ("day", "kind"), "v"), Field(only, ("kind",), "w")]
    for few in (None, 0):
        full, no_kinds, inner = bootstrap.block_bootstrap(fields, block, 6, exclude_dims=[[], ["kind"], []], circular=circular, seed=3, few=few)
        at = {(r.iteration, int(r.day), r.kind): divmod(int(r.v), 100) for r in full.collect()}
        assert len(at) == 6 * days * kinds == full.count()
        for i in range(1, 7):
            for d in range(days):
                assert len({at[i, d, k][0] for k in range(kinds)}) == 1
                if d % 4 and d:
                    step = at[i, d, 0][0] - at[i, d - 1, 0][0]
                    assert step == 1 or circular and step == 1 - days
                for k in range(kinds):
                    assert at[i, d, k][1] == at[i, d - d % 4, k][1]
                    if k % 2:
                        step = at[i, d, k][1] - at[i, d, k - 1][1]
                        assert step == 1 or circular and step == 1 - kinds
        assert {(r.iteration, int(r.day), r.kind): divmod(int(r.v), 100) for r in no_kinds.collect()} == {(i, d, k): (at[i, d, 0][0], k) for i, d, k in at}
        assert {(r.iteration, r.kind): int(r.w) for r in inner.collect()} == {(i, k): at[i, 0, k][1] for i, _, k in at}
    assert len({tuple(at[i, d, 0][0] for d in range(days)) for i in range(1, 7)}) > 1


def test_bootstrap_arguments(spark):
    a = Field(spark.createDataFrame([(i, j, 1.0) for i in range(4) for j in range(3)], "x long, y long, v double"), ("x", "y"), "v")
    b = Field(spark.createDataFrame([(i, 1.0) for i in range(5)], "x long, v double"), ("x",), "v")
    for fields, blocks, options in (([a], {"x": 5}, {}), ([a], {}, {}), ([a], {"x": 0}, {}), ([a, b], {"x": 2}, {}), ([a], {"z": 1}, {}), ([a], {"x": 2}, {"exclude_dims": [["x"]]}), ([a], {"x": 2}, {"exclude_dims": []}), ([a], {"x": 2}, {"exclude_dims": ["x"]})):
        with pytest.raises(ValueError):
            bootstrap.block_bootstrap(fields, blocks, 2, **options)
    whole = bootstrap.block_bootstrap([a], {"x": 4, "y": 3}, 2)[0]
    assert sorted(map(tuple, whole.collect())) == sorted((i, *r) for i in (1, 2) for r in a.df.collect())
