"""Cumulative distributions given at thresholds, and their continuous ranked probability score.

A case's distribution is one array of (t, v), ordered by t, in a row; filling, envelopes and integrals are array expressions,
so that a case never meets another and no window or shuffle is needed beyond gathering the case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.exprs import nn
from veriframe.plans.checks import asserted
from veriframe.plans.frame import Dims, Field, align, attach, resolve_dims, wmean
from veriframe.plans.ranges import previous, running_sums
from veriframe.plans.staging import staged

POINT = "array<struct<t:double,v:double>>"


def gather(cdf: Field, threshold_dim: str, name: str = "cdf") -> tuple[DataFrame, list[str]]:
    """A row for each case with the array name of (t, v). A case that repeats a threshold makes the query fail."""
    if threshold_dim not in cdf.dims:
        raise ValueError(f"{threshold_dim} is not a dimension of the distributions")
    keep = [d for d in cdf.dims if d != threshold_dim]
    t = F.col(threshold_dim).cast("double")
    points = F.array_sort(F.collect_list(F.struct(t.alias("t"), cdf.column().alias("v"))))
    df, a = cdf.df.groupBy(*keep).agg(points.alias(name)), F.col(name)
    return df.withColumn(name, asserted(a, F.size(F.array_distinct(F.transform(a, lambda p: p["t"]))) == F.size(a), "thresholds must be increasing")), keep


def coords_increasing(cdf: Field, dim: str) -> DataFrame:
    """Of each case, whether its labels along dim are all different, so that they increase in their order."""
    keep = [d for d in cdf.dims if d != dim]
    return cdf.df.groupBy(*keep).agg((F.count_distinct(F.col(dim)) == F.count("*")).alias("increasing"))


def spread(df: DataFrame, keep: list[str], name: str, threshold_dim: str = "threshold", value: str = "cdf") -> DataFrame:
    """Back to a row for each threshold."""
    return df.select(*keep, F.explode(name).alias("__p")).select(*keep, F.col("__p.t").alias(threshold_dim), F.col("__p.v").alias(value))


def once(a: Column) -> Column:
    """Makes an array a column of its own, so that lambdas over it don't compute it again for each element."""
    return F.explode(F.array(a))


def round_values(c: Column, precision: float, decimals: int = 7) -> Column:
    """To a multiple of precision (0: as it is), half to even, then to so many decimals."""
    if precision < 0:
        raise ValueError("the precision must not be negative")
    return F.bround(F.bround(c / precision) * precision, decimals) if precision else c


def propagate_nan(a: Column) -> Column:
    """All values missing if one is."""
    return F.when(F.exists(a, lambda p: p["v"].isNull()), F.transform(a, lambda p: F.struct(p["t"].alias("t"), F.lit(None).cast("double").alias("v")))).otherwise(a)


def step_cdf(obs: Column, thresholds: Column) -> Column:
    """The observation as a distribution: 0 below it, 1 from it on."""
    return F.transform(thresholds, lambda t: F.struct(t.alias("t"), F.when(obs.isNotNull(), (t >= obs).cast("double")).alias("v")))


def observed_cdf(obs: Field, threshold_values: list[float], *, include_obs_in_thresholds: bool = True, precision: float = 0, threshold_dim: str = "threshold") -> DataFrame:
    """Rows of a step distribution for each observation; all observations' values are thresholds too if asked for."""
    o = round_values(obs.column(), precision)
    ts = obs.df.sparkSession.createDataFrame([(float(t),) for t in threshold_values], "t double")
    if include_obs_in_thresholds:
        ts = ts.union(obs.df.select(o.alias("t")).filter("t is not null"))
    rows = obs.df.select(*obs.dims, o.alias("__o")).crossJoin(ts.distinct())
    return rows.select(*obs.dims, F.col("t").alias(threshold_dim), F.when(F.col("__o").isNotNull(), (F.col("t") >= F.col("__o")).cast("double")).alias("cdf"))


def fill(a: Column, method: str, min_nonnan: int = 2) -> Column:
    """Fills missing values: linear (extrapolated from the nearest two, clipped to [0, 1]), step (0 before, forward after),
    forward or backward (each then filled the other way at the end). Fewer than min_nonnan known values: all missing."""
    if method not in ("linear", "step", "forward", "backward"):
        raise ValueError("method is linear, step, forward or backward")
    if min_nonnan < (2 if method == "linear" else 1):
        raise ValueError("too few known values are asked for")
    known = F.filter(a, lambda p: p["v"].isNotNull())

    def before(p):
        return F.filter(known, lambda q: q["t"] <= p["t"])

    def after(p):
        return F.filter(known, lambda q: q["t"] >= p["t"])

    def last(x):
        return F.when(F.size(x) > 0, F.element_at(x, -1))

    def first(x):
        return F.when(F.size(x) > 0, F.element_at(x, 1))

    def value(p):
        lo, hi = last(before(p)), first(after(p))
        if method == "step":
            return F.coalesce(lo["v"], F.lit(0.0))
        if method == "forward":
            return F.coalesce(lo["v"], hi["v"])
        if method == "backward":
            return F.coalesce(hi["v"], lo["v"])
        two_lo = F.when(lo.isNull(), F.element_at(known, 1)).when(hi.isNull(), F.element_at(known, -2)).otherwise(lo)
        two_hi = F.when(lo.isNull(), F.element_at(known, 2)).when(hi.isNull(), F.element_at(known, -1)).otherwise(hi)
        run = two_hi["t"] - two_lo["t"]
        line = F.when(run != 0, two_lo["v"] + (two_hi["v"] - two_lo["v"]) * (p["t"] - two_lo["t"]) / run).otherwise(two_lo["v"])
        return F.greatest(F.least(line, F.lit(1.0)), F.lit(0.0))

    filled = F.transform(a, lambda p: F.struct(p["t"].alias("t"), F.when(p["v"].isNotNull(), p["v"]).otherwise(value(p)).alias("v")))
    none = F.transform(a, lambda p: F.struct(p["t"].alias("t"), F.lit(None).cast("double").alias("v")))
    return F.when(F.size(known) >= min_nonnan, filled).otherwise(none)


def with_thresholds(a: Column, extra: Column) -> Column:
    """The points of a and missing ones at the thresholds of extra that it lacks."""
    new = F.array_except(F.array_distinct(F.filter(extra, lambda t: t.isNotNull())), F.transform(a, lambda p: p["t"]))
    return F.array_sort(F.concat(a, F.transform(new, lambda t: F.struct(t.alias("t"), F.lit(None).cast("double").alias("v")))))


def add_thresholds(cdf: Field, threshold_dim: str, new_thresholds: list[float], fill_method: str | None, min_nonnan: int = 2) -> DataFrame:
    df, keep = gather(cdf, threshold_dim)
    out = with_thresholds(F.col("cdf"), F.array(*(F.lit(float(t)) for t in new_thresholds)))
    df = df.withColumn("cdf", once(out))
    return spread(df.withColumn("cdf", fill(F.col("cdf"), fill_method, min_nonnan)) if fill_method else df, keep, "cdf", threshold_dim, cdf.value)


def fill_cdf(cdf: Field, threshold_dim: str, method: str, min_nonnan: int = 2) -> DataFrame:
    df, keep = gather(cdf, threshold_dim)
    return spread(df.withColumn("cdf", fill(F.col("cdf"), method, min_nonnan)), keep, "cdf", threshold_dim, cdf.value)


def _segments(a: Column, f) -> Column:
    """f(point, next point) for each neighbouring pair."""
    nxt = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(a.alias("p"), nxt.alias("q")), lambda x: x["q"].isNotNull())
    return F.transform(pairs, lambda x: f(x["p"], x["q"]))


def _total(x: Column) -> Column:
    """Sum of the known values; NULL if there are none."""
    known = F.filter(x, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b))


def square_integral(p: Column, q: Column) -> Column:
    """Of the square of the line from p to q."""
    return (q["t"] - p["t"]) * (p["v"] * p["v"] + p["v"] * q["v"] + q["v"] * q["v"]) / 3


def integrate_square_piecewise_linear(values: Field, threshold_dim: str) -> DataFrame:
    df, keep = gather(values, threshold_dim)
    return df.select(*keep, _total(_segments(F.col("cdf"), square_integral)).alias("integral"))


def decrease(a: Column) -> Column:
    """The sum of all steps down, not positive."""
    return F.coalesce(_total(_segments(a, lambda p, q: F.when(q["v"] < p["v"], q["v"] - p["v"]))), F.lit(0.0))


def decreasing_cdfs(cdf: Field, threshold_dim: str, tolerance: float = 0.0) -> DataFrame:
    """Of each case, whether its steps down add up to more than the tolerance. The query fails for a case with some values
    missing and some known."""
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    df, keep = gather(cdf, threshold_dim)
    whole = F.forall("cdf", lambda p: p["v"].isNull()) | F.forall("cdf", lambda p: p["v"].isNotNull())
    return df.select(*keep, asserted(decrease(F.col("cdf")) < -float(tolerance), whole, "a distribution's values must be all known or all missing").alias("decreasing"))


def _running(a: Column, pick) -> Column:
    start = F.struct(F.lit(None).cast("double").alias("m"), F.array().cast(POINT).alias("out"))

    def step(acc, p):
        m = pick(acc["m"], p["v"])
        point = F.struct(p["t"].alias("t"), F.when(p["v"].isNotNull(), m).alias("v"))
        return F.struct(m.alias("m"), F.concat(acc["out"], F.array(point)).alias("out"))

    return F.aggregate(a, start, step, lambda acc: acc["out"])


def upper_envelope(a: Column) -> Column:
    return _running(a, F.greatest)


def lower_envelope(a: Column) -> Column:
    return F.reverse(_running(F.reverse(a), F.least))


def cdf_envelope(cdf: Field, threshold_dim: str) -> DataFrame:
    """The distribution with its upper and lower monotone envelopes, under cdf_type."""
    df, keep = gather(cdf, threshold_dim)
    kinds = {"original": F.col("cdf"), "upper": upper_envelope(F.col("cdf")), "lower": lower_envelope(F.col("cdf"))}
    out = None
    for kind, a in kinds.items():
        part = spread(df.withColumn("__a", a), keep, "__a", threshold_dim, cdf.value).withColumn("cdf_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def _exact(a: Column, obs: Column, weight: Column | None) -> tuple[Column, Column]:
    """Penalties below and above the observation; a has the observation among its thresholds, weight starts each segment."""

    def wide(p):
        return F.lit(1.0) if weight is None else F.coalesce(F.element_at(F.filter(weight, lambda w: w["t"] <= p["t"]), -1)["v"], F.lit(0.0))

    def rest(p, q):
        flip = lambda x: F.struct(x["t"].alias("t"), (1 - x["v"]).alias("v"))
        return square_integral(flip(p), flip(q))

    under = _segments(a, lambda p, q: F.when(q["t"] <= obs, square_integral(p, q) * wide(p)).otherwise(0.0))
    over = _segments(a, lambda p, q: F.when(p["t"] >= obs, rest(p, q) * wide(p)).otherwise(0.0))
    return _total(under), _total(over)


def _trapz(a: Column, obs: Column, weight: Column | None) -> tuple[Column, Column]:
    def part(side):
        def height(p):
            w = F.lit(1.0) if weight is None else F.coalesce(F.element_at(F.filter(weight, lambda x: x["t"] <= p["t"]), -1)["v"], F.lit(0.0))
            return w * F.pow(p["v"] - (p["t"] >= obs).cast("double"), 2) * side(p)

        return _total(_segments(a, lambda p, q: (height(p) + height(q)) / 2 * (q["t"] - p["t"])))

    total, over = part(lambda p: F.lit(1.0)), part(lambda p: (p["t"] >= obs).cast("double"))
    return total - over, over


def _crossings(a: Column) -> Column:
    """Where the lines through the first and the last two known points leave [0, 1], outwards of them."""
    known = F.filter(a, lambda p: p["v"].isNotNull())

    def leaves(end: int, inner: int, outwards: int) -> Column:
        p, q = F.element_at(known, end), F.element_at(known, inner)
        slope = (p["v"] - q["v"]) / (p["t"] - q["t"])
        goal = F.when(slope * outwards > 0, 1.0).when(slope * outwards < 0, 0.0)
        return F.when(slope != 0, p["t"] + (goal - p["v"]) / slope)

    both = F.array(leaves(1, 2, -1), leaves(-1, -2, 1))
    return F.when(F.size(known) > 1, F.filter(both, lambda x: x.isNotNull()))


def _trapz_over_all(df: DataFrame, extra: list[float], method: str, few: int | None) -> DataFrame:
    """df's cases (f, obs) with the penalties __u and __o by trapezoids over the thresholds of all cases, their observations and
    the extra ones, without a row for each case and threshold.

    A distribution is a line between its own points, so its square is a parabola, and the trapezoids over a segment are its
    integral plus the slope's square times a sum of h^3 / 6 over the gaps h within. Running sums of that over all thresholds
    give it for any segment by its two ends. Three places take a neighbour among all thresholds: the observation, where the
    integrand jumps within the gap before it, and the ends of the tails, where a line is cut off at 0 or 1.
    """
    spark, kept = df.sparkSession, df.columns
    df = staged(df.withColumn("__case", F.monotonically_increasing_id()), "cases")
    given = spark.createDataFrame([(float(t),) for t in extra], "t double")
    every = df.select(F.explode(F.transform("f", lambda p: p["t"])).alias("t")).unionByName(df.select(F.col("obs").alias("t"))).unionByName(given)
    chain = previous(every.filter("t is not null").distinct(), [], "t", "t", "p", few)
    union = staged(running_sums(chain, [], "t", {"k": F.lit(1), "e": F.coalesce(F.pow(F.col("t") - F.col("p"), 3) / 6, F.lit(0.0))}, few=few), "union")
    ends = union.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    df = df.withColumn("__cuts", F.filter(_crossings(F.col("f")), lambda x: x.between(ends["low"], ends["high"])) if method == "linear" and ends["low"] is not None else F.array().cast("array<double>"))
    cuts = df.select("__case", F.explode("__cuts").alias("t"))
    ranked = union.select("t", F.lit(1).alias("n")).unionByName(cuts.select("t", F.lit(0).alias("n"))).groupBy("t").agg(F.max("n").alias("n"))
    ranked = attach(cuts, running_sums(ranked, [], "t", {"k": F.col("n")}, few=few).select("t", "k"), ["t"])
    sides = ranked.select("__case", F.explode(F.array("k", F.col("k") + 1)).alias("k")).join(union.select("k", "t"), "k")
    df = attach(df, sides.groupBy("__case").agg(F.collect_set("t").alias("__near")), ["__case"])
    more = F.concat(F.array("obs", *(F.lit(t).cast("double") for t in (ends["low"], ends["high"]))), F.coalesce("__near", F.array().cast("array<double>")))
    df = df.withColumn("f", once(with_thresholds(F.col("f"), more))).withColumn("f", once(fill(F.col("f"), method)))
    points = df.select("__case", F.explode("f").alias("x")).select("__case", F.col("x.t").alias("t"), F.col("x.v").alias("v"))
    points = points.join(union.select("t", "p", "e"), "t").groupBy("__case").agg(F.array_sort(F.collect_list(F.struct("t", "v", "e", "p"))).alias("__f"))
    df = attach(df, points, ["__case"])
    o = F.col("obs")

    def part(p, q):
        slope = (q["v"] - p["v"]) / (q["t"] - p["t"])
        return slope * slope * (q["e"] - p["e"])

    def rest(p, q):
        flip = lambda x: F.struct(x["t"].alias("t"), (1 - x["v"]).alias("v"))
        return square_integral(flip(p), flip(q))

    at = F.element_at(F.filter("__f", lambda p: p["t"] == o), 1)
    gap = F.coalesce(o - at["p"], F.lit(0.0)) / 2  # before the observation its side of the integrand ends, from it on the other begins
    under = _total(_segments(F.col("__f"), lambda p, q: F.when(q["t"] <= o, square_integral(p, q) + part(p, q)).otherwise(0.0))) - gap * at["v"] * at["v"]
    over = _total(_segments(F.col("__f"), lambda p, q: F.when(p["t"] >= o, rest(p, q) + part(p, q)).otherwise(0.0))) + gap * F.pow(1 - at["v"], 2)
    return df.select(*kept, under.alias("__u"), over.alias("__o"))


def crps_cdf(fcst: Field, obs: Field, *, threshold_dim: str = "threshold", threshold_weight: Field | None = None, additional_thresholds: list[float] | None = None, propagate_nans: bool = True, fcst_fill_method: str = "linear", threshold_weight_fill_method: str = "forward", integration_method: str = "exact", reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, include_components: bool = False, threshold_union: str = "case", few: int | None = None) -> DataFrame:
    """Integral of weight * (F - 1{t >= obs})^2 over the thresholds of the case, those given, and the observation.

    With the exact method weights are 0 or 1 and hold from a threshold to the next. The trapezoidal method takes the
    thresholds of the case and the observation or, with threshold_union "all" (without a threshold_weight), the thresholds
    and observations of all cases. An observation beyond the thresholds extends the distribution by the fill method.
    """
    if integration_method not in ("exact", "trapz") or threshold_union not in ("case", "all"):
        raise ValueError("integration_method is exact or trapz, threshold_union is case or all")
    over_all = threshold_union == "all" and integration_method == "trapz"
    if over_all and threshold_weight is not None:
        raise ValueError("a threshold_weight goes with the thresholds of each case")
    df, cases = gather(fcst, threshold_dim, "f")
    other, dims = align(obs=obs, **({"weight": weights} if weights is not None else {}))
    shared = [d for d in cases if d in other.columns]
    df = df.join(other, shared) if shared else df.crossJoin(other)
    dims = list(dict.fromkeys([*cases, *dims]))
    extra = F.array(F.col("obs"), *(F.lit(float(t)) for t in additional_thresholds or []))
    if threshold_weight is not None:
        w, own = gather(threshold_weight, threshold_dim, "w")
        on = [d for d in own if d in df.columns]
        df = df.join(w, on) if on else df.crossJoin(w)
        extra = F.concat(extra, F.transform("w", lambda p: p["t"]))
    given = propagate_nan(F.col("f")) if propagate_nans else F.col("f")
    df = df.withColumn("f", once(given))
    if over_all:
        df = _trapz_over_all(df, additional_thresholds or [], fcst_fill_method, few)
    else:
        df = df.withColumn("f", once(with_thresholds(F.col("f"), extra))).withColumn("f", once(fill(F.col("f"), fcst_fill_method)))
    w = None
    if threshold_weight is not None:
        df = df.withColumn("w", once(with_thresholds(F.col("w"), F.transform("f", lambda p: p["t"]))))
        df = df.withColumn("w", once(fill(F.col("w"), threshold_weight_fill_method, 2 if threshold_weight_fill_method == "linear" else 1)))
        w = F.col("w")
    if not over_all:
        under, over = (_exact if integration_method == "exact" else _trapz)(F.col("f"), F.col("obs"), w)
        df = df.withColumn("__u", under).withColumn("__o", over)
    known = F.col("obs").isNotNull() & F.col("__u").isNotNull() & F.col("__o").isNotNull() & ~F.exists("f", lambda p: p["v"].isNull())
    parts = {"crps": F.col("__u") + F.col("__o")}
    if include_components:
        parts |= {"underforecast_penalty": F.col("__u"), "overforecast_penalty": F.col("__o")}
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    weight = F.col("weight") if weights is not None else None
    return df.groupBy(*keep).agg(*(wmean(F.when(known, v), weight).alias(k) for k, v in parts.items()))


def crps_cdf_brier_decomposition(fcst: Field, obs: Field, *, threshold_dim: str = "threshold", additional_thresholds: list[float] | None = None, fcst_fill_method: str = "linear", reduce_dims: Dims = None, preserve_dims: Dims = None) -> DataFrame:
    """Mean Brier score at each threshold of the forecasts (and those given), and its parts over and under."""
    df, cases = gather(fcst, threshold_dim, "f")
    other, dims = align(obs=obs)
    shared = [d for d in cases if d in other.columns]
    df = df.join(other, shared) if shared else df.crossJoin(other)
    dims = list(dict.fromkeys([*cases, *dims]))
    extra = F.array(*(F.lit(float(t)) for t in additional_thresholds or [])).cast("array<double>")
    df = df.withColumn("f", once(with_thresholds(F.col("f"), extra))).withColumn("f", once(fill(F.col("f"), fcst_fill_method)))
    rows = df.select(*(d for d in dims if d in df.columns), "obs", F.explode("f").alias("p")).withColumn(threshold_dim, F.col("p.t"))
    v, o, t = F.col("p.v"), F.col("obs"), F.col(threshold_dim)
    known = v.isNotNull() & o.isNotNull()
    over = F.when(known, F.when(t >= o, F.pow(v - 1, 2)).otherwise(0.0))
    under = F.when(known, F.when(t < o, F.pow(v, 2)).otherwise(0.0))
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    return rows.groupBy(*keep, threshold_dim).agg(F.avg(over + under).alias("total_penalty"), F.avg(under).alias("underforecast_penalty"), F.avg(over).alias("overforecast_penalty"))


def adjust_fcst_for_crps(fcst: Field, threshold_dim: str, obs: Field, *, decreasing_tolerance: float = 0.0, additional_thresholds: list[float] | None = None, fcst_fill_method: str = "linear", integration_method: str = "exact") -> DataFrame:
    """Distributions that decrease by more than the tolerance are replaced by that of the three (themselves, the upper and
    the lower envelope) whose score is the worst; the first of them at a tie. One missing value makes a distribution missing.
    additional_thresholds are those of the score."""
    if decreasing_tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    df, cases = gather(fcst, threshold_dim, "f")
    df = df.withColumn("f", once(propagate_nan(F.col("f"))))
    shared = [d for d in cases if d in obs.dims]
    df = df.join(obs.df.select(*obs.dims, obs.column().alias("obs")), shared) if shared else df.crossJoin(obs.df.select(*obs.dims, obs.column().alias("obs")))
    keep = list(dict.fromkeys([*cases, *obs.dims]))

    kinds = F.array(*(F.struct(F.lit(-i).alias("order"), a.alias("a")) for i, a in enumerate((F.col("f"), upper_envelope(F.col("f")), lower_envelope(F.col("f"))))))
    rows = df.withColumn("bad", decrease(F.col("f")) < -float(decreasing_tolerance)).withColumn("kind", F.explode(kinds)).filter((F.col("kind.order") == 0) | F.col("bad"))
    rows = rows.withColumn("full", once(with_thresholds(F.col("kind.a"), F.array("obs", *(F.lit(float(t)) for t in additional_thresholds or []))))).withColumn("full", once(fill(F.col("full"), fcst_fill_method)))
    under, over = (_exact if integration_method == "exact" else _trapz)(F.col("full"), F.col("obs"), None)
    rows = rows.withColumn("score", F.coalesce(under + over, F.lit(-1.0)))
    best = rows.groupBy(*keep).agg(F.max_by("kind.a", F.struct("score", "kind.order")).alias("__f"))
    return spread(best, keep, "__f", threshold_dim, fcst.value)


def crps_step_threshold_weight(step_points: Field, threshold_values: list[float], *, threshold_dim: str = "threshold", steppoints_in_thresholds: bool = True, steppoint_precision: float = 0, weight_upper: bool = True) -> DataFrame:
    """Weight 1 from the step point on (0 with weight_upper False), 0 (1) before it."""
    out = observed_cdf(step_points, threshold_values, include_obs_in_thresholds=steppoints_in_thresholds, precision=steppoint_precision, threshold_dim=threshold_dim)
    return out.withColumn("cdf", F.col("cdf") if weight_upper else 1 - F.col("cdf")).withColumnRenamed("cdf", "weight")


def within_bounds(cdf: Field) -> bool:
    return not cdf.df.filter(~nn(F.col(cdf.value)).between(0.0, 1.0)).limit(1).count()
