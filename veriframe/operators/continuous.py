"""Measures of continuous forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.functions.exprs import angular_difference, clip, corr, div, gmax, ieee_div
from veriframe.plans.checks import asserted, checked_weight
from veriframe.plans.frame import Dims, Field, align, attach, match_missing, pointwise, reduce, resolve_dims, wmean
from veriframe.plans.ranges import previous, running_sums
from veriframe.plans.staging import staged


def _error(f: Column, o: Column, is_angular: bool) -> Column:
    return angular_difference(f, o) if is_angular else f - o


def mse(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, is_angular: bool = False) -> DataFrame:
    return pointwise(lambda f, o: F.pow(_error(f, o, is_angular), 2), "mse", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def rmse(fcst: Field, obs: Field, **options) -> DataFrame:
    return mse(fcst, obs, **options).withColumn("mse", F.sqrt("mse")).withColumnRenamed("mse", "rmse")


def mae(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, is_angular: bool = False) -> DataFrame:
    return pointwise(lambda f, o: F.abs(_error(f, o, is_angular)), "mae", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def additive_bias(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, name: str = "additive_bias") -> DataFrame:
    return pointwise(lambda f, o: f - o, name, reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def mean_error(fcst: Field, obs: Field, **options) -> DataFrame:
    return additive_bias(fcst, obs, name="mean_error", **options)


def _matched(fcst: Field, obs: Field, reduce_dims: Dims, preserve_dims: Dims, weights: Field | None = None):
    df, dims = align(fcst=fcst, obs=obs, **({"weight": weights} if weights is not None else {}))
    return match_missing(df, "fcst", "obs"), dims, resolve_dims(dims, reduce_dims, preserve_dims), checked_weight(F.col("weight")) if weights is not None else None


def multiplicative_bias(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    df, dims, keep, w = _matched(fcst, obs, reduce_dims, preserve_dims, weights)
    return reduce(df, dims, keep, multiplicative_bias=ieee_div(wmean(F.col("fcst"), w), wmean(F.col("obs"), w)))


def pbias(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    df, dims, keep, w = _matched(fcst, obs, reduce_dims, preserve_dims, weights)
    return reduce(df, dims, keep, pbias=100 * ieee_div(wmean(F.col("fcst") - F.col("obs"), w), wmean(F.col("obs"), w)))


def percent_within_x(fcst: Field, obs: Field, threshold: float, *, reduce_dims: Dims = None, preserve_dims: Dims = None, is_angular: bool = False, decimals: int | None = None, is_inclusive: bool = True) -> DataFrame:
    df, dims = align(fcst=fcst, obs=obs)
    e = F.abs(_error(F.col("fcst"), F.col("obs"), is_angular))
    e = F.bround(e, decimals) if decimals is not None else e
    hit = e <= threshold if is_inclusive else e < threshold
    return reduce(df, dims, resolve_dims(dims, reduce_dims, preserve_dims), percent_within_x=100 * div(F.count_if(hit).cast("double"), F.count(e)))


def kge(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, scaling_factors: tuple[float, float, float] = (1.0, 1.0, 1.0), include_components: bool = False) -> DataFrame:
    """Kling-Gupta efficiency."""
    df, dims, keep, _ = _matched(fcst, obs, reduce_dims, preserve_dims)
    f, o = F.col("fcst"), F.col("obs")
    out = reduce(df, dims, keep, rho=corr(f, o), alpha=ieee_div(F.stddev_pop(f), F.stddev_pop(o)), beta=ieee_div(F.avg(f), F.avg(o)))
    far = sum((F.pow(s * (F.col(c) - 1), 2) for s, c in zip(scaling_factors, ("rho", "alpha", "beta"), strict=True)), F.lit(0.0))
    out = out.withColumn("kge", 1 - F.sqrt(far))
    return out if include_components else out.drop("rho", "alpha", "beta")


def pearsonr(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None) -> DataFrame:
    df, dims = align(fcst=fcst, obs=obs)
    return reduce(df, dims, resolve_dims(dims, reduce_dims, preserve_dims), pearsonr=corr(F.col("fcst"), F.col("obs")))


def spearmanr(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None) -> DataFrame:
    """Ranks of the known values of each side (ties share their mean rank), then Pearson's correlation.

    Ranks come from running sums of the counts of distinct values, and the correlation from the counts of pairs of values, so
    that only pairs, and not rows, meet their ranks.
    """
    df, dims = align(fcst=fcst, obs=obs)
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    pairs = counted = staged(df.groupBy(*keep, "fcst", "obs").agg(F.count("*").alias("n")), "pairs")
    for side in ("fcst", "obs"):
        n = counted.filter(F.col(side).isNotNull()).groupBy(*keep, side).agg(F.sum("n").alias("n"))
        ranks = running_sums(n, keep, side, {"upto": F.col("n")}).select(*keep, side, (F.col("upto") - (F.col("n") - 1) / 2).alias(f"{side}_rank"))
        pairs = attach(pairs, ranks, [*keep, side])
    known = F.col("fcst_rank").isNotNull() & F.col("obs_rank").isNotNull()
    known_pairs = pairs.filter(known)
    n, x, y = F.col("n").cast("double"), F.col("fcst_rank"), F.col("obs_rank")
    means = known_pairs.groupBy(*keep).agg((F.sum(n * x) / F.sum(n)).alias("mx"), (F.sum(n * y) / F.sum(n)).alias("my"))
    off = attach(known_pairs, means, keep)
    dx, dy = F.col("fcst_rank") - F.col("mx"), F.col("obs_rank") - F.col("my")
    sums = off.groupBy(*keep).agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"))
    sums = sums.select(*keep, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt("xx") / F.sqrt("yy")).alias("spearmanr"))
    return attach(counted.select(*keep).distinct(), sums, keep) if keep else sums


def nse(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, is_angular: bool = False, include_components: bool = False) -> DataFrame:
    """Nash-Sutcliffe efficiency: the observations' mean is unweighted, both errors are weighted.

    With components also fcst_error, obs_variance and no_variance, which tells where the observations don't vary, so that
    the efficiency is minus infinity, or NULL for perfect forecasts.
    """
    df, dims, keep, w = _matched(fcst, obs, reduce_dims, preserve_dims, weights)
    f, o = F.col("fcst"), F.col("obs")
    if keep == dims:
        raise ValueError("at least one dimension has to be reduced")
    low = df.groupBy(*keep).agg(F.avg("obs").alias("mean"))
    joined = attach(df, low, keep)
    off = _error(F.col("mean"), o, is_angular)
    out = reduce(joined, dims, keep, fcst_error=wmean(F.pow(_error(f, o, is_angular), 2), w), obs_variance=wmean(F.pow(off, 2), w))
    out = out.withColumn("nse", 1 - ieee_div(F.col("fcst_error"), F.col("obs_variance")))
    return out.withColumn("no_variance", F.col("obs_variance") == 0) if include_components else out.select(*keep, "nse")


def check_alpha(alpha: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")


def check_huber(param: float) -> None:
    if not param > 0:
        raise ValueError("the Huber parameter must be above 0")


def expectile_expr(f: Column, o: Column, alpha: float, phi, phi_prime) -> Column:
    b = phi(o) - phi(f) - phi_prime(f) * (o - f)
    return F.when(o < f, (1 - alpha) * b).otherwise(alpha * b)


def huber_expr(f: Column, o: Column, param: float, phi, phi_prime) -> Column:
    k = clip(f - o, F.lit(-float(param)), F.lit(float(param)))
    return 0.5 * (phi(o) - phi(k + o) + k * phi_prime(f))


def quantile_expr(f: Column, o: Column, alpha: float, g=lambda x: x) -> Column:
    d = g(f) - g(o)
    return F.when(o < f, (1 - alpha) * d).otherwise(-alpha * d)


def consistent_expectile_score(fcst: Field, obs: Field, alpha: float, phi, phi_prime, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    """phi and phi_prime take and give columns."""
    check_alpha(alpha)
    return pointwise(lambda f, o: expectile_expr(f, o, alpha, phi, phi_prime), "score", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def consistent_huber_score(fcst: Field, obs: Field, huber_param: float, phi, phi_prime, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    check_huber(huber_param)
    return pointwise(lambda f, o: huber_expr(f, o, huber_param, phi, phi_prime), "score", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def consistent_quantile_score(fcst: Field, obs: Field, alpha: float, g, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    check_alpha(alpha)
    return pointwise(lambda f, o: quantile_expr(f, o, alpha, g), "score", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def quantile_score(fcst: Field, obs: Field, alpha: float, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    check_alpha(alpha)
    return pointwise(lambda f, o: quantile_expr(f, o, alpha), "quantile_score", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def quantile_interval_score(lower: Field, upper: Field, obs: Field, lower_level: float, upper_level: float, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, check_args: bool = True) -> DataFrame:
    if not 0 < lower_level < upper_level < 1:
        raise ValueError("levels must satisfy 0 < lower < upper < 1")

    def parts(lo, up, o):
        width = asserted(up - lo, lo <= up, "a lower quantile is above the upper one") if check_args else up - lo
        over, under = gmax(lo - o, F.lit(0.0)) / lower_level, gmax(o - up, F.lit(0.0)) / (1 - upper_level)
        return {"interval_width_penalty": width, "overprediction_penalty": over, "underprediction_penalty": under, "total": width + over + under}

    return pointwise(parts, "", reduce_dims, preserve_dims, weights, lower=lower, upper=upper, obs=obs)


def interval_score(lower: Field, upper: Field, obs: Field, interval_range: float, **options) -> DataFrame:
    if not 0 < interval_range < 1:
        raise ValueError("interval_range must be between 0 and 1")
    return quantile_interval_score(lower, upper, obs, (1 - interval_range) / 2, (1 + interval_range) / 2, **options)


# Threshold weighting: the weight is 1 on an interval, and falls to 0 on both sides if a wider one is given. g is the
# weight's integral, phi four times g's. An endless side is closed row by row beyond the row's values, which changes no score.


def _finite(x: float | Column, f: Column, o: Column, others: list, up: bool) -> Column:
    if isinstance(x, Column) or abs(x) != float("inf"):
        return F.lit(x) if not isinstance(x, Column) else x
    ends = [F.lit(y) for y in others if not isinstance(y, Column) and abs(y) != float("inf")] + [y for y in others if isinstance(y, Column)]
    return F.greatest(f, o, *ends) + 1 if up else F.least(f, o, *ends) - 1


def weighting(f: Column, o: Column, one: tuple, positive: tuple | None = None):
    """g, phi and phi' for the weight."""
    every = list(one) + list(positive or ())
    b, c = _finite(one[0], f, o, every, False), _finite(one[1], f, o, every, True)
    if positive is None:

        def g(x):
            return F.when(x < b, F.lit(0.0)).when(x < c, x - b).when(x >= c, c - b)

        def phi(x):
            return F.when(x < b, F.lit(0.0)).when(x < c, 2 * F.pow(x - b, 2)).when(x >= c, 2 * F.pow(c - b, 2) + 4 * (c - b) * (x - c))

    else:
        a = _finite(positive[0], f, o, every, False)
        a = F.when(a < b, a).otherwise(b - 1)
        d = _finite(positive[1], f, o, every, True)
        d = F.when(d > c, d).otherwise(c + 1)
        rise, fall = b - a, d - c
        gb = rise / 2
        gc, gd = gb + (c - b), gb + (c - b) + fall / 2

        def g(x):
            up, down = F.pow(x - a, 2) / (2 * rise), gc + (fall / 2 - F.pow(d - x, 2) / (2 * fall))
            return F.when(x < a, F.lit(0.0)).when(x < b, up).when(x < c, gb + (x - b)).when(x < d, down).when(x >= d, gd)

        pb = 2 * F.pow(rise, 2) / 3
        pc = pb + 4 * gb * (c - b) + 2 * F.pow(c - b, 2)

        def down(x):
            t = x - c
            return pc + 4 * gc * t + 4 * (F.pow(t, 2) / 2 - F.pow(t, 3) / (6 * fall))

        def phi(x):
            flat = pb + 4 * gb * (x - b) + 2 * F.pow(x - b, 2)
            return F.when(x < a, F.lit(0.0)).when(x < b, 2 * F.pow(x - a, 3) / (3 * rise)).when(x < c, flat).when(x < d, down(x)).when(x >= d, down(d) + 4 * gd * (x - d))

    return g, phi, lambda x: 4 * g(x)


def _check_ends(one: tuple, positive: tuple | None) -> None:
    if len(one) != 2 or (positive is not None and len(positive) != 2):
        raise ValueError("intervals have two endpoints")
    plain = [x for x in one if not isinstance(x, Column)]
    if len(plain) == 2 and not one[0] < one[1]:
        raise ValueError("the interval's left end must be below its right end")
    if positive is not None:
        for wide, inner, sign in ((positive[0], one[0], 1), (positive[1], one[1], -1)):
            if not isinstance(wide, Column) and not isinstance(inner, Column) and not (sign * wide < sign * inner or wide == inner and abs(wide) == float("inf")):
                raise ValueError("the positive interval must lie around the other")


def _weighted(make, name, fcst, obs, one, positive, reduce_dims, preserve_dims, weights):
    _check_ends(one, positive)
    return pointwise(lambda f, o: make(f, o, *weighting(f, o, one, positive)), name, reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def tw_squared_error(fcst: Field, obs: Field, interval_where_one: tuple, *, interval_where_positive: tuple | None = None, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    return _weighted(lambda f, o, g, phi, dphi: expectile_expr(f, o, 0.5, phi, dphi), "tw_squared_error", fcst, obs, interval_where_one, interval_where_positive, reduce_dims, preserve_dims, weights)


def tw_absolute_error(fcst: Field, obs: Field, interval_where_one: tuple, *, interval_where_positive: tuple | None = None, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    return _weighted(lambda f, o, g, phi, dphi: 2 * quantile_expr(f, o, 0.5, g), "tw_absolute_error", fcst, obs, interval_where_one, interval_where_positive, reduce_dims, preserve_dims, weights)


def tw_quantile_score(fcst: Field, obs: Field, alpha: float, interval_where_one: tuple, *, interval_where_positive: tuple | None = None, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    check_alpha(alpha)
    return _weighted(lambda f, o, g, phi, dphi: quantile_expr(f, o, alpha, g), "tw_quantile_score", fcst, obs, interval_where_one, interval_where_positive, reduce_dims, preserve_dims, weights)


def tw_expectile_score(fcst: Field, obs: Field, alpha: float, interval_where_one: tuple, *, interval_where_positive: tuple | None = None, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    check_alpha(alpha)
    return _weighted(lambda f, o, g, phi, dphi: 0.5 * expectile_expr(f, o, alpha, phi, dphi), "tw_expectile_score", fcst, obs, interval_where_one, interval_where_positive, reduce_dims, preserve_dims, weights)


def tw_huber_loss(fcst: Field, obs: Field, huber_param: float, interval_where_one: tuple, *, interval_where_positive: tuple | None = None, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    check_huber(huber_param)
    return _weighted(lambda f, o, g, phi, dphi: 0.5 * huber_expr(f, o, huber_param, phi, dphi), "tw_huber_loss", fcst, obs, interval_where_one, interval_where_positive, reduce_dims, preserve_dims, weights)


# Flip-flop index: differences of neighbours along a dimension, and the spread of all values. Neither gathers a series.


def _sectors(rows: DataFrame, keep: list[str], value: str, few: int | None) -> DataFrame:
    """keep and __sector: the smallest sector, in degrees, that covers the known angles, which is the circle without its
    widest gap."""
    turned = rows.filter(F.col(value).isNotNull()).select(*keep, F.pmod(F.col(value), F.lit(360.0)).alias("__a")).distinct()
    chain = previous(turned, keep, "__a", "__a", "__p", few)
    ends = chain.groupBy(*keep).agg(F.max(F.col("__a") - F.col("__p")).alias("__gap"), F.min("__a").alias("__low"), F.max("__a").alias("__high"))
    return ends.select(*keep, (360 - F.greatest(F.coalesce("__gap", F.lit(0.0)), F.col("__low") + 360 - F.col("__high"))).alias("__sector"))


def _flip_flops(rows: DataFrame, keep: list[str], is_angular: bool, few: int | None) -> DataFrame:
    """Of rows (keep, __at, __v); NULL if a value is missing or there are fewer than three."""
    chain = previous(rows, keep, "__at", "__v", "__p", few)
    step = angular_difference(F.col("__v"), F.col("__p")) if is_angular else F.abs(F.col("__v") - F.col("__p"))
    sums = chain.groupBy(*keep).agg(F.count("*").alias("__n"), F.count("__v").alias("__known"), F.sum(step).alias("__steps"), (F.max("__v") - F.min("__v")).alias("__spread"))
    if is_angular:
        sums = attach(sums, _sectors(rows, keep, "__v", few), keep).withColumn("__spread", F.least("__sector", F.lit(180.0)))
    index = F.when((F.col("__n") > 2) & (F.col("__known") == F.col("__n")), (F.col("__steps") - F.col("__spread")) / (F.col("__n") - 2))
    return sums.select(*keep, index.alias("flip_flop_index"))


def flip_flop_index(data: Field, sampling_dim: str, *, is_angular: bool = False, selections: dict[str, list] | None = None, few: int | None = None) -> DataFrame:
    """The index along sampling_dim, in the order of its labels or, for each named selection, in the order listed.

    A label that doesn't occur is a KeyError, which takes a job over the labels. Series of any length are dealt by ranges of
    their labels; `few` is the number of rows up to which they are not.
    """
    keep = [d for d in data.dims if d != sampling_dim]
    df = data.df.select(*keep, F.col(f"`{sampling_dim}`").alias("__at"), data.column().alias("__v"))
    if not selections:
        return _flip_flops(df, keep, is_angular, few)
    kind = df.schema["__at"].dataType
    listed = [(name, i, label) for name, labels in selections.items() for i, label in enumerate(labels)]
    picks = df.sparkSession.createDataFrame(listed, T.StructType([T.StructField("selection", T.StringType()), T.StructField("__place", T.IntegerType()), T.StructField("__at", kind)]))
    found = {r[0] for r in df.join(F.broadcast(picks.select("__at").distinct()), "__at").select("__at").distinct().collect()}  # of the labels listed
    if lacking := {label for _, _, label in listed} - found:
        raise KeyError(f"labels of {sampling_dim} that don't occur: {sorted(map(str, lacking))}")
    rows = df.join(F.broadcast(picks), "__at").select(*keep, "selection", F.col("__place").alias("__at"), "__v")
    return _flip_flops(rows, [*keep, "selection"], is_angular, few)


def flip_flop_index_proportion_exceeding(data: Field, sampling_dim: str, thresholds: list[float], *, is_angular: bool = False, selections: dict[str, list] | None = None, reduce_dims: Dims = None, preserve_dims: Dims = None) -> DataFrame:
    index = flip_flop_index(data, sampling_dim, is_angular=is_angular, selections=selections)
    keep = resolve_dims([d for d in data.dims if d != sampling_dim], reduce_dims, preserve_dims) + (["selection"] if selections else [])
    rows = index.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    hit = F.when(F.col("flip_flop_index").isNotNull(), (F.col("flip_flop_index") >= F.col("threshold")).cast("double"))
    return rows.groupBy(*keep, "threshold").agg(F.avg(hit).alias("proportion"))


def encompassing_sector_size(data: Field, dim: str, *, skipna: bool = False, few: int | None = None) -> DataFrame:
    """The smallest sector, in degrees, that covers the angles along dim; NULL if one is missing (or, with skipna, all are)."""
    keep = [d for d in data.dims if d != dim]
    rows = data.df.select(*keep, data.column().alias("__v"))
    counts = rows.groupBy(*keep).agg((F.count("*") == F.count("__v")).alias("__whole"))
    out = attach(counts, _sectors(rows, keep, "__v", few), keep)
    return out.select(*keep, F.when(F.lit(skipna) | F.col("__whole"), F.col("__sector")).alias("sector_size"))
