"""Data behind diagnostic plots: ROC, Murphy and Q-Q."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.exprs import div
from veriframe.operators.continuous import check_alpha, check_huber
from veriframe.plans.checks import asserted, binary_rule
from veriframe.plans.frame import Dims, Field, align, attach, match_missing, resolve_dims
from veriframe.plans.ranges import running_sums
from veriframe.plans.staging import staged


def roc(fcst: Field, obs: Field, thresholds: list[float] | str = "auto", *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, check_args: bool = True) -> DataFrame:
    """POD and POFD at each threshold (fcst >= threshold), with infinity added, and the area under the curve, AUC.

    Rows are first summed by forecast value, and running sums over those give every threshold, in place of a comparison of
    each row with each threshold. With given thresholds a value counts at the largest one that it reaches. With check_args the
    query fails where a forecast isn't a probability or an observation isn't 0 or 1.
    """
    df, dims = align(__f=fcst, __o=obs, **({"__w": weights} if weights is not None else {}))
    if check_args:
        df = df.withColumn("__f", asserted(F.col("__f"), F.col("__f").between(0.0, 1.0), "probabilities must lie in [0, 1]"))
        df = df.withColumn("__o", asserted(F.col("__o"), binary_rule(F.col("__o")), "observations must be 0 or 1"))
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    w = F.col("__w") if weights is not None else F.lit(1.0)
    rows = df.filter("__f is not null and __o is not null").select(*keep, "__f", (F.col("__o") * w).alias("pos"), ((1 - F.col("__o")) * w).alias("neg"))
    inf = float("inf")
    if thresholds == "auto":
        rows = rows.withColumn("t", F.col("__f"))
    else:
        ts = sorted({float(t) for t in thresholds})
        ts = ts if ts and ts[0] <= 0 else [0.0, *ts]
        reach = F.filter(F.array(*map(F.lit, ts)), lambda t: t <= F.col("__f"))
        rows = rows.withColumn("t", F.when(F.size(reach) > 0, F.element_at(reach, -1)))
    sums = staged(rows.groupBy(*keep, "t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "sums")
    if thresholds == "auto":
        marks = sums.select("t").distinct().unionByName(df.sparkSession.createDataFrame([(inf,), (0.0,)], "t double")).distinct()
    else:
        marks = df.sparkSession.createDataFrame([(t,) for t in sorted({*ts, inf})], "t double")
    groups = sums.select(*keep).distinct() if keep else None
    zeros = (groups.crossJoin(marks) if keep else marks).select(*keep, "t", F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
    sums = sums.unionByName(zeros).groupBy(*keep, "t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # below the least threshold t is NULL: that belongs to the totals only
    totals = sums.groupBy(*keep).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    run = running_sums(sums.filter("t is not null"), keep, "t", {"hits": F.col("pos"), "alarms": F.col("neg")}, descending=True)
    curve = attach(run, totals, keep).select(*keep, F.col("t").alias("threshold"), div(F.col("hits"), F.col("__p")).alias("POD"), div(F.col("alarms"), F.col("__n")).alias("POFD"), "pos", "neg", "__p", "__n")
    # a trapezoid from the threshold above, where POD is less by pos and POFD by neg
    area = div(F.col("neg"), F.col("__n")) * (2 * F.col("POD") - div(F.col("pos"), F.col("__p"))) / 2
    areas = curve.groupBy(*keep).agg(F.sum(area).alias("AUC"))
    return attach(curve.drop("pos", "neg", "__p", "__n"), areas, keep)


def murphy_score(fcst: Field, obs: Field, thetas: list[float], *, functional: str, alpha: float, huber_a: float | None = None, decomposition: bool = False, reduce_dims: Dims = None, preserve_dims: Dims = None) -> DataFrame:
    """Mean elementary score at each theta, all thetas in one pass over the rows."""
    check_alpha(alpha)
    if functional == "huber":
        check_huber(huber_a or 0)
    elif functional not in ("quantile", "expectile"):
        raise ValueError("functional is quantile, huber or expectile")
    df, dims = align(__f=fcst, __o=obs)
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    f, o = F.col("__f"), F.col("__o")
    known = f.isNotNull() & o.isNotNull()
    aggs, rows = [], []
    for i, theta in enumerate(thetas):
        t = F.lit(float(theta))
        far = F.abs(o - t)
        size: dict[str, Column] = {"quantile": F.lit(1.0), "expectile": far, "huber": F.least(far, F.lit(float(huber_a or 0)))}
        over = F.when(known, F.when((f > t) & (o <= t), (1 - alpha) * size[functional]).otherwise(0.0))
        under = F.when(known, F.when((f <= t) & (t < o), alpha * size[functional]).otherwise(0.0))
        aggs += [F.avg(over).alias(f"over{i}"), F.avg(under).alias(f"under{i}")]
        rows.append(F.struct(t.alias("theta"), (F.col(f"over{i}") + F.col(f"under{i}")).alias("total"), F.col(f"over{i}").alias("overforecast"), F.col(f"under{i}").alias("underforecast")))
    out = df.groupBy(*keep).agg(*aggs).select(*keep, F.explode(F.array(*rows)).alias("x")).select(*keep, "x.*")
    return out if decomposition else out.drop("overforecast", "underforecast")


def murphy_thetas(forecasts: list[Field], obs: Field, functional: str, *, huber_a: float | None = None, left_limit_delta: float = 0.0) -> DataFrame:
    """The thetas at which the measure bends, distinct and in order."""

    def points(f: Field, *moves: float):
        return f.df.select(F.explode(F.array(*(f.column() + m for m in moves))).alias("theta"))

    if functional not in ("quantile", "huber", "expectile"):
        raise ValueError("functional is quantile, huber or expectile")
    near = (0.0,) if functional == "quantile" else (0.0, -left_limit_delta)
    out = points(obs, *((0.0, -huber_a, huber_a) if functional == "huber" else (0.0,)))
    for f in forecasts:
        out = out.unionByName(points(f, *near))
    return out.filter("theta is not null").distinct().orderBy("theta")


#: Place of a quantile q among n sorted values, from 0, as (alpha, beta) of q (n + 1 - alpha - beta) + alpha - 1.
PLACES = {"interpolated_inverted_cdf": (0.0, 1.0), "hazen": (0.5, 0.5), "weibull": (0.0, 0.0), "linear": (1.0, 1.0), "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8)}
METHODS = [*PLACES, "inverted_cdf", "averaged_inverted_cdf", "closest_observation", "lower", "higher", "midpoint", "nearest"]


def places_of(n: Column, q: float, method: str) -> Column:
    """Where a quantile of n sorted values lies: a struct of the places, from 0, of two of them and the share of the second."""
    last = n.cast("double") - 1
    tiny = 1e-12  # a place this near a whole number is one

    def between(low: Column, high: Column, share: Column) -> Column:
        inside = lambda i: F.greatest(F.least(i.cast("double"), last), F.lit(0.0)).cast("long")
        return F.struct(inside(low).alias("low"), inside(high).alias("high"), share.alias("share"))

    def at(i: Column) -> Column:
        return between(i, i, F.lit(0.0))

    if method in PLACES:
        a, b = PLACES[method]
        place = F.greatest(F.least(q * (last + 2 - a - b) + a - 1, last), F.lit(0.0))
        low = F.floor(place + tiny)
        return between(low, low + 1, F.greatest(place - low, F.lit(0.0)))
    place, nq = q * last, (last + 1) * q
    if method == "lower":
        return at(F.floor(place + tiny))
    if method == "higher":
        return at(F.ceil(place - tiny))
    if method == "midpoint":
        return between(F.floor(place + tiny), F.ceil(place - tiny), F.lit(0.5))
    if method == "nearest":
        return at(F.rint(place))
    if method == "inverted_cdf":
        return at(F.ceil(nq - tiny) - 1)
    if method == "averaged_inverted_cdf":
        return F.when(F.abs(nq - F.rint(nq)) < tiny, between(F.rint(nq) - 1, F.rint(nq), F.lit(0.5))).otherwise(at(F.ceil(nq) - 1))
    if method == "closest_observation":
        low = F.floor(nq - 0.5 + tiny)
        even = (F.abs(nq - 0.5 - low) < tiny) & (F.pmod(low, F.lit(2)) == 0)
        return at(F.when(even, low - 1).otherwise(low))
    raise ValueError(f"the method is one of {METHODS}")


def select_quantiles(values: DataFrame, keep: list[str], value: str, quantiles: list[float], method: str, few: int | None = None) -> DataFrame:
    """keep, quantile and value of the known values in each group: order statistics picked from running counts of the distinct
    values, which are dealt by ranges, so that no group's values meet in one place."""
    counts = staged(values.filter(F.col(value).isNotNull()).groupBy(*keep, value).agg(F.count("*").alias("__n")), "counts")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), places_of(F.col("__all"), q, method).alias("p")) for i, q in enumerate(quantiles)))
    totals = counts.groupBy(*keep).agg(F.sum("__n").alias("__all")).select(*keep, wanted.alias("__want"))
    run = attach(running_sums(counts, keep, value, {"__upto": F.col("__n")}, few=few), totals, keep)
    held = lambda i: (i >= F.col("__upto") - F.col("__n")) & (i < F.col("__upto"))
    hits = run.withColumn("__want", F.filter("__want", lambda w: held(w["p"]["low"]) | held(w["p"]["high"])))
    hits = hits.filter(F.size("__want") > 0).select(*keep, F.explode("__want").alias("w"), F.col(value).alias("__v"), "__upto", "__n")
    low, high = (F.max(F.when(held(F.col(f"w.p.{c}")), F.col("__v"))) for c in ("low", "high"))
    got = hits.groupBy(*keep, "w.i").agg((low + F.when(F.max("w.p.share") > 0, (high - low) * F.max("w.p.share")).otherwise(0.0)).alias("value"))
    return got.select(*keep, F.element_at(F.array(*map(F.lit, quantiles)), F.col("i") + 1).alias("quantile"), "value")


def qq(fcst: Field, obs: Field, *, quantiles: list[float], interpolation_method: str = "linear", data_source_dim: str = "data_source", reduce_dims: Dims = None, preserve_dims: Dims = None, few: int | None = None) -> DataFrame:
    """Quantiles of both sides on the rows where both are known; NULL for a group without any."""
    if not all(0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie in [0, 1]")
    if interpolation_method not in METHODS:
        raise ValueError(f"the method is one of {METHODS}")
    df, dims = align(fcst=fcst, obs=obs)
    df, keep, qs = match_missing(df, "fcst", "obs"), resolve_dims(dims, reduce_dims, preserve_dims), [float(q) for q in quantiles]
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias(data_source_dim), F.col(c).alias("__v")) for c in ("fcst", "obs")))).alias("s")
    both = df.select(*keep, sides).select(*keep, "s.*")
    got = select_quantiles(both, [*keep, data_source_dim], "__v", qs, interpolation_method, few)
    groups = df.groupBy(*keep).agg(F.lit(1).alias("__one"))
    points = F.explode(F.array(*(F.struct(F.lit(c).alias(data_source_dim), F.lit(q).alias("quantile")) for c in ("fcst", "obs") for q in qs))).alias("p")
    return attach(groups.select(*keep, points).select(*keep, "p.*"), got.distinct(), [*keep, data_source_dim, "quantile"])
