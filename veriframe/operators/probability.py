"""Measures of probabilities and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.exprs import clip, gmax, gmin
from veriframe.operators.discretise import compare
from veriframe.plans.checks import asserted, binary_rule
from veriframe.plans.frame import Dims, Field, align, pointwise, reduce, resolve_dims, wmean


def brier_score(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, check_args: bool = True) -> DataFrame:
    """With check_args the query fails where a forecast isn't a probability or an observation isn't 0 or 1."""

    def score(f, o):
        if check_args:
            f = asserted(f, f.between(0.0, 1.0), "probabilities must lie in [0, 1]")
            o = asserted(o, binary_rule(o), "observations must be 0 or 1")
        return F.pow(f - o, 2)

    return pointwise(score, "brier_score", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs)


def members(fcst: Field, ensemble_dim: str) -> Field:
    """Member rows gathered as one array for each case; the array's order doesn't matter."""
    keep = [d for d in fcst.dims if d != ensemble_dim]
    rows = fcst.df.select(*keep, F.struct(fcst.column().alias("v")).alias("x")).groupBy(*keep).agg(F.transform(F.collect_list("x"), lambda x: x["v"]).alias(fcst.value))
    return Field(rows, tuple(keep), fcst.value)


def _cases(fcst: Field, obs: Field, ensemble_dim: str | None, weights: Field | None) -> tuple[DataFrame, list[str]]:
    """Rows with the column members, an array without missing ones, and obs."""
    ens = members(fcst, ensemble_dim) if ensemble_dim else fcst
    others = {"obs": obs} | ({"weight": weights} if weights is not None else {})
    if all(f.df is ens.df for f in others.values()):
        keys = [d for d in ens.dims if d in ens.df.columns]
        df = ens.df.select(*keys, F.col(ens.value).cast("array<double>").alias("members"), *(f.column().alias(n) for n, f in others.items()))
        dims = list(ens.dims)
    else:
        right, dims = align(**others)
        own = ens.df.select(*ens.dims, F.col(ens.value).cast("array<double>").alias("members"))
        shared = [d for d in ens.dims if d in right.columns]
        df = own.join(right, shared) if shared else own.crossJoin(right)
        dims = list(dict.fromkeys([*ens.dims, *dims]))
    known = F.filter("members", lambda x: x.isNotNull() & ~F.isnan(x))
    return df.withColumn("members", known), dims


def brier_score_for_ensemble(fcst: Field, obs: Field, ensemble_dim: str | None, event_thresholds: list[float], *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, fair_correction: bool = True, op: str = ">=") -> DataFrame:
    """A row for each threshold; fcst holds member arrays, or member rows along ensemble_dim."""
    if op not in (">=", ">", "<=", "<"):
        raise ValueError("op is one of >=, >, <=, <")
    df, dims = _cases(fcst, obs, ensemble_dim, weights)
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    df = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in event_thresholds))))
    t, m = F.col("threshold"), F.size("members").cast("double")
    i = F.aggregate(F.transform("members", lambda x: compare(x, t, op)), F.lit(0.0), lambda a, b: a + b)
    score = F.pow(F.when(m > 0, i / m) - compare(F.col("obs"), t, op), 2)
    if fair_correction:
        score = score - F.when(m > 1, i * (m - i) / (m * m * (m - 1))).otherwise(0.0)
    return reduce(df, dims, [*keep, "threshold"], brier_score=wmean(score, F.col("weight") if weights is not None else None))


def _mean(x: Column) -> Column:
    n = F.size(x)
    return F.when(n > 0, F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / n)


def crps_for_ensemble(fcst: Field, obs: Field, ensemble_dim: str | None = None, *, method: str = "ecdf", chaining=None, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, include_components: bool = False, name: str = "crps") -> DataFrame:
    """Mean distance of members and observation, less the spread, which sorted members give in one pass.

    fcst holds member arrays, or member rows along ensemble_dim. chaining takes and gives a column.
    """
    if method not in ("ecdf", "fair"):
        raise ValueError("method is ecdf or fair")
    df, dims = _cases(fcst, obs, ensemble_dim, weights)
    keep = resolve_dims(dims, reduce_dims, preserve_dims)
    chain = chaining or (lambda c: c)
    df = df.withColumn("obs", chain(F.col("obs"))).withColumn("members", F.array_sort(F.transform("members", chain)))
    x, o, m = F.col("members"), F.col("obs"), F.size("members").cast("double")
    ranked = F.aggregate(F.transform(x, lambda v, i: v * (2 * i + 1 - m)), F.lit(0.0), lambda a, b: a + b)
    spread = F.when(m > 0, ranked / (m * m)) if method == "ecdf" else F.when(m > 1, ranked / (m * (m - 1)))
    zero = F.lit(0.0)
    under, over = _mean(F.transform(x, lambda v: F.greatest(o - v, zero))), _mean(F.transform(x, lambda v: F.greatest(v - o, zero)))
    known = o.isNotNull() & spread.isNotNull()
    parts = {name: F.when(known, under + over - spread)}
    if include_components:
        parts |= {"underforecast_penalty": F.when(known, under), "overforecast_penalty": F.when(known, over), "spread": F.when(known, spread)}
    w = F.col("weight") if weights is not None else None
    return reduce(df, dims, keep, **{k: wmean(v, w) for k, v in parts.items()})


def tw_crps_for_ensemble(fcst: Field, obs: Field, ensemble_dim: str | None, chaining_func, **options) -> DataFrame:
    return crps_for_ensemble(fcst, obs, ensemble_dim, chaining=chaining_func, **({"name": "tw_crps"} | options))


def tail_tw_crps_for_ensemble(fcst: Field, obs: Field, ensemble_dim: str | None, threshold: float, *, tail: str = "upper", **options) -> DataFrame:
    if tail not in ("upper", "lower"):
        raise ValueError("tail is upper or lower")
    f = gmax if tail == "upper" else gmin
    return tw_crps_for_ensemble(fcst, obs, ensemble_dim, lambda c: f(c, F.lit(float(threshold))), **({"name": "tail_tw_crps"} | options))


def interval_tw_crps_for_ensemble(fcst: Field, obs: Field, ensemble_dim: str | None, lower_threshold: float, upper_threshold: float, **options) -> DataFrame:
    if not lower_threshold < upper_threshold:
        raise ValueError("the lower threshold must be below the upper one")
    return tw_crps_for_ensemble(fcst, obs, ensemble_dim, lambda c: clip(c, F.lit(float(lower_threshold)), F.lit(float(upper_threshold))), **({"name": "interval_tw_crps"} | options))
