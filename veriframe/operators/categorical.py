"""Measures of categorical forecasts, contingency tables, risk matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions.exprs import div, gmin, ieee_div, ln
from veriframe.operators.discretise import compare
from veriframe.plans.checks import asserted, binary_rule, checked_weight
from veriframe.plans.frame import Dims, Field, align, pointwise, reduce, resolve_dims, wmean


def _rate(name: str, hit, base, fcst: Field, obs: Field, reduce_dims: Dims, preserve_dims: Dims, weights: Field | None, check_args: bool) -> DataFrame:
    df, dims = align(fcst=fcst, obs=obs, **({"weight": weights} if weights is not None else {}))
    f, o, w = F.col("fcst"), F.col("obs"), checked_weight(F.col("weight")) if weights is not None else F.lit(1.0)
    if check_args:
        f, o = (asserted(c, binary_rule(c), "events must be 0 or 1") for c in (f, o))
    known = f.isNotNull() & o.isNotNull()
    num, den = F.sum(F.when(known, hit(f, o).cast("double") * w)), F.sum(F.when(known, base(o).cast("double") * w))
    return reduce(df, dims, resolve_dims(dims, reduce_dims, preserve_dims), **{name: div(num, den)})


def probability_of_detection(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, check_args: bool = True) -> DataFrame:
    return _rate("probability_of_detection", lambda f, o: (f == 1) & (o == 1), lambda o: o == 1, fcst, obs, reduce_dims, preserve_dims, weights, check_args)


def probability_of_false_detection(fcst: Field, obs: Field, *, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, check_args: bool = True) -> DataFrame:
    return _rate("probability_of_false_detection", lambda f, o: (f == 1) & (o == 0), lambda o: o == 0, fcst, obs, reduce_dims, preserve_dims, weights, check_args)


def firm(fcst: Field, obs: Field, risk_parameter: float, categorical_thresholds: list, threshold_weights: list[float], *, discount_distance: float = 0, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None, threshold_assignment: str = "lower", include_components: bool = False) -> DataFrame:
    """Fixed risk multicategorical score. Thresholds are numbers or fields; weights go with them."""
    if not 0 < risk_parameter < 1 or len(categorical_thresholds) != len(threshold_weights) or not threshold_weights or min(threshold_weights) <= 0 or discount_distance < 0 or threshold_assignment not in ("lower", "upper"):
        raise ValueError("the risk parameter is between 0 and 1, weights are above 0 and as many as thresholds, the discount distance is not negative, and assignment is lower or upper")
    others = {f"t{i}": t for i, t in enumerate(categorical_thresholds) if isinstance(t, Field)}

    def score(f, o, *columns):
        given = dict(zip(others, columns, strict=True))
        over, under = F.lit(0.0), F.lit(0.0)
        for i, w in enumerate(threshold_weights):
            t = given.get(f"t{i}", F.lit(float(categorical_thresholds[i])) if f"t{i}" not in given else None)
            up, down = ((o <= t) & (t < f), (f <= t) & (t < o)) if threshold_assignment == "lower" else ((o < t) & (t <= f), (f < t) & (t <= o))
            scale_up = gmin(t - o, F.lit(float(discount_distance))) if discount_distance else F.lit(1.0)
            scale_down = gmin(o - t, F.lit(float(discount_distance))) if discount_distance else F.lit(1.0)
            known = f.isNotNull() & o.isNotNull() & t.isNotNull()
            over = over + F.when(known, F.when(up, (1 - risk_parameter) * scale_up * w).otherwise(0.0))
            under = under + F.when(known, F.when(down, risk_parameter * scale_down * w).otherwise(0.0))
        out = {"firm": over + under}
        return out | {"overforecast_penalty": over, "underforecast_penalty": under} if include_components else out

    return pointwise(score, "firm", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs, **others)


def seeps(fcst: Field, obs: Field, prob_dry: Field | float, light_heavy_threshold: Field | float, *, dry_light_threshold: float = 0.2, mask_clim_extremes: bool = True, lower_masked_value: float = 0.1, upper_masked_value: float = 0.85, reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    """Stable equitable error in probability space for dry, light and heavy rain."""
    others = {k: v for k, v in (("p1", prob_dry), ("heavy", light_heavy_threshold)) if isinstance(v, Field)}

    def score(f, o, *columns):
        given = dict(zip(others, columns, strict=True))
        p1 = given.get("p1", F.lit(float(prob_dry)) if "p1" not in given else None)
        heavy = given.get("heavy", F.lit(float(light_heavy_threshold)) if "heavy" not in given else None)
        p3 = (1 - p1) / 3

        def category(x):
            return F.when(x <= dry_light_threshold, 0).when(x <= heavy, 1).otherwise(2)

        cf, co = category(f), category(o)
        zero = F.lit(0.0)
        table = [[zero, div(F.lit(1.0), 1 - p1), div(F.lit(1.0), p3) + div(F.lit(1.0), 1 - p1)], [div(F.lit(1.0), p1), zero, div(F.lit(1.0), p3)], [div(F.lit(1.0), p1) + div(F.lit(1.0), 1 - p3), div(F.lit(1.0), 1 - p3), zero]]
        out = None
        for i in range(3):
            for j in range(3):
                here = (cf == i) & (co == j)
                out = F.when(here, table[i][j]) if out is None else out.when(here, table[i][j])
        known = f.isNotNull() & o.isNotNull() & heavy.isNotNull() & (p1 > 0) & (p1 < 1)
        if mask_clim_extremes:
            known = known & p1.between(lower_masked_value, upper_masked_value)
        return F.when(known, out / 2)

    return pointwise(score, "seeps", reduce_dims, preserve_dims, weights, fcst=fcst, obs=obs, **others)


def matrix_weights(spark: SparkSession, matrix, severity_dim: str, severities: list, prob_dim: str, probs: list[float]) -> Field:
    """A weight matrix as a field: its rows go with the probabilities in descending order."""
    m = np.asarray(matrix, float)
    if m.shape != (len(probs), len(severities)) or not all(0 < p < 1 for p in probs):
        raise ValueError("the matrix has a row for each probability in (0, 1) and a column for each severity")
    rows = [(float(p), s, float(m[i, j])) for i, p in enumerate(sorted(probs, reverse=True)) for j, s in enumerate(severities)]
    return Field(spark.createDataFrame(rows, [prob_dim, severity_dim, "weight"]), (prob_dim, severity_dim), "weight")


def scaling_to_weights(scaling, evaluation_weights: list[float]) -> np.ndarray:
    """Weights of a risk matrix's decision points: for each level, from the mildest severity on, the least probability at
    which a severity reaches the level gets the level's weight, if it is lower than for all milder severities."""
    s = np.asarray(scaling)
    if s.ndim != 2 or not np.issubdtype(s.dtype, np.integer) or s.min() < 0 or s[:, 0].any() or s[-1].any() or (np.diff(s, axis=1) < 0).any() or (np.diff(s, axis=0) > 0).any() or len(evaluation_weights) < s.max() or min(evaluation_weights) <= 0:
        raise ValueError("not a scaling matrix with weights for its levels")
    rows, cols = s.shape
    out, top = np.zeros((rows - 1, cols - 1)), max(int(s.max()), len(evaluation_weights))
    for level, weight in enumerate(evaluation_weights, 1):
        lowest = top + 1
        for c in range(1, cols):
            reached = np.flatnonzero(s[:-1, c] >= level)
            steps = rows - 1 - reached.max() if len(reached) else 0  # up from the bottom row
            if 0 < steps < lowest:
                out[rows - 1 - steps, c - 1] += weight
                lowest = steps
    return out


def weights_from_warning_scaling(spark: SparkSession, scaling, evaluation_weights: list[float], severity_dim: str, severities: list, prob_dim: str, probs: list[float]) -> Field:
    return matrix_weights(spark, scaling_to_weights(scaling, evaluation_weights), severity_dim, severities, prob_dim, probs)


def risk_matrix_score(fcst: Field, obs: Field, decision_weights: Field, severity_dim: str, prob_threshold_dim: str, *, threshold_assignment: str = "lower", reduce_dims: Dims = None, preserve_dims: Dims = None, weights: Field | None = None) -> DataFrame:
    """Of each case the weighted penalties over severities and probability thresholds, missing if any is; then the mean."""
    if threshold_assignment not in ("lower", "upper"):
        raise ValueError("threshold_assignment is lower or upper")
    df, dims = align(fcst=fcst, obs=obs, decision=decision_weights, **({"weight": weights} if weights is not None else {}))
    cases = [d for d in dims if d not in (severity_dim, prob_threshold_dim)]
    t, f, o = F.col(prob_threshold_dim), F.col("fcst"), F.col("obs")
    above = f >= t if threshold_assignment == "lower" else f > t
    penalty = F.when(f.isNotNull() & o.isNotNull(), F.when((o == 0) & above, t).when((o == 1) & ~above, 1 - t).otherwise(0.0)) * F.col("decision")
    total = F.when(F.count(penalty) == F.count("*"), F.sum(penalty)).alias("x")
    rows = df.groupBy(*cases).agg(total, *([F.first("weight").alias("weight")] if weights is not None else []))
    return reduce(rows, cases, resolve_dims(cases, reduce_dims, preserve_dims), risk_matrix_score=wmean(F.col("x"), F.col("weight") if weights is not None else None))


def _ets(c):
    by_chance = div((c.tp + c.fn) * (c.tp + c.fp), c.total)
    return ieee_div(c.tp - by_chance, c.tp + c.fn + c.fp - by_chance)


def _heidke(c):
    by_chance = div((c.tp + c.fn) * (c.tp + c.fp) + (c.tn + c.fn) * (c.tn + c.fp), c.total)
    return ieee_div(c.tp + c.tn - by_chance, c.total - by_chance)


def _odds(c):
    pod, pofd = ieee_div(c.tp, c.tp + c.fn), ieee_div(c.fp, c.fp + c.tn)
    return ieee_div(ieee_div(pod, 1 - pod), ieee_div(pofd, 1 - pofd))


def _sedi(c):
    h, f = ieee_div(c.tp, c.tp + c.fn), ieee_div(c.fp, c.fp + c.tn)
    return ieee_div(ln(f) - ln(h) + ln(1 - h) - ln(1 - f), ln(f) + ln(h) + ln(1 - h) + ln(1 - f))


@dataclass(frozen=True)
class Counts:
    tp: Column
    tn: Column
    fp: Column
    fn: Column
    total: Column


#: Each score from the counts; names in one entry mean the same.
MEASURES = {
    ("accuracy", "fraction_correct"): lambda c: ieee_div(c.tp + c.tn, c.total),
    ("base_rate",): lambda c: ieee_div(c.tp + c.fn, c.total),
    ("forecast_rate",): lambda c: ieee_div(c.tp + c.fp, c.total),
    ("frequency_bias", "bias_score"): lambda c: ieee_div(c.tp + c.fp, c.tp + c.fn),
    ("probability_of_detection", "hit_rate", "true_positive_rate", "sensitivity", "recall"): lambda c: ieee_div(c.tp, c.tp + c.fn),
    ("false_alarm_ratio",): lambda c: ieee_div(c.fp, c.tp + c.fp),
    ("false_alarm_rate", "probability_of_false_detection"): lambda c: ieee_div(c.fp, c.tn + c.fp),
    ("success_ratio", "precision", "positive_predictive_value"): lambda c: ieee_div(c.tp, c.tp + c.fp),
    ("threat_score", "critical_success_index"): lambda c: ieee_div(c.tp, c.tp + c.fp + c.fn),
    ("peirce_skill_score", "true_skill_statistic", "hanssen_and_kuipers_discriminant"): lambda c: ieee_div(c.tp, c.tp + c.fn) - ieee_div(c.fp, c.fp + c.tn),
    ("specificity", "true_negative_rate"): lambda c: ieee_div(c.tn, c.tn + c.fp),
    ("negative_predictive_value",): lambda c: ieee_div(c.tn, c.tn + c.fn),
    ("f1_score",): lambda c: ieee_div(2 * c.tp, 2 * c.tp + c.fp + c.fn),
    ("equitable_threat_score", "gilberts_skill_score"): _ets,
    ("heidke_skill_score", "cohens_kappa"): _heidke,
    ("odds_ratio",): _odds,
    ("odds_ratio_skill_score", "yules_q"): lambda c: ieee_div(c.tp * c.tn - c.fn * c.fp, c.tp * c.tn + c.fn * c.fp),
    ("symmetric_extremal_dependence_index",): _sedi,
}
_BY_NAME = {name: f for names, f in MEASURES.items() for name in names}


class Contingency:
    """Counts tp, tn, fp, fn and total for each combination of the kept dimensions; every score is a method of its name."""

    COUNTS = ("tp", "tn", "fp", "fn", "total")

    def __init__(self, counts: DataFrame, dims: list[str]):
        self.dims = list(dims)
        self.counts = counts.select(*self.dims, *(F.col(c).cast("double").alias(c) for c in self.COUNTS))

    def get_counts(self) -> DataFrame:
        return self.counts

    def get_table(self) -> DataFrame:
        """A row for each count, under the column contingency."""
        return self.counts.unpivot(self.dims, list(self.COUNTS), "contingency", "count")

    def format_table(self, positive: str = "Positive", negative: str = "Negative"):
        """A confusion matrix with totals as pandas, of a table without dimensions; else the plain table."""
        if self.dims:
            return self.get_table()
        import pandas as pd

        c = self.counts.first()
        rows = {positive: [c.tp, c.fp, c.tp + c.fp], negative: [c.fn, c.tn, c.fn + c.tn], "Total": [c.tp + c.fn, c.fp + c.tn, c.total]}
        return pd.DataFrame.from_dict(rows, orient="index", columns=[positive, negative, "Total"])

    def measures(self, *names: str) -> DataFrame:
        """Several measures side by side, from one aggregation."""
        c = Counts(*(F.col(n) for n in self.COUNTS))
        return self.counts.select(*self.dims, *(_BY_NAME[n](c).alias(n) for n in names))

    def __getattr__(self, name: str):
        if name not in _BY_NAME:
            raise AttributeError(name)
        return lambda: self.measures(name)

    def __dir__(self):
        return [*super().__dir__(), *_BY_NAME]

    def __repr__(self) -> str:
        return f"Contingency(dims={self.dims})"


class BinaryContingency(Contingency):
    """From event fields (1, 0 or missing); transform() counts anew over other dimensions."""

    def __init__(self, fcst_events: Field, obs_events: Field):
        self.events, self.event_dims = align(__f=fcst_events, __o=obs_events)
        super().__init__(self._count([]), [])

    def _count(self, keep: list[str]) -> DataFrame:
        f, o = F.col("__f"), F.col("__o")
        cells = {"tp": (1, 1), "tn": (0, 0), "fp": (1, 0), "fn": (0, 1)}
        known = F.sum(F.when(f.isNotNull() & o.isNotNull(), 1.0).otherwise(0.0)).alias("total")
        return self.events.groupBy(*keep).agg(*(F.sum(F.when((f == a) & (o == b), 1.0).otherwise(0.0)).alias(k) for k, (a, b) in cells.items()), known)

    def transform(self, *, reduce_dims: Dims = None, preserve_dims: Dims = None) -> Contingency:
        keep = resolve_dims(self.event_dims, reduce_dims, preserve_dims)
        return Contingency(self._count(keep), keep)


class EventOperator:
    """Makes event fields from forecasts and observations."""

    def make_event_tables(self, fcst: Field, obs: Field) -> tuple[Field, Field]:
        raise NotImplementedError

    def make_contingency(self, fcst: Field, obs: Field, **options) -> BinaryContingency:
        return BinaryContingency(*self.make_event_tables(fcst, obs, **options))


class ThresholdEvents(EventOperator):
    """An event is a value that compares with the threshold."""

    def __init__(self, threshold: float = 0.001, op: str = ">="):
        self.threshold, self.op = threshold, op

    def make_event_tables(self, fcst: Field, obs: Field, *, threshold: float | None = None, op: str | None = None) -> tuple[Field, Field]:
        t, op = F.lit(float(self.threshold if threshold is None else threshold)), op or self.op
        if fcst.df is obs.df:
            df = fcst.df.withColumns({"__fe": compare(fcst.column(), t, op), "__oe": compare(obs.column(), t, op)})
            return Field(df, fcst.dims, "__fe"), Field(df, obs.dims, "__oe")
        return fcst.map(lambda c: compare(c, t, op)), obs.map(lambda c: compare(c, t, op))
