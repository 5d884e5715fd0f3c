"""Queries over the test tables, one for each score, and SQL for the same rows.

Views: v1 lineitem's discount and tax in percent as forecast and observation (a 17th of the forecasts missing); v2 lineitem
with part prices; v3 probabilities; v4 binary labels; v5 embeddings as 64-member ensembles; v6 hourly series of events;
v7 a day by hour grid; v8 empirical distributions of users' events.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions.exprs import latitude_weight
from veriframe.operators import bootstrap, categorical, cdf, continuous, discretise, isotonic, plotdata, probability, spatial, stats
from veriframe.plans.frame import Field, aggregate
from veriframe.sources import series
from veriframe.streaming import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ("l_returnflag", "l_linestatus")

V1_SQL = """v1 AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_orderkey % 17 <> 0 THEN round(l_discount * 100, 6) END AS f, round(l_tax * 100, 6) AS o, l_quantity AS w FROM lineitem)"""
V2_SQL = """v2 AS (SELECT l_returnflag, l_linestatus, p_retailprice * l_quantity AS f, l_extendedprice AS o FROM lineitem JOIN part ON l_partkey = p_partkey)"""
V3_SQL = """v3 AS (SELECT l_linestatus, round(l_discount * 10, 6) AS f, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS o FROM lineitem)"""
V5_SQL = """v5 AS (SELECT vec_id, label, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m, label / 10.0 AS o FROM embeddings)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v1(spark, sf_dir) -> tuple[Field, Field, Field]:
    df = _table(spark, sf_dir, "lineitem").select(*KEYS, F.when(F.col("l_orderkey") % 17 != 0, F.round(F.col("l_discount") * 100, 6)).alias("f"), F.round(F.col("l_tax") * 100, 6).alias("o"), F.col("l_quantity").alias("w"))
    dims = (*KEYS, "row")
    return Field(df, dims, "f"), Field(df, dims, "o"), Field(df, dims, "w")


def v2(spark, sf_dir) -> tuple[Field, Field]:
    df = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    df = df.select(*KEYS, (F.col("p_retailprice") * F.col("l_quantity")).alias("f"), F.col("l_extendedprice").alias("o"))
    return Field(df, (*KEYS, "row"), "f"), Field(df, (*KEYS, "row"), "o")


def v3(spark, sf_dir) -> tuple[Field, Field]:
    df = _table(spark, sf_dir, "lineitem").select("l_linestatus", F.round(F.col("l_discount") * 10, 6).alias("f"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("o"))
    return Field(df, ("l_linestatus", "row"), "f"), Field(df, ("l_linestatus", "row"), "o")


def v5(spark, sf_dir) -> tuple[Field, Field]:
    df = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("m"), (F.col("label") / 10.0).alias("o"))
    return Field(df, ("vec_id", "label"), "m"), Field(df, ("vec_id", "label"), "o")


def hourly(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events").filter("value is not null")
    return e.groupBy("event_type", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("value").alias("v"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _by_flags(name: str, expr: str, f, view: str = V1_SQL, source: str = "v1", value: str | None = None):
    """A score by return flag and line status."""

    def run(spark, sf_dir):
        return rounded(f(spark, sf_dir), value or name)

    QUERIES[name] = run
    SQL[name] = f"WITH {view} SELECT l_returnflag, l_linestatus, round({expr}, 6) AS {value or name} FROM {source} GROUP BY ALL"


def _on_v1(score, *args, weighted: bool = False, **options):
    def run(spark, sf_dir):
        f, o, w = v1(spark, sf_dir)
        return score(f, o, *args, preserve_dims=KEYS, **({"weights": w} if weighted else {}), **options)

    return run


def _wavg(x: str) -> str:
    return f"sum(({x}) * w) / sum(CASE WHEN ({x}) IS NOT NULL THEN w END)"


_ANGLE = "(CASE WHEN abs(f - o) * 40 % 360 <= 180 THEN abs(f - o) * 40 % 360 ELSE 360 - abs(f - o) * 40 % 360 END)"
_by_flags("mse", "avg((f - o) ** 2)", _on_v1(continuous.mse))
_by_flags("mse_weighted", _wavg("(f - o) ** 2"), _on_v1(continuous.mse, weighted=True), value="mse")
_by_flags("rmse", "sqrt(avg((f - o) ** 2))", _on_v1(continuous.rmse))
_by_flags("mae", "avg(abs(f - o))", _on_v1(continuous.mae))
_by_flags("mae_weighted", _wavg("abs(f - o)"), _on_v1(continuous.mae, weighted=True), value="mae")
_by_flags("additive_bias", "avg(f - o)", _on_v1(continuous.additive_bias))
_by_flags("mean_error", "avg(f - o)", _on_v1(continuous.mean_error))
_by_flags("multiplicative_bias", "avg(CASE WHEN f IS NOT NULL THEN f END) / avg(CASE WHEN f IS NOT NULL THEN o END)", _on_v1(continuous.multiplicative_bias))
_by_flags("pbias", "100 * avg(f - o) / avg(CASE WHEN f IS NOT NULL THEN o END)", _on_v1(continuous.pbias))
_by_flags("percent_within_x", "100.0 * count(*) FILTER (abs(f - o) <= 2) / count(f - o)", _on_v1(continuous.percent_within_x, 2))
_by_flags("percent_within_x_strict", "100.0 * count(*) FILTER (abs(f - o) < 2) / count(f - o)", _on_v1(continuous.percent_within_x, 2, is_inclusive=False), value="percent_within_x")
_by_flags("quantile_score", "avg(CASE WHEN f - o > 0 THEN 0.7 * (f - o) ELSE -0.3 * (f - o) END)", _on_v1(continuous.quantile_score, 0.3))
_by_flags("consistent_expectile_score", "avg(CASE WHEN o < f THEN 0.7 ELSE 0.3 END * (o ** 2 - f ** 2 - 2 * f * (o - f)))", _on_v1(continuous.consistent_expectile_score, 0.3, lambda x: x * x, lambda x: 2 * x), value="score")
_by_flags("consistent_huber_score", "avg(0.5 * (o ** 2 - (greatest(least(f - o, 2), -2) + o) ** 2 + greatest(least(f - o, 2), -2) * 2 * f))", _on_v1(continuous.consistent_huber_score, 2, lambda x: x * x, lambda x: 2 * x), value="score")
_by_flags("consistent_quantile_score", "avg(CASE WHEN o < f THEN 0.7 ELSE -0.3 END * (f ** 3 - o ** 3))", _on_v1(continuous.consistent_quantile_score, 0.3, lambda x: x * x * x), value="score")


def _g(x: str, a: float = 2, b: float = 6) -> str:
    return f"(CASE WHEN {x} < {a} THEN 0 WHEN {x} < {b} THEN {x} - {a} ELSE {b - a} END)"


def _phi(x: str, a: float = 2, b: float = 6) -> str:
    return f"(CASE WHEN {x} < {a} THEN 0 WHEN {x} < {b} THEN 2 * ({x} - {a}) ** 2 ELSE {4 * (b - a)} * {x} + {2 * (a * a - b * b)} END)"


_BREGMAN = f"({_phi('o')} - {_phi('f')} - 4 * {_g('f')} * (o - f))"
_by_flags("tw_squared_error", f"avg(0.5 * {_BREGMAN})", _on_v1(continuous.tw_squared_error, (2, 6)))
_by_flags("tw_absolute_error", f"avg(abs({_g('f')} - {_g('o')}) + 0 * f)", _on_v1(continuous.tw_absolute_error, (2, 6)))
_by_flags("tw_quantile_score", f"avg(CASE WHEN o < f THEN 0.8 ELSE -0.2 END * ({_g('f')} - {_g('o')}) + 0 * f)", _on_v1(continuous.tw_quantile_score, 0.2, (2, 6)))
_by_flags("tw_expectile_score", f"avg(0.5 * CASE WHEN o < f THEN 0.8 ELSE 0.2 END * {_BREGMAN})", _on_v1(continuous.tw_expectile_score, 0.2, (2, 6)))
_K = "greatest(least(f - o, 2), -2)"
_by_flags("tw_huber_loss", f"avg(0.25 * ({_phi('o')} - {_phi('(' + _K + ' + o)')} + {_K} * 4 * {_g('f')}) + 0 * f)", _on_v1(continuous.tw_huber_loss, 2, (2, 6)))


def _rise(x: str, a: float = 1, b: float = 3, c: float = 5, d: float = 8) -> str:
    """Integral of a weight that rises from a to b, is 1 up to c, and falls until d."""
    top = (b - a) / 2 + c - b
    return f"(CASE WHEN {x} < {a} THEN 0 WHEN {x} < {b} THEN ({x} - {a}) ** 2 / {2.0 * (b - a)} WHEN {x} < {c} THEN {(b - a) / 2} + {x} - {b} WHEN {x} < {d} THEN {top} + ({x} - {c}) - ({x} - {c}) ** 2 / {2.0 * (d - c)} ELSE {top + (d - c) / 2} END)"


def _twice(x: str, a: float = 1, b: float = 3, c: float = 5, d: float = 8) -> str:
    """Four times the integral of _rise."""
    at_b, slope_b = (b - a) ** 2 / 6, (b - a) / 2
    at_c, slope_c = at_b + slope_b * (c - b) + (c - b) ** 2 / 2, slope_b + c - b
    at_d, slope_d = at_c + slope_c * (d - c) + (d - c) ** 2 / 3, slope_c + (d - c) / 2
    return f"4 * (CASE WHEN {x} < {a} THEN 0 WHEN {x} < {b} THEN ({x} - {a}) ** 3 / {6.0 * (b - a)} WHEN {x} < {c} THEN {at_b} + {slope_b} * ({x} - {b}) + ({x} - {b}) ** 2 / 2 WHEN {x} < {d} THEN {at_c} + {slope_c} * ({x} - {c}) + ({x} - {c}) ** 2 / 2 - ({x} - {c}) ** 3 / {6.0 * (d - c)} ELSE {at_d} + {slope_d} * ({x} - {d}) END)"


_TRAP = {"interval_where_positive": (1, 8)}
_TRAP_BREGMAN = f"({_twice('o')} - {_twice('f')} - 4 * {_rise('f')} * (o - f))"
_by_flags("tw_squared_error_trapezoid", f"avg(0.5 * {_TRAP_BREGMAN})", _on_v1(continuous.tw_squared_error, (3, 5), **_TRAP), value="tw_squared_error")
_by_flags("tw_absolute_error_trapezoid", f"avg(abs({_rise('f')} - {_rise('o')}) + 0 * f)", _on_v1(continuous.tw_absolute_error, (3, 5), **_TRAP), value="tw_absolute_error")
_by_flags("tw_quantile_score_trapezoid", f"avg(CASE WHEN o < f THEN 0.8 ELSE -0.2 END * ({_rise('f')} - {_rise('o')}) + 0 * f)", _on_v1(continuous.tw_quantile_score, 0.2, (3, 5), **_TRAP), value="tw_quantile_score")
_by_flags("tw_expectile_score_trapezoid", f"avg(0.5 * CASE WHEN o < f THEN 0.8 ELSE 0.2 END * {_TRAP_BREGMAN})", _on_v1(continuous.tw_expectile_score, 0.2, (3, 5), **_TRAP), value="tw_expectile_score")
_by_flags("tw_huber_loss_trapezoid", f"avg(0.25 * ({_twice('o')} - {_twice('(' + _K + ' + o)')} + {_K} * 4 * {_rise('f')}) + 0 * f)", _on_v1(continuous.tw_huber_loss, 2, (3, 5), **_TRAP), value="tw_huber_loss")
_by_flags("tw_absolute_error_above", "avg(abs(greatest(f, 4) - greatest(o, 4)) + 0 * f)", _on_v1(continuous.tw_absolute_error, (4, float("inf"))), value="tw_absolute_error")
_by_flags("tw_squared_error_below", "avg((least(f, 4) - least(o, 4)) * (CASE WHEN f <= 4 AND o <= 4 THEN f - o WHEN f > 4 AND o > 4 THEN 0 WHEN o > 4 THEN f + 4 - 2 * o ELSE 4 - o END) + 0 * f)", _on_v1(continuous.tw_squared_error, (float("-inf"), 4)), value="tw_squared_error")
_by_flags("kge", "1 - sqrt((corr(f, o) - 1) ** 2 + (stddev_pop(f) / stddev_pop(o) - 1) ** 2 + (avg(f) / avg(o) - 1) ** 2)", lambda s, d: continuous.kge(*v2(s, d), preserve_dims=KEYS), V2_SQL, "v2")
_by_flags("pearsonr", "corr(f, o)", lambda s, d: continuous.pearsonr(*v2(s, d), preserve_dims=KEYS), V2_SQL, "v2")


@query("""WITH e AS (SELECT value AS f, user_id % 100 AS o, abs(value - user_id % 100) * 3.0 % 360 AS a FROM events) SELECT round(avg((f - o) ** 2), 6) AS mse, round(sqrt(avg((f - o) ** 2)), 6) AS rmse, round(avg(abs(f - o)), 6) AS mae,
round(avg(CASE WHEN a <= 180 THEN a ELSE 360 - a END), 6) AS mae_angular FROM e""")
def series_measures(spark, sf_dir):
    """Measures of two series whose rows meet by event_id."""
    e = _table(spark, sf_dir, "events")
    f, o = (series.series_of(Field(e.select("event_id", c.cast("double").alias("v")), ("event_id",), "v")) for c in (F.col("value"), F.col("user_id") % 100))
    got = (series.mse(f, o), series.rmse(f, o), series.mae(f, o), series.mae(f * 3, o * 3, is_angular=True))
    return rounded(spark.createDataFrame([got], "mse double, rmse double, mae double, mae_angular double"), "mse", "rmse", "mae", "mae_angular")


@query(f"WITH {V2_SQL}, m AS (SELECT *, avg(o) OVER (PARTITION BY l_returnflag, l_linestatus) AS mo FROM v2) SELECT l_returnflag, l_linestatus, round(1 - avg((f - o) ** 2) / avg((mo - o) ** 2), 6) AS nse FROM m GROUP BY ALL")
def nse(spark, sf_dir):
    return rounded(continuous.nse(*v2(spark, sf_dir), preserve_dims=KEYS), "nse")


@query(f"WITH {V2_SQL}, m AS (SELECT *, avg(o) OVER (PARTITION BY l_returnflag, l_linestatus) AS mo FROM v2) SELECT l_returnflag, l_linestatus, round(avg((f - o) ** 2), 2) AS fcst_error, round(avg((mo - o) ** 2), 2) AS obs_variance, round(1 - avg((f - o) ** 2) / avg((mo - o) ** 2), 6) AS nse, avg((mo - o) ** 2) = 0 AS no_variance FROM m GROUP BY ALL")
def nse_components(spark, sf_dir):
    got = continuous.nse(*v2(spark, sf_dir), preserve_dims=KEYS, include_components=True)
    return rounded(rounded(got, "nse"), "fcst_error", "obs_variance", places=2)


@query(f"""WITH {V1_SQL}, r AS (SELECT l_returnflag, l_linestatus, f, o,
 CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY f NULLS LAST) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, f) - 1) / 2.0 END AS rf,
 rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY o) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, o) - 1) / 2.0 AS ro FROM v1)
SELECT l_returnflag, l_linestatus, round(corr(rf, ro), 6) AS spearmanr FROM r GROUP BY ALL""")
def spearmanr(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    return rounded(continuous.spearmanr(f, o, preserve_dims=KEYS), "spearmanr")


@query(f"""WITH {V1_SQL} SELECT l_returnflag, l_linestatus, round(avg(2 + 0 * f), 6) AS interval_width_penalty, round(avg(greatest(f - 1 - o, 0) + 0 * f) / 0.1, 6) AS overprediction_penalty,
 round(avg(greatest(o - f - 1, 0) + 0 * f) / 0.1, 6) AS underprediction_penalty, round(avg(2 + (greatest(f - 1 - o, 0) + greatest(o - f - 1, 0)) / 0.1 + 0 * f), 6) AS total FROM v1 GROUP BY ALL""")
def interval_score(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    df = f.df.withColumns({"lo": F.col("f") - 1, "up": F.col("f") + 1})
    got = continuous.interval_score(Field(df, f.dims, "lo"), Field(df, f.dims, "up"), Field(df, f.dims, "o"), 0.8, preserve_dims=KEYS)
    return rounded(got, "interval_width_penalty", "overprediction_penalty", "underprediction_penalty", "total")


@query(f"WITH {V1_SQL} SELECT l_linestatus, round(avg(f), 6) AS f FROM v1 GROUP BY ALL")
def aggregate_mean(spark, sf_dir):
    f, _, _ = v1(spark, sf_dir)
    return rounded(aggregate(f, preserve_dims="l_linestatus"), "f")


_CELLS = "count(*) FILTER (f >= {t} AND o >= {t}) AS tp, count(*) FILTER (f < {t} AND o < {t}) AS tn, count(*) FILTER (f >= {t} AND o < {t}) AS fp, count(*) FILTER (f < {t} AND o >= {t}) AS fn"
_MEASURES = {
    "accuracy": "(tp + tn) / n", "base_rate": "(tp + fn) / n", "forecast_rate": "(tp + fp) / n", "frequency_bias": "(tp + fp) / (tp + fn)",
    "probability_of_detection": "tp / (tp + fn)", "false_alarm_ratio": "fp / (tp + fp)", "false_alarm_rate": "fp / (tn + fp)", "success_ratio": "tp / (tp + fp)",
    "threat_score": "tp / (tp + fp + fn)", "peirce_skill_score": "tp / (tp + fn) - fp / (fp + tn)", "specificity": "tn / (tn + fp)", "negative_predictive_value": "tn / (tn + fn)",
    "f1_score": "2 * tp / (2 * tp + fp + fn)", "equitable_threat_score": "(tp - (tp + fn) * (tp + fp) / n) / (tp + fn + fp - (tp + fn) * (tp + fp) / n)",
    "heidke_skill_score": "(tp + tn - ((tp + fn) * (tp + fp) + (tn + fn) * (tn + fp)) / n) / (n - ((tp + fn) * (tp + fp) + (tn + fn) * (tn + fp)) / n)",
    "odds_ratio": "(tp / fn) / (fp / tn)", "odds_ratio_skill_score": "(tp * tn - fn * fp) / (tp * tn + fn * fp)",
    "symmetric_extremal_dependence_index": "(ln(fp / (fp + tn)) - ln(tp / (tp + fn)) + ln(fn / (tp + fn)) - ln(tn / (fp + tn))) / (ln(fp / (fp + tn)) + ln(tp / (tp + fn)) + ln(fn / (tp + fn)) + ln(tn / (fp + tn)))",
}


@query(f"""WITH {V1_SQL}, c AS (SELECT l_returnflag, l_linestatus, {_CELLS.format(t=4)} FROM v1 GROUP BY ALL),
d AS (SELECT l_returnflag, l_linestatus, CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp + tn + fp + fn AS DOUBLE) AS n FROM c)
SELECT l_returnflag, l_linestatus, {', '.join(f'round({e}, 6) AS {k}' for k, e in _MEASURES.items())} FROM d""")
def contingency_measures(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    table = categorical.ThresholdEvents(4.0).make_contingency(f, o).transform(preserve_dims=KEYS)
    return rounded(table.measures(*_MEASURES), *_MEASURES)


@query(f"WITH {V1_SQL}, c AS (SELECT l_linestatus, {_CELLS.format(t=3)} FROM v1 GROUP BY ALL) UNPIVOT (SELECT l_linestatus, CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp + tn + fp + fn AS DOUBLE) AS total FROM c) ON tp, tn, fp, fn, total INTO NAME contingency VALUE \"count\"")
def contingency_table(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    return categorical.ThresholdEvents(3.0).make_contingency(f, o).transform(preserve_dims="l_linestatus").get_table()


def _labels(spark, sf_dir):
    df = _table(spark, sf_dir, "labels")
    return Field(df, ("doc_id",), "quality"), Field(df, ("doc_id",), "toxic")


@query("SELECT round(count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (toxic = 1), 6) AS probability_of_detection FROM labels")
def probability_of_detection(spark, sf_dir):
    return rounded(categorical.probability_of_detection(*_labels(spark, sf_dir)), "probability_of_detection")


@query("SELECT round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*) FILTER (toxic = 0), 6) AS probability_of_false_detection FROM labels")
def probability_of_false_detection(spark, sf_dir):
    return rounded(categorical.probability_of_false_detection(*_labels(spark, sf_dir)), "probability_of_false_detection")


def _firm_sql(t: float, w: float) -> str:
    return f"CASE WHEN o <= {t} AND {t} < f THEN 0.3 * least({t} - o, 3) * {w} WHEN f <= {t} AND {t} < o THEN 0.7 * least(o - {t}, 3) * {w} ELSE 0 END"


_by_flags("firm", f"avg({_firm_sql(2, 1)} + {_firm_sql(5, 2)} + 0 * f)", _on_v1(categorical.firm, 0.7, [2, 5], [1, 2], discount_distance=3))


@query(f"""WITH {V1_SQL}, c AS (SELECT *, CASE WHEN f <= 1 THEN 0 WHEN f <= 5 THEN 1 WHEN f IS NOT NULL THEN 2 END AS a, CASE WHEN o <= 1 THEN 0 WHEN o <= 5 THEN 1 ELSE 2 END AS b FROM v1)
SELECT l_returnflag, l_linestatus, round(avg(CASE WHEN a IS NULL THEN NULL WHEN a = b THEN 0 WHEN a = 0 AND b = 1 THEN 2 WHEN a = 0 THEN 8 WHEN a = 1 AND b = 0 THEN 2 WHEN a = 1 THEN 6 WHEN b = 0 THEN 2 + 1 / (1 - 0.5 / 3) ELSE 1 / (1 - 0.5 / 3) END / 2), 6) AS seeps FROM c GROUP BY ALL""")
def seeps(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    return rounded(categorical.seeps(f, o, 0.5, 5.0, dry_light_threshold=1.0, preserve_dims=KEYS), "seeps")


@query("""WITH x AS (SELECT doc_id, s.sev, CASE s.sev WHEN 1 THEN quality * 0.5 ELSE quality * 0.2 END AS f, CASE s.sev WHEN 1 THEN toxic ELSE toxic * quality END AS o FROM labels, (VALUES (1), (2)) AS s(sev)),
d(p, sev, w) AS (VALUES (0.4, 1, 1.0), (0.4, 2, 2.0), (0.1, 1, 3.0), (0.1, 2, 4.0)),
c AS (SELECT doc_id, sum(CASE WHEN o = 0 AND f >= p THEN p WHEN o = 1 AND f < p THEN 1 - p ELSE 0 END * w) AS v FROM x JOIN d USING (sev) GROUP BY doc_id)
SELECT round(avg(v), 6) AS risk_matrix_score FROM c""")
def risk_matrix_score(spark, sf_dir):
    df = _table(spark, sf_dir, "labels").withColumn("sev", F.explode(F.array(F.lit(1), F.lit(2))))
    first = F.col("sev") == 1
    df = df.select("doc_id", "sev", F.when(first, F.col("quality") * 0.5).otherwise(F.col("quality") * 0.2).alias("f"), F.when(first, F.col("toxic")).otherwise(F.col("toxic") * F.col("quality")).alias("o"))
    w = categorical.matrix_weights(spark, [[1, 2], [3, 4]], "sev", [1, 2], "p", [0.1, 0.4])
    w = Field(w.df.withColumn("sev", F.col("sev").cast("int")), w.dims, w.value)
    dims = ("doc_id", "sev")
    return rounded(categorical.risk_matrix_score(Field(df, dims, "f"), Field(df, dims, "o"), w, "sev", "p"), "risk_matrix_score")


@query("""WITH x AS (SELECT doc_id, s.sev, CASE s.sev WHEN 1 THEN quality * 0.5 ELSE quality * 0.2 END AS f, CASE s.sev WHEN 1 THEN toxic ELSE toxic * quality END AS o FROM labels, (VALUES (1), (2)) AS s(sev)),
scale(row, col, level) AS (VALUES (1, 0, 0), (1, 1, 1), (1, 2, 3), (2, 0, 0), (2, 1, 1), (2, 2, 2), (3, 0, 0), (3, 1, 0), (3, 2, 1), (4, 0, 0), (4, 1, 0), (4, 2, 0)), levels(level, w) AS (VALUES (1, 1.0), (2, 2.5), (3, 4.0)), probs(row, p) AS (VALUES (1, 0.6), (2, 0.4), (3, 0.1)),
low AS (SELECT l.level, w, col, max(row) AS row FROM scale AS s JOIN levels AS l ON s.level >= l.level WHERE row < 4 GROUP BY ALL), new AS (SELECT *, max(row) OVER (PARTITION BY level ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM low),
d AS (SELECT p, col AS sev, sum(w) AS w FROM new JOIN probs USING (row) WHERE seen IS NULL OR row > seen GROUP BY ALL), g AS (SELECT p, sev, coalesce(w, 0) AS w FROM probs CROSS JOIN (VALUES (1), (2)) AS v(sev) LEFT JOIN d USING (p, sev)),
c AS (SELECT doc_id, sum(CASE WHEN o = 0 AND f >= p THEN p WHEN o = 1 AND f < p THEN 1 - p ELSE 0 END * w) AS v FROM x JOIN g USING (sev) GROUP BY doc_id)
SELECT round(avg(v), 6) AS risk_matrix_score FROM c""")
def weights_from_warning_scaling(spark, sf_dir):
    """The risk matrix measure with weights that come from a matrix of warning levels."""
    df = _table(spark, sf_dir, "labels").withColumn("sev", F.explode(F.array(F.lit(1), F.lit(2))))
    first = F.col("sev") == 1
    df = df.select("doc_id", "sev", F.when(first, F.col("quality") * 0.5).otherwise(F.col("quality") * 0.2).alias("f"), F.when(first, F.col("toxic")).otherwise(F.col("toxic") * F.col("quality")).alias("o"))
    w = categorical.weights_from_warning_scaling(spark, [[0, 1, 3], [0, 1, 2], [0, 0, 1], [0, 0, 0]], [1.0, 2.5, 4.0], "sev", [1, 2], "p", [0.1, 0.4, 0.6])
    w = Field(w.df.withColumn("sev", F.col("sev").cast("int")), w.dims, w.value)
    dims = ("doc_id", "sev")
    return rounded(categorical.risk_matrix_score(Field(df, dims, "f"), Field(df, dims, "o"), w, "sev", "p"), "risk_matrix_score")


@query(f"WITH {V3_SQL} SELECT l_linestatus, round(avg((f - o) ** 2), 6) AS brier_score FROM v3 GROUP BY ALL")
def brier_score(spark, sf_dir):
    return rounded(probability.brier_score(*v3(spark, sf_dir), preserve_dims="l_linestatus"), "brier_score")


@query(f"""WITH {V5_SQL}, c AS (SELECT label, t, len(list_filter(m, lambda x: x >= t)) AS i, CAST(len(m) AS DOUBLE) AS n, CASE WHEN o >= t THEN 1 ELSE 0 END AS y FROM v5, (VALUES (0.05), (0.2)) AS s(t))
SELECT label, CAST(t AS DOUBLE) AS threshold, round(avg((i / n - y) ** 2 - i * (n - i) / (n * n * (n - 1))), 6) AS brier_score FROM c GROUP BY ALL""")
def brier_score_for_ensemble(spark, sf_dir):
    return rounded(probability.brier_score_for_ensemble(*v5(spark, sf_dir), None, [0.05, 0.2], preserve_dims="label"), "brier_score")


def _crps_sql(name: str, fair: bool, chain: str = "x", obs: str = "o") -> str:
    spread = "/ (n * (n - 1))" if fair else "/ (n * n)"
    return f"""WITH {V5_SQL}, c AS (SELECT label, list_transform(m, lambda x: {chain}) AS m, {obs} AS o, CAST(len(m) AS DOUBLE) AS n FROM v5)
SELECT label, round(avg(list_avg(list_transform(m, lambda x: abs(x - o))) - list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i] * (2 * i - 1 - n))) {spread}), 6) AS {name} FROM c GROUP BY ALL"""


@query(_crps_sql("crps", False))
def crps_for_ensemble(spark, sf_dir):
    return rounded(probability.crps_for_ensemble(*v5(spark, sf_dir), preserve_dims="label"), "crps")


@query(_crps_sql("crps", True))
def crps_for_ensemble_fair(spark, sf_dir):
    return rounded(probability.crps_for_ensemble(*v5(spark, sf_dir), method="fair", preserve_dims="label"), "crps")


@query(_crps_sql("tail_tw_crps", False, "greatest(x, 0.1)", "greatest(o, 0.1)"))
def tail_tw_crps_for_ensemble(spark, sf_dir):
    return rounded(probability.tail_tw_crps_for_ensemble(*v5(spark, sf_dir), None, 0.1, preserve_dims="label"), "tail_tw_crps")


@query(_crps_sql("interval_tw_crps", False, "least(greatest(x, 0.0), 0.3)", "least(greatest(o, 0.0), 0.3)"))
def interval_tw_crps_for_ensemble(spark, sf_dir):
    return rounded(probability.interval_tw_crps_for_ensemble(*v5(spark, sf_dir), None, 0.0, 0.3, preserve_dims="label"), "interval_tw_crps")


@query(_crps_sql("tw_crps", False, "x * 2", "o * 2"))
def tw_crps_for_ensemble(spark, sf_dir):
    return rounded(probability.tw_crps_for_ensemble(*v5(spark, sf_dir), None, lambda c: c * 2, preserve_dims="label"), "tw_crps")


@query(f"""WITH {V3_SQL}, t AS (SELECT DISTINCT f AS t FROM v3 UNION SELECT CAST('inf' AS DOUBLE) UNION SELECT 0.0),
p AS (SELECT l_linestatus, t, count(*) FILTER (f >= t AND o = 1) / count(*) FILTER (o = 1) AS pod, count(*) FILTER (f >= t AND o = 0) / count(*) FILTER (o = 0) AS pofd FROM v3, t GROUP BY ALL),
a AS (SELECT *, (pofd - lag(pofd) OVER w) * (pod + lag(pod) OVER w) / 2 AS a FROM p WINDOW w AS (PARTITION BY l_linestatus ORDER BY t DESC))
SELECT l_linestatus, t AS threshold, round(pod, 6) AS "POD", round(pofd, 6) AS "POFD", round(sum(a) OVER (PARTITION BY l_linestatus), 6) AS "AUC" FROM a""")
def roc(spark, sf_dir):
    return rounded(plotdata.roc(*v3(spark, sf_dir), preserve_dims="l_linestatus"), "POD", "POFD", "AUC")


@query(f"""WITH {V3_SQL}, t AS (SELECT DISTINCT f AS t FROM v3 UNION SELECT CAST('inf' AS DOUBLE) UNION SELECT 0.0),
p AS (SELECT t, count(*) FILTER (f >= t AND o = 1) / count(*) FILTER (o = 1) AS pod, count(*) FILTER (f >= t AND o = 0) / count(*) FILTER (o = 0) AS pofd FROM v3, t GROUP BY ALL),
a AS (SELECT *, (pofd - lag(pofd) OVER w) * (pod + lag(pod) OVER w) / 2 AS a FROM p WINDOW w AS (ORDER BY t DESC))
SELECT t AS threshold, round(pod, 6) AS "POD", round(pofd, 6) AS "POFD", round(sum(a) OVER (), 6) AS "AUC" FROM a""")
def roc_overall(spark, sf_dir):
    return rounded(plotdata.roc(*v3(spark, sf_dir)), "POD", "POFD", "AUC")


def _murphy_sql(size: str) -> str:
    return f"""WITH {V1_SQL}, t(theta) AS (VALUES (1.0), (3.0), (5.5)) SELECT l_linestatus, CAST(theta AS DOUBLE) AS theta,
round(avg(CASE WHEN f IS NULL THEN NULL WHEN f > theta AND o <= theta THEN 0.6 * {size} WHEN f <= theta AND theta < o THEN 0.4 * {size} ELSE 0 END), 6) AS total FROM v1, t GROUP BY ALL"""


def _murphy(functional, **options):
    def run(spark, sf_dir):
        f, o, _ = v1(spark, sf_dir)
        return rounded(plotdata.murphy_score(f, o, [1.0, 3.0, 5.5], functional=functional, alpha=0.4, preserve_dims="l_linestatus", **options), "total")

    return run


for _name, _size, _options in (("quantile", "1", {}), ("expectile", "abs(o - theta)", {}), ("huber", "least(abs(o - theta), 2)", {"huber_a": 2})):
    QUERIES[f"murphy_{_name}"], SQL[f"murphy_{_name}"] = _murphy(_name, **_options), _murphy_sql(_size)


@query(f"WITH {V1_SQL} SELECT DISTINCT unnest([f, f - 0.01, o, o - 2, o + 2]) AS theta FROM v1 WHERE f IS NOT NULL UNION SELECT DISTINCT unnest([o, o - 2, o + 2]) FROM v1")
def murphy_thetas(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    return plotdata.murphy_thetas([f], o, "huber", huber_a=2, left_limit_delta=0.01)


@query(f"WITH {V1_SQL} SELECT f AS theta FROM v1 WHERE f IS NOT NULL UNION SELECT o FROM v1")
def murphy_thetas_quantile(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    return plotdata.murphy_thetas([f], o, "quantile")


@query(f"WITH {V1_SQL} SELECT unnest([f, f - 0.25]) AS theta FROM v1 WHERE f IS NOT NULL UNION SELECT o FROM v1")
def murphy_thetas_expectile(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    return plotdata.murphy_thetas([f], o, "expectile", left_limit_delta=0.25)


@query(f"""WITH {V2_SQL}, q AS (SELECT l_linestatus, quantile_cont(f, [0.1, 0.5, 0.9]) AS fq, quantile_cont(o, [0.1, 0.5, 0.9]) AS oq FROM v2 GROUP BY ALL)
SELECT l_linestatus, s.n AS data_source, CAST([0.1, 0.5, 0.9][i] AS DOUBLE) AS quantile, round(CASE s.n WHEN 'fcst' THEN fq[i] ELSE oq[i] END, 4) AS value FROM q, range(1, 4) AS r(i), (VALUES ('fcst'), ('obs')) AS s(n)""")
def qq(spark, sf_dir):
    f, o = v2(spark, sf_dir)
    return rounded(plotdata.qq(f, o, quantiles=[0.1, 0.5, 0.9], preserve_dims="l_linestatus"), "value", places=4)


_AT = "(len(x) + 0.0)"
_SORTED = "x[greatest(least(CAST({i} AS BIGINT), len(x) - 1), 0) + 1]"
_BETWEEN = "greatest(least(q * ({n} + 1 - {a} - {b}) + {a} - 1, {n} - 1), 0)"


def _place_sql(a: float, b: float) -> str:
    place = _BETWEEN.format(n=_AT, a=a, b=b)
    low = f"floor({place} + 1e-12)"
    return f"{_SORTED.format(i=low)} + ({_SORTED.format(i=low + ' + 1')} - {_SORTED.format(i=low)}) * greatest({place} - {low}, 0)"


def _qq_sql(value: str) -> str:
    return f"""WITH {V2_SQL}, g AS (SELECT l_linestatus, 'fcst' AS data_source, list_sort(list(f)) AS x FROM v2 GROUP BY ALL UNION ALL SELECT l_linestatus, 'obs', list_sort(list(o)) FROM v2 GROUP BY ALL)
SELECT l_linestatus, data_source, CAST(q AS DOUBLE) AS quantile, round({value}, 4) AS value FROM g, (VALUES (0.1::DOUBLE), (0.33::DOUBLE), (0.9::DOUBLE)) AS s(q)"""


def _qq(method):
    def run(spark, sf_dir):
        f, o = v2(spark, sf_dir)
        return rounded(plotdata.qq(f, o, quantiles=[0.1, 0.33, 0.9], interpolation_method=method, preserve_dims="l_linestatus"), "value", places=4)

    return run


_Q1 = f"q * ({_AT} - 1)"
_QQ = {name: _place_sql(a, b) for name, (a, b) in plotdata.PLACES.items() if name != "linear"} | {
    "lower": _SORTED.format(i=f"floor({_Q1} + 1e-12)"), "higher": _SORTED.format(i=f"ceil({_Q1} - 1e-12)"), "nearest": _SORTED.format(i=f"round_even({_Q1}, 0)"),
    "midpoint": f"({_SORTED.format(i=f'floor({_Q1} + 1e-12)')} + {_SORTED.format(i=f'ceil({_Q1} - 1e-12)')}) / 2",
    "inverted_cdf": _SORTED.format(i=f"ceil(q * {_AT} - 1e-12) - 1"),
    "averaged_inverted_cdf": f"CASE WHEN abs(q * {_AT} - round(q * {_AT})) < 1e-12 THEN ({_SORTED.format(i=f'round(q * {_AT}) - 1')} + {_SORTED.format(i=f'round(q * {_AT})')}) / 2 ELSE {_SORTED.format(i=f'ceil(q * {_AT}) - 1')} END",
    "closest_observation": f"CASE WHEN abs(q * {_AT} - 0.5 - floor(q * {_AT} - 0.5 + 1e-12)) < 1e-12 AND CAST(floor(q * {_AT} - 0.5 + 1e-12) AS BIGINT) % 2 = 0 THEN {_SORTED.format(i=f'floor(q * {_AT} - 0.5 + 1e-12) - 1')} ELSE {_SORTED.format(i=f'floor(q * {_AT} - 0.5 + 1e-12)')} END",
}
for _name, _value in _QQ.items():
    QUERIES[f"qq_{_name}"], SQL[f"qq_{_name}"] = _qq(_name), _qq_sql(_value)


def _turned(measure):
    """A measure of directions: discount and tax in steps of 40 degrees."""

    def run(spark, sf_dir):
        f, o, _ = v1(spark, sf_dir)
        df = f.df.withColumns({"f": F.col("f") * 40, "o": F.col("o") * 40})
        return measure(Field(df, f.dims, "f"), Field(df, f.dims, "o"), preserve_dims=KEYS, is_angular=True)

    return run


_by_flags("mse_angular", f"avg({_ANGLE} ** 2)", _turned(continuous.mse), value="mse")
_by_flags("mae_angular", f"avg({_ANGLE})", _turned(continuous.mae), value="mae")
_by_flags("rmse_angular", f"sqrt(avg({_ANGLE} ** 2))", _turned(continuous.rmse), value="rmse")


@query(f"WITH {V1_SQL} SELECT l_returnflag, l_linestatus, round(sum(f * w), 4) AS f FROM v1 GROUP BY ALL")
def weighted_sum(spark, sf_dir):
    f, _, w = v1(spark, sf_dir)
    return rounded(aggregate(f, preserve_dims=KEYS, weights=w, method="sum"), "f", places=4)


@query(f"WITH {V1_SQL}, k AS (SELECT *, CASE WHEN f IS NULL THEN NULL WHEN o < 2 AND 2 <= f THEN 0.3 ELSE 0 END + CASE WHEN o < 5 AND 5 <= f THEN 0.6 ELSE 0 END AS over, CASE WHEN f IS NULL THEN NULL WHEN f < 2 AND 2 <= o THEN 0.7 ELSE 0 END + CASE WHEN f < 5 AND 5 <= o THEN 1.4 ELSE 0 END AS under FROM v1) SELECT l_returnflag, l_linestatus, round(avg(over + under), 6) AS firm, round(avg(over), 6) AS overforecast_penalty, round(avg(under), 6) AS underforecast_penalty FROM k GROUP BY ALL")
def firm_components(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    got = categorical.firm(f, o, 0.7, [2, 5], [1, 2], threshold_assignment="upper", include_components=True, preserve_dims=KEYS)
    return rounded(got, "firm", "overforecast_penalty", "underforecast_penalty")


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN CASE WHEN value > event_id % 100 + 1.0 THEN 1.0 ELSE 0.0 END END AS discretised FROM events")
def comparative_discretise(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("limit", (F.col("event_id") % 100).cast("double"))
    return discretise.comparative_discretise(Field(e, ("event_id",), "value"), Field(e, ("event_id",), "limit"), ">", abs_tolerance=1)


@query("SELECT event_id, round(cos(radians(event_id % 180 - 90)), 6) AS weight FROM events")
def latitude_weights(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.round(latitude_weight((F.col("event_id") % 180 - 90).cast("double")), 6).alias("weight"))


@query(f"WITH {V1_SQL} SELECT l_linestatus, CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN f IS NOT NULL THEN CASE WHEN f >= t THEN 1.0 ELSE 0.0 END END), 6) AS proportion FROM v1, (VALUES (1.0), (5.0)) AS s(t) GROUP BY ALL")
def proportion_exceeding(spark, sf_dir):
    return rounded(discretise.proportion_exceeding(v1(spark, sf_dir)[0], [1.0, 5.0], preserve_dims="l_linestatus"), "proportion")


@query("SELECT event_id, CAST(t AS DOUBLE) AS threshold, CASE WHEN value IS NOT NULL THEN CASE WHEN abs(value - t) <= 5 THEN 1.0 ELSE 0.0 END END AS discretised FROM events, (VALUES (10.0), (50.0)) AS s(t)")
def binary_discretise(spark, sf_dir):
    return discretise.binary_discretise(Field(_table(spark, sf_dir, "events"), ("event_id",), "value"), [10.0, 50.0], "==", abs_tolerance=5)


@query(f"WITH {V3_SQL}, g AS (SELECT f, avg(o) AS m, count(*) AS n, sum(o) AS s FROM v3 GROUP BY f), lo AS (SELECT a.f AS i, b.f AS j, sum(c.s) / sum(c.n) AS m FROM g AS a JOIN g AS b ON a.f <= b.f JOIN g AS c ON c.f BETWEEN a.f AND b.f GROUP BY ALL) SELECT g.f AS fcst, round((SELECT max(v) FROM (SELECT lo.i, min(lo.m) AS v FROM lo WHERE lo.i <= g.f AND lo.j >= g.f GROUP BY lo.i)), 6) AS regression, g.n AS count FROM g")
def isotonic_fit(spark, sf_dir):
    return rounded(isotonic.isotonic_fit(*v3(spark, sf_dir)), "regression")


@query(f"""WITH {V1_SQL}, r AS (SELECT f, o FROM v1 WHERE f IS NOT NULL AND o IS NOT NULL), g AS (SELECT f, count(*) AS n FROM r GROUP BY f),
lo AS (SELECT a.f AS i, b.f AS j, quantile_cont(o, 0.75) AS m FROM g AS a JOIN g AS b ON a.f <= b.f JOIN r ON r.f BETWEEN a.f AND b.f GROUP BY ALL)
SELECT g.f AS fcst, round((SELECT max(v) FROM (SELECT lo.i, min(lo.m) AS v FROM lo WHERE lo.i <= g.f AND lo.j >= g.f GROUP BY lo.i)), 6) AS regression, g.n AS count FROM g""")
def isotonic_quantile(spark, sf_dir):
    f, o, _ = v1(spark, sf_dir)
    return rounded(isotonic.isotonic_fit(f, o, functional="quantile", quantile_level=0.75), "regression")


@query(f"""WITH {V1_SQL}, r AS (SELECT f, o, w FROM v1 WHERE f IS NOT NULL AND o IS NOT NULL), g AS (SELECT f, count(*) AS n, sum(w) AS w, sum(o * w) AS s FROM r GROUP BY f),
lo AS (SELECT a.f AS i, b.f AS j, sum(c.s) / sum(c.w) AS m FROM g AS a JOIN g AS b ON a.f <= b.f JOIN g AS c ON c.f BETWEEN a.f AND b.f GROUP BY ALL)
SELECT g.f AS fcst, round((SELECT max(v) FROM (SELECT lo.i, min(lo.m) AS v FROM lo WHERE lo.i <= g.f AND lo.j >= g.f GROUP BY lo.i)), 6) AS regression, g.n AS count FROM g""")
def isotonic_weighted(spark, sf_dir):
    f, o, w = v1(spark, sf_dir)
    return rounded(isotonic.isotonic_fit(f, o, weight=w), "regression")


@query(f"""WITH {V1_SQL}, r AS (SELECT f, o, count(*) AS c FROM v1 WHERE f IS NOT NULL AND o IS NOT NULL GROUP BY ALL), g AS (SELECT f, sum(c) AS n FROM r GROUP BY f),
cum AS (SELECT a.f AS i, b.f AS j, o, sum(sum(c)) OVER (PARTITION BY a.f, b.f ORDER BY o) AS upto, sum(sum(c)) OVER (PARTITION BY a.f, b.f) AS total FROM g AS a JOIN g AS b ON a.f <= b.f JOIN r ON r.f BETWEEN a.f AND b.f GROUP BY a.f, b.f, o),
lo AS (SELECT i, j, min(o) FILTER (upto >= ceil(0.4 * total)) AS m FROM cum GROUP BY ALL)
SELECT g.f AS fcst, (SELECT max(v) FROM (SELECT lo.i, min(lo.m) AS v FROM lo WHERE lo.i <= g.f AND lo.j >= g.f GROUP BY lo.i)) AS regression, CAST(g.n AS BIGINT) AS count FROM g""")
def isotonic_solver(spark, sf_dir):
    """An own functional: the least value that 40 % of the observations don't exceed."""
    f, o, _ = v1(spark, sf_dir)

    def solver(values, _, counts):
        upto = np.cumsum(counts)
        return float(values[np.searchsorted(upto, np.ceil(0.4 * upto[-1]))])

    return isotonic.isotonic_fit(f, o, functional=None, solver=solver, counted=True)


@query()
def isotonic_band(spark, sf_dir):
    return isotonic.isotonic_band(*_labels(spark, sf_dir), bootstraps=20, seed=3)


_HOURLY = "h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_HOURLY}, s AS (SELECT event_type, v, lag(v) OVER (PARTITION BY event_type ORDER BY hour) AS p FROM h)
SELECT event_type, round((sum(abs(v - p)) - (max(v) - min(v))) / (count(*) - 2), 6) AS flip_flop_index FROM s GROUP BY ALL""")
def flip_flop_index(spark, sf_dir):
    return rounded(continuous.flip_flop_index(Field(hourly(spark, sf_dir), ("event_type", "hour"), "v"), "hour"), "flip_flop_index")


@query(f"""WITH {_HOURLY}, p AS (SELECT event_type, hour(hour) AS k, avg(v) AS v FROM h GROUP BY ALL), c(selection, i, k) AS (VALUES ('day', 1, 8), ('day', 2, 11), ('day', 3, 14), ('day', 4, 17), ('back', 1, 23), ('back', 2, 12), ('back', 3, 0)),
s AS (SELECT event_type, selection, v, lag(v) OVER (PARTITION BY event_type, selection ORDER BY i) AS p FROM p JOIN c USING (k))
SELECT event_type, selection, round((sum(abs(v - p)) - (max(v) - min(v))) / (count(*) - 2), 6) AS flip_flop_index FROM s GROUP BY ALL""")
def flip_flop_selections(spark, sf_dir):
    hours = hourly(spark, sf_dir).groupBy("event_type", F.hour("hour").alias("k")).agg(F.avg("v").alias("v"))
    picks = {"day": [8, 11, 14, 17], "back": [23, 12, 0]}
    return rounded(continuous.flip_flop_index(Field(hours, ("event_type", "k"), "v"), "k", selections=picks), "flip_flop_index")


@query(f"""WITH {_HOURLY}, s AS (SELECT event_type, v * 3.6 AS v, lag(v * 3.6) OVER (PARTITION BY event_type ORDER BY hour) AS p FROM h), d AS (SELECT event_type, count(*) AS n, sum(CASE WHEN abs(v - p) % 360 <= 180 THEN abs(v - p) % 360 ELSE 360 - abs(v - p) % 360 END) AS steps FROM s GROUP BY ALL),
a AS (SELECT DISTINCT event_type, v * 3.6 % 360 AS a FROM h), g AS (SELECT event_type, coalesce(lead(a) OVER w, first_value(a) OVER w + 360) - a AS gap FROM a WINDOW w AS (PARTITION BY event_type ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_type, round((any_value(steps) - least(360 - max(gap), 180)) / (any_value(n) - 2), 6) AS flip_flop_index FROM d JOIN g USING (event_type) GROUP BY event_type""")
def flip_flop_angular(spark, sf_dir):
    turned = hourly(spark, sf_dir).withColumn("v", F.col("v") * 3.6)
    return rounded(continuous.flip_flop_index(Field(turned, ("event_type", "hour"), "v"), "hour", is_angular=True), "flip_flop_index")


@query(f"""WITH {_HOURLY}, s AS (SELECT event_type, v, lag(v) OVER (PARTITION BY event_type ORDER BY hour) AS p FROM h), i AS (SELECT event_type, (sum(abs(v - p)) - (max(v) - min(v))) / (count(*) - 2) AS i FROM s GROUP BY ALL)
SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN i >= t THEN 1.0 ELSE 0.0 END), 6) AS proportion FROM i, (VALUES (5.0), (20.0), (40.0)) AS x(t) GROUP BY ALL""")
def flip_flop_index_proportion_exceeding(spark, sf_dir):
    return rounded(continuous.flip_flop_index_proportion_exceeding(Field(hourly(spark, sf_dir), ("event_type", "hour"), "v"), "hour", [5.0, 20.0, 40.0]), "proportion")


@query("""WITH a AS (SELECT DISTINCT user_id, value * 1.7 % 360 AS a FROM events WHERE value IS NOT NULL), g AS (SELECT user_id, coalesce(lead(a) OVER w, first_value(a) OVER w + 360) - a AS gap FROM a WINDOW w AS (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id, round(360 - max(gap), 6) AS sector_size FROM g GROUP BY ALL""")
def encompassing_sector_size(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") * 1.7).alias("angle"))
    return rounded(continuous.encompassing_sector_size(Field(df, ("user_id", "event_id"), "angle"), "event_id", skipna=True), "sector_size")


_GRID = """c AS (SELECT CAST(ts AS DATE) - DATE '1970-01-01' AS y, hour(ts) AS x, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS f, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS o FROM events GROUP BY ALL),
e AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM c),
g AS (SELECT y, x, CASE WHEN coalesce(f, 0) > 100 THEN 1 ELSE 0 END AS f, CASE WHEN coalesce(o, 0) > 100 THEN 1 ELSE 0 END AS o FROM (SELECT unnest(range(y0, y1 + 1)) AS y FROM e) AS a CROSS JOIN (SELECT unnest(range(x0, x1 + 1)) AS x FROM e) AS b LEFT JOIN c USING (y, x))"""
_FSS = "SELECT round(coalesce(greatest(1 - sum((f - o) ** 2) / nullif(sum(f ** 2) + sum(o ** 2), 0), 0), 0), 6) AS fss FROM s"
_INNER = f"WITH {_GRID}, s AS (SELECT a.y, a.x, sum(b.f) AS f, sum(b.o) AS o FROM g AS a JOIN g AS b ON b.y BETWEEN a.y AND a.y + 2 AND b.x BETWEEN a.x AND a.x + 3, e WHERE a.y <= y1 - 2 AND a.x <= x1 - 3 GROUP BY ALL) {_FSS}"


def _grid(spark, sf_dir) -> tuple[Field, Field]:
    """Days since 1970 by hours, as the table has them."""
    e = _table(spark, sf_dir, "events")
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0))
    df = e.groupBy(F.unix_date(F.to_date("ts")).alias("y"), F.hour("ts").alias("x")).agg(kind("click").alias("f"), kind("view").alias("o"))
    return Field(df, ("y", "x"), "f"), Field(df, ("y", "x"), "o")


@query(_INNER)
def fss_2d(spark, sf_dir):
    return rounded(spatial.fss_2d(*_grid(spark, sf_dir), event_threshold=100, window_size=(3, 4), spatial_dims=("y", "x")), "fss")


@query(f"""WITH {_GRID}, s AS (SELECT a.y, b.x, coalesce(sum(g.f), 0) AS f, coalesce(sum(g.o), 0) AS o FROM (SELECT unnest(range(y0 - 1, y1 + 1)) AS y FROM e) AS a CROSS JOIN (SELECT unnest(range(x0 - 2, x1)) AS x FROM e) AS b
LEFT JOIN g ON g.y BETWEEN a.y AND a.y + 2 AND g.x BETWEEN b.x AND b.x + 3 GROUP BY ALL) {_FSS}""")
def fss_2d_padded(spark, sf_dir):
    return rounded(spatial.fss_2d(*_grid(spark, sf_dir), event_threshold=100, window_size=(3, 4), spatial_dims=("y", "x"), zero_padding=True), "fss")


@query(_INNER)
def fss_2d_binary(spark, sf_dir):
    f, o = _grid(spark, sf_dir)
    both = f.df.withColumns({c: (F.col(c) > 100).cast("double") for c in ("f", "o")})
    return rounded(spatial.fss_2d_binary(Field(both, f.dims, "f"), Field(both, o.dims, "o"), window_size=(3, 4), spatial_dims=("y", "x")), "fss")


@query(_INNER)
def fss_2d_single_field(spark, sf_dir):
    return rounded(spatial.fss_2d_single_field(*_grid(spark, sf_dir), event_threshold=100, window_size=(3, 4), spatial_dims=("y", "x")), "fss")


@query("""WITH c AS (SELECT user_id % 10 AS k, CAST(ts AS DATE) - DATE '1970-01-01' AS y, hour(ts) AS x, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS f, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS o FROM events GROUP BY ALL),
e AS (SELECT k, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM c GROUP BY k), a AS (SELECT k, unnest(range(y0, y1 - 3)) AS y FROM e), b AS (SELECT k, unnest(range(x0, x1 - 5)) AS x FROM e),
s AS (SELECT k, a.y, b.x, count(*) FILTER (c.f > 20) AS f, count(*) FILTER (c.o > 20) AS o FROM a JOIN b USING (k) LEFT JOIN c USING (k) WHERE c.y BETWEEN a.y AND a.y + 4 AND c.x BETWEEN b.x AND b.x + 6 GROUP BY ALL),
p AS (SELECT k, sum(CAST(f AS DOUBLE) ** 2) AS f, sum(CAST(o AS DOUBLE) ** 2) AS o, sum(CAST(f - o AS DOUBLE) ** 2) AS d FROM s GROUP BY k), m AS (SELECT f / n AS f, o / n AS o, d / n AS d FROM p JOIN (SELECT k, (y1 - y0 - 3) * (x1 - x0 - 5) AS n FROM e) USING (k))
SELECT round(greatest(1 - avg(d) / (avg(f) + avg(o)), 0), 6) AS fss FROM m""")
def fss_2d_fields(spark, sf_dir):
    """The mean over ten fields, each a tenth of the users."""
    e = _table(spark, sf_dir, "events")
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0))
    df = e.groupBy((F.col("user_id") % 10).alias("k"), F.unix_date(F.to_date("ts")).alias("y"), F.hour("ts").alias("x")).agg(kind("click").alias("f"), kind("view").alias("o"))
    return rounded(spatial.fss_2d(Field(df, ("k", "y", "x"), "f"), Field(df, ("k", "y", "x"), "o"), event_threshold=20, window_size=(5, 7), spatial_dims=("y", "x")), "fss")


_DM = f"""WITH {_HOURLY}, d AS (SELECT event_type, hour, v - 50 AS d, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i FROM h),
m AS (SELECT event_type, avg(d) AS mean, count(*) AS n FROM d GROUP BY ALL), e AS (SELECT event_type, i, d.d - mean AS e, n, mean FROM d JOIN m USING (event_type)),
v AS (SELECT a.event_type, any_value(a.mean) AS mean, CAST(any_value(a.n) AS DOUBLE) AS n, sum(a.e * b.e * CASE WHEN a.i = b.i THEN 1 ELSE 2 END) AS s FROM e AS a JOIN e AS b ON a.event_type = b.event_type AND b.i BETWEEN a.i AND a.i + 2 GROUP BY ALL)
SELECT event_type, round(mean, 6) AS mean, CAST(n AS BIGINT) AS timeseries_len, round(mean / sqrt(s / (n * n)) * sqrt((n + 1 - 6 + 6 / n) / n), 6) AS dm_test_stat FROM v"""


def _differences(spark, sf_dir) -> Field:
    return Field(hourly(spark, sf_dir).select("event_type", "hour", (F.col("v") - 50).alias("d"), F.lit(3).alias("h")), ("event_type", "hour"), "d")


@query(_DM)
def diebold_mariano_hln(spark, sf_dir):
    got = stats.diebold_mariano(_differences(spark, sf_dir), "event_type", "hour", "h", method="HLN")
    return rounded(got.select("event_type", "mean", "timeseries_len", "dm_test_stat"), "mean", "dm_test_stat")


# The fit by least squares on grids of the logarithm of the range, each ten times finer about the best of the one before
_HG_LEVEL = """g{k} AS MATERIALIZED (SELECT event_type, {grid} AS r FROM {source} CROSS JOIN range(-40, 41) AS s(i)),
f{k} AS MATERIALIZED (SELECT event_type, r, sum(exp(-3 * lag / exp(r)) * acv) AS ea, sum(exp(-6 * lag / exp(r))) AS ee, sum(acv * acv) AS aa FROM g{k} JOIN a USING (event_type) GROUP BY ALL),
b{k} AS MATERIALIZED (SELECT event_type, arg_min(r, aa - CASE WHEN ea > 0 THEN ea * ea / ee ELSE 0 END) AS r, arg_min(greatest(ea / ee, 0), aa - CASE WHEN ea > 0 THEN ea * ea / ee ELSE 0 END) AS s FROM f{k} GROUP BY ALL)"""
_HG = f"""WITH {_HOURLY}, d AS (SELECT event_type, hour, v - 50 AS d, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i FROM h),
m AS MATERIALIZED (SELECT event_type, avg(d) AS mean, count(*) AS n FROM d GROUP BY ALL), e AS MATERIALIZED (SELECT event_type, i, d.d - mean AS e, n FROM d JOIN m USING (event_type)),
a AS MATERIALIZED (SELECT x.event_type, y.i - x.i AS lag, sum(x.e * y.e) / any_value(x.n) AS acv FROM e AS x JOIN e AS y ON x.event_type = y.event_type AND y.i >= x.i AND y.i - x.i < greatest((x.n - 1) // 2, 3) GROUP BY ALL),
{_HG_LEVEL.format(k=0, grid="4.0 + s.i * 0.25", source="m")}, {_HG_LEVEL.format(k=1, grid="b0.r + s.i * 0.025", source="b0")}, {_HG_LEVEL.format(k=2, grid="b1.r + s.i * 0.0025", source="b1")}, {_HG_LEVEL.format(k=3, grid="b2.r + s.i * 0.00025", source="b2")},
v AS (SELECT event_type, any_value(s) + 2 * sum(s * exp(-3 * lag / exp(r))) AS v FROM (SELECT event_type, s, r, unnest(range(1, n)) AS lag FROM b3 JOIN m USING (event_type)) GROUP BY ALL)
SELECT event_type, round(mean, 6) AS mean, n AS timeseries_len, round(mean / sqrt(v / n), 3) AS dm_test_stat FROM v JOIN m USING (event_type)"""


@query(_HG)
def diebold_mariano_hg(spark, sf_dir):
    got = stats.diebold_mariano(_differences(spark, sf_dir), "event_type", "hour", "h", method="HG")
    return rounded(rounded(got.select("event_type", "mean", "timeseries_len", "dm_test_stat"), "mean"), "dm_test_stat", places=3)


def _user_cdf(spark, sf_dir) -> tuple[Field, Field]:
    e = _table(spark, sf_dir, "events").filter("value is not null")
    ts = [float(t) for t in range(0, 210, 10)]
    shares = e.groupBy("user_id").agg(*(F.avg((F.col("value") <= t).cast("double")).alias(f"c{i}") for i, t in enumerate(ts)), F.min_by("value", "event_id").alias("obs"))
    points = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("cdf")) for i, t in enumerate(ts))))
    cdfs = shares.select("user_id", points.alias("p")).select("user_id", "p.*")
    return Field(cdfs, ("user_id", "threshold"), "cdf"), Field(shares.select("user_id", F.least("obs", F.lit(200.0)).alias("obs")), ("user_id",), "obs")


_USERS = """u AS (SELECT user_id, least(arg_min(value, event_id), 200.0) AS o FROM events WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT user_id, CAST(t AS DOUBLE) AS t, avg(CASE WHEN value <= t THEN 1.0 ELSE 0.0 END) AS c FROM events, range(0, 210, 10) AS r(t) WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT user_id, t, c, lead(t) OVER w AS t2, lead(c) OVER w AS c2 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t))"""


@query(f"""WITH {_USERS}, p AS (SELECT s.user_id, o, t AS a, c AS x, t2 AS b, c2 AS y FROM s JOIN u USING (user_id) WHERE t2 IS NOT NULL AND (o <= t OR o >= t2)
UNION ALL SELECT s.user_id, o, t, c, o, c + (c2 - c) * (o - t) / (t2 - t) FROM s JOIN u USING (user_id) WHERE o > t AND o < t2
UNION ALL SELECT s.user_id, o, o, c + (c2 - c) * (o - t) / (t2 - t), t2, c2 FROM s JOIN u USING (user_id) WHERE o > t AND o < t2),
k AS (SELECT user_id, sum(CASE WHEN b <= o THEN (b - a) * (x * x + x * y + y * y) / 3 ELSE 0 END) AS under, sum(CASE WHEN a >= o THEN (b - a) * ((1 - x) ** 2 + (1 - x) * (1 - y) + (1 - y) ** 2) / 3 ELSE 0 END) AS over FROM p GROUP BY ALL)
SELECT round(avg(under + over), 6) AS crps, round(avg(under), 6) AS underforecast_penalty, round(avg(over), 6) AS overforecast_penalty FROM k""")
def crps_cdf(spark, sf_dir):
    got = cdf.crps_cdf(*_user_cdf(spark, sf_dir), include_components=True)
    return rounded(got, "crps", "underforecast_penalty", "overforecast_penalty")


@query(f"""WITH {_USERS}, p AS (SELECT user_id, t, c FROM t UNION ALL SELECT user_id, o, c + (c2 - c) * (o - t) / (t2 - t) FROM s JOIN u USING (user_id) WHERE o > t AND o < t2),
h AS (SELECT user_id, t, (c - CASE WHEN t >= o THEN 1 ELSE 0 END) ** 2 AS h FROM p JOIN u USING (user_id)), k AS (SELECT user_id, (h + lag(h) OVER w) / 2 * (t - lag(t) OVER w) AS a FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t)),
m AS (SELECT user_id, sum(a) AS a FROM k GROUP BY ALL) SELECT round(avg(a), 6) AS crps FROM m""")
def crps_cdf_trapz(spark, sf_dir):
    return rounded(cdf.crps_cdf(*_user_cdf(spark, sf_dir), integration_method="trapz"), "crps")


@query(f"""WITH {_USERS}, a AS MATERIALIZED (SELECT DISTINCT t FROM t UNION SELECT o FROM u), w AS (SELECT u.user_id, o, a.t, s.t AS t1, s.c AS c1, s.t2, s.c2 FROM u CROSS JOIN a ASOF JOIN s ON u.user_id = s.user_id AND a.t >= s.t),
h AS (SELECT user_id, t, o, CASE WHEN t2 IS NULL OR t = t1 THEN c1 ELSE c1 + (c2 - c1) * (t - t1) / (t2 - t1) END AS f FROM w), g AS (SELECT user_id, t, CASE WHEN t < o THEN f * f ELSE 0 END AS under, CASE WHEN t >= o THEN (f - 1) ** 2 ELSE 0 END AS over FROM h),
k AS (SELECT user_id, (t - lag(t) OVER w) * (under + lag(under) OVER w) / 2 AS under, (t - lag(t) OVER w) * (over + lag(over) OVER w) / 2 AS over FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)), m AS (SELECT user_id, sum(under) AS under, sum(over) AS over FROM k GROUP BY ALL)
SELECT round(avg(under + over), 6) AS crps, round(avg(under), 6) AS underforecast_penalty, round(avg(over), 6) AS overforecast_penalty FROM m""")
def crps_cdf_trapz_union(spark, sf_dir):
    """Trapezoids over the thresholds and observations of all users."""
    got = cdf.crps_cdf(*_user_cdf(spark, sf_dir), integration_method="trapz", threshold_union="all", include_components=True)
    return rounded(got, "crps", "underforecast_penalty", "overforecast_penalty")


@query(f"WITH {_USERS} SELECT t AS threshold, round(avg((c - CASE WHEN t >= o THEN 1 ELSE 0 END) ** 2), 6) AS total_penalty, round(avg(CASE WHEN t < o THEN c ** 2 ELSE 0 END), 6) AS underforecast_penalty, round(avg(CASE WHEN t >= o THEN (c - 1) ** 2 ELSE 0 END), 6) AS overforecast_penalty FROM t JOIN u USING (user_id) GROUP BY ALL")
def crps_cdf_brier_decomposition(spark, sf_dir):
    got = cdf.crps_cdf_brier_decomposition(*_user_cdf(spark, sf_dir))
    return rounded(got, "total_penalty", "underforecast_penalty", "overforecast_penalty")


@query(f"WITH {_USERS} SELECT user_id, round(sum((t2 - t) * (c * c + c * c2 + c2 * c2) / 3), 6) AS integral FROM s GROUP BY ALL")
def integrate_square_piecewise_linear(spark, sf_dir):
    return rounded(cdf.integrate_square_piecewise_linear(_user_cdf(spark, sf_dir)[0], "threshold"), "integral")


_HOLED = """p AS (SELECT user_id, t, c, CASE WHEN t % 30 <> 10 AND t < 170 THEN c END AS v FROM t), q AS (SELECT user_id, t, c, v FROM p UNION ALL SELECT user_id, x, NULL, NULL FROM u, (VALUES (5.0), (45.0), (215.0)) AS a(x)),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'t': t, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo, first_value(CASE WHEN v IS NOT NULL THEN {'t': t, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM q)"""


def _holed(spark, sf_dir) -> Field:
    f, _ = _user_cdf(spark, sf_dir)
    return Field(f.df.withColumn("cdf", F.when((F.col("threshold") % 30 != 10) & (F.col("threshold") < 170), F.col("cdf"))), f.dims, "cdf")


@query(f"""WITH {_USERS}, p AS (SELECT user_id, t, CASE WHEN t % 30 <> 10 AND t < 170 THEN c END AS v FROM t), k AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS lo, first_value(v IGNORE NULLS) OVER x AS hi FROM p
WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, t AS threshold, round(coalesce(lo, hi), 6) AS cdf FROM k""")
def fill_cdf(spark, sf_dir):
    return rounded(cdf.fill_cdf(_holed(spark, sf_dir), "threshold", "forward", 1), "cdf")


@query(f"""WITH {_USERS}, {_HOLED}, n AS (SELECT user_id, arg_max(CASE WHEN v IS NOT NULL THEN {{'t': t, 'v': v}} END, t, 2) FILTER (v IS NOT NULL) AS ends FROM q GROUP BY ALL)
SELECT user_id, t AS threshold, round(greatest(least(CASE WHEN v IS NOT NULL THEN v WHEN hi IS NULL THEN ends[2].v + (ends[1].v - ends[2].v) * (t - ends[2].t) / (ends[1].t - ends[2].t) ELSE lo.v + (hi.v - lo.v) * (t - lo.t) / (hi.t - lo.t) END, 1), 0), 6) AS cdf FROM k JOIN n USING (user_id)""")
def add_thresholds(spark, sf_dir):
    return rounded(cdf.add_thresholds(_holed(spark, sf_dir), "threshold", [5, 45, 215], "linear"), "cdf")


_BENT = "b AS (SELECT user_id, t, CASE WHEN t % 40 = 20 THEN c - 0.1 ELSE c END AS c FROM t)"


def _bent(spark, sf_dir) -> tuple[Field, Field]:
    f, o = _user_cdf(spark, sf_dir)
    bent = F.when(F.col("threshold") % 40 == 20, F.col("cdf") - 0.1).otherwise(F.col("cdf"))
    return Field(f.df.withColumn("cdf", bent), f.dims, "cdf"), o


@query(f"""WITH {_USERS}, {_BENT} SELECT user_id, t AS threshold, round(c, 6) AS cdf, 'original' AS cdf_type FROM b UNION ALL SELECT user_id, t, round(max(c) OVER (PARTITION BY user_id ORDER BY t), 6), 'upper' FROM b
UNION ALL SELECT user_id, t, round(min(c) OVER (PARTITION BY user_id ORDER BY t DESC), 6), 'lower' FROM b""")
def cdf_envelope(spark, sf_dir):
    return rounded(cdf.cdf_envelope(_bent(spark, sf_dir)[0], "threshold"), "cdf")


@query(f"WITH {_USERS}, {_BENT}, d AS (SELECT user_id, c - lag(c) OVER (PARTITION BY user_id ORDER BY t) AS d FROM b) SELECT user_id, coalesce(sum(CASE WHEN d < 0 THEN d END), 0) < -0.15 AS decreasing FROM d GROUP BY ALL")
def decreasing_cdfs(spark, sf_dir):
    return cdf.decreasing_cdfs(_bent(spark, sf_dir)[0], "threshold", 0.15)


_USERS_ONCE = _USERS.replace("u AS (", "u AS MATERIALIZED (", 1).replace("t AS (", "t AS MATERIALIZED (", 1)


@query(f"""WITH {_USERS_ONCE}, {_BENT}, e AS MATERIALIZED (SELECT user_id, 0 AS kind, t, c FROM b UNION ALL SELECT user_id, 1, t, max(c) OVER (PARTITION BY user_id ORDER BY t) FROM b UNION ALL SELECT user_id, 2, t, min(c) OVER (PARTITION BY user_id ORDER BY t DESC) FROM b),
z AS MATERIALIZED (SELECT user_id, kind, t, c, lead(t) OVER w AS t2, lead(c) OVER w AS c2 FROM e WINDOW w AS (PARTITION BY user_id, kind ORDER BY t)),
p AS MATERIALIZED (SELECT user_id, kind, o, t AS a, c AS x, t2 AS b, c2 AS y FROM z JOIN u USING (user_id) WHERE t2 IS NOT NULL AND (o <= t OR o >= t2)
UNION ALL SELECT user_id, kind, o, t, c, o, c + (c2 - c) * (o - t) / (t2 - t) FROM z JOIN u USING (user_id) WHERE o > t AND o < t2
UNION ALL SELECT user_id, kind, o, o, c + (c2 - c) * (o - t) / (t2 - t), t2, c2 FROM z JOIN u USING (user_id) WHERE o > t AND o < t2),
k AS MATERIALIZED (SELECT user_id, kind, sum(CASE WHEN b <= o THEN (b - a) * (x * x + x * y + y * y) / 3 ELSE (b - a) * ((1 - x) ** 2 + (1 - x) * (1 - y) + (1 - y) ** 2) / 3 END) AS v FROM p GROUP BY ALL),
best AS (SELECT user_id, kind FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, kind) = 1)
SELECT user_id, t AS threshold, round(c, 6) AS cdf FROM e JOIN best USING (user_id, kind)""")
def adjust_fcst_for_crps(spark, sf_dir):
    f, o = _bent(spark, sf_dir)
    return rounded(cdf.adjust_fcst_for_crps(f, "threshold", o), "cdf")


@query(f"WITH {_USERS} SELECT user_id, CAST(t AS DOUBLE) AS threshold, CASE WHEN t >= o THEN 0.0 ELSE 1.0 END AS weight FROM u, range(0, 200, 50) AS r(t)")
def crps_step_threshold_weight(spark, sf_dir):
    return cdf.crps_step_threshold_weight(_user_cdf(spark, sf_dir)[1], [0, 50, 100, 150], steppoints_in_thresholds=False, weight_upper=False)


@query(f"WITH {_USERS} SELECT user_id, CAST(t AS DOUBLE) AS threshold, CASE WHEN t >= o THEN 1.0 ELSE 0.0 END AS cdf FROM u, range(0, 200, 50) AS r(t)")
def observed_cdf(spark, sf_dir):
    return cdf.observed_cdf(_user_cdf(spark, sf_dir)[1], [0, 50, 100, 150], include_obs_in_thresholds=False)


@query(f"""WITH {_HOURLY}, d AS (SELECT event_type, CAST(hour AS DATE) AS day, avg(v) AS v FROM h GROUP BY ALL) SELECT i AS iteration, event_type, day, round(v, 3) AS v FROM d, range(1, 4) AS r(i)""")
def block_bootstrap_whole(spark, sf_dir):
    """Blocks as long as the dimension: each copy is the field itself."""
    e = hourly(spark, sf_dir).withColumn("day", F.to_date("hour")).groupBy("event_type", "day").agg(F.avg("v").alias("v"))
    n = e.select("day").distinct().count()
    return rounded(bootstrap.block_bootstrap([Field(e, ("event_type", "day"), "v")], {"day": n}, 3, seed=1)[0], "v", places=3)


@query("""WITH d AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS n FROM events WHERE value IS NOT NULL), k AS (SELECT count(DISTINCT event_type) AS k FROM events WHERE value IS NOT NULL)
SELECT i AS iteration, n * k AS n_rows, n AS n_days, n - (n + 4) // 5 AS contiguous, 0 AS mixed_days, 0 AS mixed_types FROM d, k, range(1, 9) AS r(i)""")
def block_bootstrap_invariants(spark, sf_dir):
    """Days in blocks of five and, within them, event types in blocks of two. A value tells the day and type that it comes
    from: days of a block follow each other, a day comes whole, and types are drawn once for a block of days."""
    e = _table(spark, sf_dir, "events").filter("value is not null").select(F.to_date("ts").alias("day"), "event_type").distinct()
    days, types = (Window.orderBy(c) for c in ("day", "event_type"))  # labels of two dims, not rows
    days = e.select("day").distinct().withColumn("d", F.row_number().over(days) - 1)
    types = e.select("event_type").distinct().withColumn("k", F.row_number().over(types) - 1)
    full = F.broadcast(types).crossJoin(days).withColumn("v", (F.col("d") * 100 + F.col("k")).cast("double"))
    n = days.count()
    got = bootstrap.block_bootstrap([Field(full.select("day", "event_type", "v"), ("day", "event_type"), "v")], {"day": 5, "event_type": 2}, 8, seed=11)[0]
    at = got.join(F.broadcast(days), "day").join(F.broadcast(types), "event_type").select("iteration", "d", "k", F.floor(F.col("v") / 100).alias("fd"), F.pmod("v", F.lit(100.0)).alias("fk"))
    by_day = at.groupBy("iteration", "d").agg(F.count("*").alias("rows"), F.min("fd").alias("fd"), (F.count_distinct("fd") - 1).alias("mixed"))
    step = F.pmod(F.col("fd") - F.lag("fd").over(Window.partitionBy("iteration").orderBy("d")), F.lit(n)) == 1
    by_day = by_day.withColumn("step", (step & (F.col("d") % 5 > 0)).cast("int"))
    out = by_day.groupBy("iteration").agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_days"), F.sum("step").alias("contiguous"), F.sum("mixed").alias("mixed_days"))
    kinds = at.groupBy("iteration", F.floor(F.col("d") / 5), "k").agg((F.count_distinct("fk") - 1).alias("mixed")).groupBy("iteration").agg(F.sum("mixed").alias("mixed_types"))
    return out.join(kinds, "iteration").select("iteration", *(F.col(c).cast("long").alias(c) for c in ("n_rows", "n_days", "contiguous", "mixed_days", "mixed_types")))


@query()
def block_bootstrap(spark, sf_dir):
    e = hourly(spark, sf_dir).withColumn("day", F.to_date("hour")).groupBy("event_type", "day").agg(F.avg("v").alias("v"))
    return bootstrap.block_bootstrap([Field(e, ("event_type", "day"), "v")], {"day": 5}, 10, seed=1)[0].groupBy("iteration", "event_type").agg(F.round(F.avg("v"), 6).alias("v"))


@query("""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, round(avg((value - 50) ** 2), 6) AS mse, round(avg(abs(value - 50)), 6) AS mae, round(avg(value - 50), 6) AS additive_bias, count(value) AS n FROM events GROUP BY ALL""")
def running_measures(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("base", F.lit(50.0))
    got = running.running_measures(e, "ts", fcst="value", obs="base", keep=["event_type"])
    got = got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    return rounded(got, "mse", "mae", "additive_bias")
