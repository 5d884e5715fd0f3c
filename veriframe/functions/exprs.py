"""Column helpers with one meaning of missing: NaN becomes NULL on the way in, and NULL is skipped or kept on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nn(c: Column) -> Column:
    """A double, NaN as NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def div(n: Column, d: Column) -> Column:
    """n / d; NULL where d is 0."""
    return F.when(d != 0, n / d)


def ieee_div(n: Column, d: Column) -> Column:
    """n / d; signed infinity for a nonzero n over 0, NULL for 0 over 0."""
    return F.when(d != 0, n / d).when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF))


def gmax(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def gmin(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clip(c: Column, low: Column, high: Column) -> Column:
    return gmin(gmax(c, low), high)


def ln(c: Column) -> Column:
    """Natural logarithm, minus infinity at 0."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(-INF))


def angular_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two directions in degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d <= 180, d).otherwise(360 - d)


def latitude_weight(latitude: Column) -> Column:
    return F.cos(F.radians(latitude))


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are known; NULL for zero variance."""
    both = a.isNotNull() & b.isNotNull()
    return div(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))
