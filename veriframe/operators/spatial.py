"""Fractions skill score over neighbourhoods of two-dimensional fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.plans.frame import Dims, Field, align, attach, resolve_dims


def _event(op: str, threshold: float):
    ops = {">": lambda c: c > threshold, ">=": lambda c: c >= threshold, "<": lambda c: c < threshold, "<=": lambda c: c <= threshold, "identity": lambda c: c != 0}
    if op not in ops:
        raise ValueError(f"the operator is one of {sorted(ops)}")
    return ops[op]


def _window_sums(df: DataFrame, line: list[str], along: str, size: int) -> DataFrame:
    """df's f and o summed over `size` neighbours along a dense line, at the first of them; places without so many go.

    A sum is the difference of two running sums, so the work is that of the cells whatever the window's size.
    """
    here = Window.partitionBy(*line).orderBy(along)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__{c}": F.sum(c).over(upto) for c in "fo"})
    df = df.withColumns({c: F.lead(f"__{c}", size - 1).over(here) - F.coalesce(F.lag(f"__{c}", 1).over(here), F.lit(0)) for c in "fo"})
    return df.filter("f is not null").drop("__f", "__o")


def fss_components(fcst: Field, obs: Field, *, event_threshold: float = 0.0, window_size: tuple[int, int], spatial_dims: tuple[str, str], zero_padding: bool = False, op: str = ">") -> tuple[DataFrame, list[str]]:
    """Of each field the mean squares of the window counts (fcst, obs) and of their difference.

    Spatial dims hold grid positions as integers. The grid is made whole (cells without a row, and missing values, are no
    events), and window counts come from running sums along its rows and then along its columns; a task holds one line. With
    zero padding the windows reach over all four edges, one row and column more than the grid has. Without any window the
    parts are NULL.
    """
    if min(window_size) < 1:
        raise ValueError("window sizes must be positive")
    y, x = spatial_dims
    df, dims = align(f=fcst, o=obs)
    other = [d for d in dims if d not in spatial_dims]
    hit = _event(op, event_threshold)
    cell = lambda c: F.coalesce(hit(F.col(c)).cast("long"), F.lit(0).cast("long"))
    df = df.select(*other, F.col(y).cast("long").alias("__y"), F.col(x).cast("long").alias("__x"), cell("f").alias("f"), cell("o").alias("o"))
    grid = df.groupBy(*other).agg(F.min("__y").alias("y0"), F.max("__y").alias("y1"), F.min("__x").alias("x0"), F.max("__x").alias("x1"))

    def span(d: str, size: int) -> Column:
        # padded windows start size // 2 before the grid, and the last one as many before the place after it
        before, after = (size // 2, size - size // 2) if zero_padding else (0, 0)
        return F.sequence(F.col(f"{d}0") - before, F.col(f"{d}1") + after)

    lines = grid.select(*other, F.explode(span("y", window_size[0])).alias("__y"), span("x", window_size[1]).alias("xs"))
    empty = lines.select(*other, "__y", F.explode("xs").alias("__x"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("o"))
    whole = empty.unionByName(df.filter("f + o > 0")).repartition(*other, "__y").groupBy(*other, "__y", "__x").agg(F.max("f").alias("f"), F.max("o").alias("o"))
    rows = _window_sums(whole, [*other, "__y"], "__x", window_size[1])
    windows = _window_sums(rows, [*other, "__x"], "__y", window_size[0])
    f, o = F.col("f").cast("double"), F.col("o").cast("double")
    parts = windows.groupBy(*other).agg(F.avg(f * f).alias("fcst_part"), F.avg(o * o).alias("obs_part"), F.avg((f - o) * (f - o)).alias("diff_part"))
    return attach(grid.select(*other), parts, other) if other else parts, other


def fss_2d(fcst: Field, obs: Field, *, event_threshold: float, window_size: tuple[int, int], spatial_dims: tuple[str, str], zero_padding: bool = False, reduce_dims: Dims = None, preserve_dims: Dims = None, threshold_operator: str = ">") -> DataFrame:
    """Averages the components over the reduced dimensions, then 1 - diff / (fcst + obs), within [0, 1]; 0 without events, NULL without windows."""
    parts, other = fss_components(fcst, obs, event_threshold=event_threshold, window_size=window_size, spatial_dims=spatial_dims, zero_padding=zero_padding, op=threshold_operator)
    keep = resolve_dims(other, reduce_dims, preserve_dims)
    means = parts.groupBy(*keep).agg(F.avg("fcst_part").alias("f"), F.avg("obs_part").alias("o"), F.avg("diff_part").alias("d"))
    total = F.col("f") + F.col("o")
    return means.select(*keep, F.when(total > 0, F.greatest(F.least(1 - F.col("d") / total, F.lit(1.0)), F.lit(0.0))).when(total == 0, 0.0).alias("fss"))


def fss_2d_binary(fcst: Field, obs: Field, **options) -> DataFrame:
    return fss_2d(fcst, obs, event_threshold=0.0, threshold_operator="identity", **options)


def fss_2d_single_field(fcst: Field, obs: Field, *, event_threshold: float, window_size: tuple[int, int], spatial_dims: tuple[str, str], zero_padding: bool = False, threshold_operator: str = ">") -> DataFrame:
    """The score of one pair of fields, which have no other dimensions."""
    if {*fcst.dims, *obs.dims} != set(spatial_dims):
        raise ValueError("the fields have the two spatial dimensions only")
    return fss_2d(fcst, obs, event_threshold=event_threshold, window_size=window_size, spatial_dims=spatial_dims, zero_padding=zero_padding, threshold_operator=threshold_operator)
