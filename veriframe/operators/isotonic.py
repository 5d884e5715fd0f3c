"""Isotonic regression of observations on forecasts, and its bootstrap band, by ranges of forecasts.

A fit is a list of blocks: neighbouring forecasts that share a value, values increasing. Forecasts are dealt in ranges of about
RANGE_ROWS rows, and each range pools its own violators. What the driver then holds is a range's first and last value, which
tell whether two neighbours violate the order. Those that do are merged in pairs, all pairs at once, and only the touching
ends of the two lists pool; a range that is used up gives way to the one behind it. This goes on until no neighbours violate.
Where nothing pools nothing more is read, and no task ever has more than two ranges.

A block is what its functional needs: sums for the mean; for quantiles and own solvers a multiset, its distinct values with
their counts. The refits of a band are further lists beside the fit's own (list 0), made in the same pass: each distinct pair
draws its number of copies in all refits at once. Lastly each range puts the lists' values at its own forecasts.

A quantile interpolated between two observations can lie outside those of the parts of its block, so pooling in another order
may change it. Within a range the order is that of the sequence itself: runs of observations that don't increase are pooled
before their value is taken, ties by falling observation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.plans.frame import Field, align
from veriframe.plans.staging import staged

RANGE_ROWS = 250_000  # rows times lists of a range, about; one forecast is in one range whatever its pairs
RANGES = 2_000  # so that what the driver holds is bounded: two numbers for each range and list
COMPACT = 12  # rounds after which the lists are written anew
BLOCK = "list int, range int, lo double, hi double, fit double, a array<double>, b array<double>, c array<double>"
NAMES = [part.split()[0] for part in BLOCK.split(", ")]
POINT = -1  # the list of a range's forecasts themselves, with their counts


class Block:
    """Forecasts lo to hi with one fitted value. a, b, c: sum and weight of a mean, else values, weights and counts."""

    __slots__ = ("a", "b", "c", "fit", "hi", "lo")

    def __init__(self, lo, hi, a, b, c, fit=None):
        self.lo, self.hi, self.a, self.b, self.c, self.fit = lo, hi, a, b, c, fit


class Mean:
    """Blocks with sums: pooling adds them."""

    def pooled(self, parts: list[Block]) -> Block:
        a, b = sum(p.a for p in parts), sum(p.b for p in parts)
        return Block(parts[0].lo, parts[-1].hi, a, b, parts[0].c, a[0] / b[0])

    def blocks(self, x, y, w, count) -> list[Block]:
        """Of pairs in order of x, in `count` copies each."""
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        total, weight = np.add.reduceat(y * w * count, first), np.add.reduceat(w * count, first)
        known = weight > 0
        held: list[tuple[float, float, float, float]] = []
        for at, s, v in zip(x[first][known].tolist(), total[known].tolist(), weight[known].tolist(), strict=True):
            lo = at
            while held and held[-1][2] * v >= s * held[-1][3]:
                lo, _, s0, v0 = held.pop()
                s, v = s0 + s, v0 + v
            held.append((lo, at, s, v))
        none = np.zeros(0)
        return [Block(lo, hi, np.array([s]), np.array([v]), none, s / v) for lo, hi, s, v in held]


class Multiset:
    """Blocks with distinct (value, weight) and counts; the functional is of the values, each as often as it counts."""

    def __init__(self, functional: Callable):
        self.functional = functional

    def pooled(self, parts: list[Block]) -> Block:
        a, b, c = (np.concatenate([getattr(p, k) for p in parts]) for k in "abc")
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        a, b, c = a[first], b[first], np.add.reduceat(c, first)
        return Block(parts[0].lo, parts[-1].hi, a, b, c, float(self.functional(a, b, c)))

    def blocks(self, x, y, w, count) -> list[Block]:
        """Of pairs in order of x and, for equal ones, of falling y."""
        known = np.flatnonzero(count > 0)
        ones = [Block(x[i], x[i], y[i : i + 1], w[i : i + 1], count[i : i + 1].astype(float), float(y[i])) for i in known]
        held: list[Block] = []
        i = 0

        def run(last: float) -> list[Block]:
            """The blocks from i on for as long as they don't rise above the one before."""
            nonlocal i
            begin = i
            while i < len(ones) and last >= ones[i].fit:
                last = ones[i].fit
                i += 1
            return ones[begin:i]

        while i < len(ones):
            parts = run(np.inf)
            now = self.pooled(parts) if len(parts) > 1 or parts[0].c[0] > 1 else parts[0]
            while True:
                before = [held.pop()] if held and held[-1].fit >= now.fit else []
                after = run(now.fit)
                if not before and not after:
                    break
                now = self.pooled([*before, now, *after])
            held.append(now)
        return held


def quantile_of(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """The quantile, interpolated linearly, of sorted values with counts."""
    ends = np.cumsum(counts)
    place = (ends[-1] - 1) * q
    low = values[np.searchsorted(ends, np.floor(place), "right")]
    high = values[np.searchsorted(ends, min(np.floor(place) + 1, ends[-1] - 1), "right")]
    return low + (high - low) * (place - np.floor(place))


def functional_of(functional: str | None, quantile_level: float | None, solver: Callable | None, weighted: bool, counted: bool = False) -> Mean | Multiset:
    if solver is not None:
        if counted:
            return Multiset(solver)
        if weighted:
            return Multiset(lambda a, b, c: solver(np.repeat(a, c.astype(int)), np.repeat(b, c.astype(int))))
        return Multiset(lambda a, b, c: solver(np.repeat(a, c.astype(int)), np.ones(int(c.sum()))))
    if functional == "quantile":
        if quantile_level is None or not 0 < quantile_level < 1:
            raise ValueError("quantile_level must be between 0 and 1")
        if weighted:
            raise ValueError("weighted quantiles are not supported; give a solver")
        return Multiset(lambda a, b, c: quantile_of(a, c, quantile_level))
    if functional != "mean":
        raise ValueError("functional is mean or quantile, or a solver is given")
    return Mean()


def merged(kind: Mean | Multiset, left: list[Block], right: list[Block]) -> tuple[list[Block], list[Block]]:
    """Two neighbouring lists after their touching ends have pooled. The pooled block ends the left list, or begins the
    right one if nothing of the left is left."""
    if not left or not right or left[-1].fit < right[0].fit:
        return left, right
    now, i, j = kind.pooled([left[-1], right[0]]), len(left) - 1, 1
    while True:
        if i and left[i - 1].fit >= now.fit:
            i -= 1
            now = kind.pooled([left[i], now])
        elif j < len(right) and now.fit >= right[j].fit:
            now = kind.pooled([now, right[j]])
            j += 1
        else:
            break
    return ([*left[:i], now], right[j:]) if i else ([], [now, *right[j:]])


def draws(keys: np.ndarray, counts: np.ndarray, bootstraps: int) -> np.ndarray:
    """Copies of each pair in each refit: Poisson variables with the pair's count as mean, from the pair's key alone."""
    out = np.empty((len(keys), bootstraps), np.int64)
    for i, (k, n) in enumerate(zip(keys.astype(np.uint64).tolist(), counts.tolist(), strict=True)):
        out[i] = np.random.Generator(np.random.Philox(key=k)).poisson(n, bootstraps)
    return out


def _batch(rows: list[tuple[int, int, Block]]) -> pa.RecordBatch:
    lists, ranges, blocks = zip(*rows, strict=True)
    cols = [pa.array(lists, pa.int32()), pa.array(ranges, pa.int32())]
    cols += [pa.array([getattr(b, k) for b in blocks], pa.float64()) for k in ("lo", "hi", "fit")]
    cols += [pa.array([getattr(b, k) for b in blocks], pa.list_(pa.float64())) for k in "abc"]
    return pa.RecordBatch.from_arrays(cols, NAMES)


def _local(kind: Mean | Multiset, bootstraps: int):
    """Blocks of a range in all lists, and its forecasts."""

    def run(batches):
        table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"fcst": [], "obs": [], "w": [], "n": [], "key": []})])
        if not table.num_rows:
            return
        x, y, w, n, key = (table.column(c).to_numpy() for c in ("fcst", "obs", "w", "n", "key"))
        at = TaskContext.get().partitionId()
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        none = np.zeros(0)
        yield _batch([(POINT, at, Block(f, f, np.array([float(k)]), none, none, 0.0)) for f, k in zip(x[first], np.add.reduceat(n, first), strict=True)])
        # sums of a plain mean fit come as one pair a forecast, whose weight is in w already
        copies = [np.ones(len(x)) if isinstance(kind, Mean) and not bootstraps else n, *(draws(key, n, bootstraps).T if bootstraps else ())]
        for i, count in enumerate(copies):
            blocks = kind.blocks(x, y, w, count)
            for k in range(0, len(blocks), 10_000):
                yield _batch([(i, at, b) for b in blocks[k : k + 10_000]])

    return run


class _Lists:
    """Blocks of all lists, as tables of which each range's latest counts, and each range's first and last value."""

    def __init__(self, rows: DataFrame, kind: Mean | Multiset):
        self.kind, self.spark, self.tables = kind, rows.sparkSession, [rows]
        self.state: dict[int, dict[int, list]] = {}  # list -> range -> [table, first, last]
        self._note(rows, 0)

    def _note(self, rows: DataFrame, table: int) -> None:
        ends = rows.filter(f"list <> {POINT}").groupBy("list", "range").agg(F.min("fit").alias("first"), F.max("fit").alias("last"))
        for r in ends.collect():  # a row for each range and list
            self.state.setdefault(r["list"], {})[r["range"]] = [table, r["first"], r["last"]]

    def violations(self) -> list[tuple[int, int, int]]:
        """(list, left range, right range), no range twice."""
        out = []
        for which, ranges in self.state.items():
            order, i = sorted(ranges), 0
            while i + 1 < len(order):
                a, b = order[i], order[i + 1]
                if ranges[a][2] >= ranges[b][1]:
                    out.append((which, a, b))
                    i += 1
                i += 1
        return out

    def _chosen(self, wanted: list[tuple[int, int, int, int, int]]) -> DataFrame:
        """Blocks of (table, list, range), with the two ranges of the pair that asks for them."""
        picks = self.spark.createDataFrame(wanted, "table int, list int, range int, left int, right int")
        out = None
        for t in sorted({w[0] for w in wanted}):
            part = self.tables[t].join(picks.filter(F.col("table") == t).drop("table"), ["list", "range"])
            out = part if out is None else out.unionByName(part)
        return out

    def settle(self) -> None:
        kind = self.kind

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["range", "lo"])
            left, right = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
            sides = {left: [], right: []}
            for r, lo, hi, fit, a, b, c in zip(pdf["range"], pdf["lo"], pdf["hi"], pdf["fit"], pdf["a"], pdf["b"], pdf["c"], strict=True):
                sides[r].append(Block(lo, hi, np.asarray(a), np.asarray(b), np.asarray(c), fit))
            which = int(pdf["list"].iloc[0])
            both = merged(kind, sides[left], sides[right])
            return _batch([(which, at, b) for at, blocks in zip((left, right), both, strict=True) for b in blocks]).to_pandas()

        rounds = 0
        while pairs := self.violations():
            wanted = [(self.state[k][r][0], k, r, a, b) for k, a, b in pairs for r in (a, b)]
            done = staged(self._chosen(wanted).groupBy("list", "left", "right").applyInPandas(merge, BLOCK), "isotonic")
            for k, a, b in pairs:
                del self.state[k][a], self.state[k][b]
            self.tables.append(done)
            self._note(done, len(self.tables) - 1)
            rounds += 1
            if rounds % COMPACT == 0:
                self.tables = [staged(self.blocks(), "isotonic")]
                for ranges in self.state.values():
                    for held in ranges.values():
                        held[0] = 0

    def blocks(self) -> DataFrame:
        """list, range, lo, hi, fit and what follows, of all that counts."""
        wanted = [(t, k, r, 0, 0) for k, ranges in self.state.items() for r, (t, _, _) in ranges.items()]
        if len(self.tables) == 1:
            return self.tables[0].filter(f"list <> {POINT}")
        return self._chosen(wanted).drop("left", "right")


def _segments(bounds: np.ndarray):
    """A row for each range that a block, and the way to the next one, reaches into."""

    def run(batches):
        for b in batches:
            lo, reach = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("lo", "reach"))
            i, j = (np.maximum(np.searchsorted(bounds, z, "right") - 1, 0) for z in (lo, reach))
            take = np.repeat(np.arange(len(lo)), j - i + 1)
            to = np.arange(len(take)) - np.repeat(np.cumsum(j - i + 1) - (j - i + 1), j - i + 1) + np.repeat(i, j - i + 1)
            rows = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to.astype(np.int32))], [*rows.schema.names, "to"])

    return run


def quantile_rows(values: np.ndarray, q: float) -> np.ndarray:
    """The quantile, interpolated linearly, of each row's known values; NaN without any."""
    held = np.sort(values, 1)  # NaN last
    n = (~np.isnan(held)).sum(1)
    place = np.maximum(n - 1, 0) * q
    low = np.floor(place).astype(int)
    high = np.minimum(low + 1, np.maximum(n - 1, 0))
    at = np.arange(len(held))
    return held[at, low] + (held[at, high] - held[at, low]) * (place - low)


def isotonic_fit(fcst: Field, obs: Field, *, weight: Field | None = None, functional: str | None = "mean", quantile_level: float | None = None, solver: Callable | None = None, bootstraps: int | None = None, confidence_level: float = 0.9, min_non_nan: int = 1, report_bootstrap_results: bool = False, counted: bool = False, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """fcst (distinct values, as rows), regression and count; with bootstraps also lower and upper, the ends of the band.

    functional is mean or quantile, or None with a solver(values, weights) in its place, which gets each observation of a
    block. A counted solver(values, weights, counts) gets the distinct ones in order of values, and how often each occurs, so
    that its memory doesn't grow with the pairs. bootstraps refits are made of pairs
    drawn with replacement: each pair's number of copies is a Poisson variable (so a refit's size varies about the number of
    pairs) of its values and the seed. A refit is interpolated between its own forecasts, and has no value outside of them;
    a band needs min_non_nan values. report_bootstrap_results adds them all as the array bootstrap_results.
    """
    if bootstraps is not None and (int(bootstraps) != bootstraps or bootstraps < 1):
        raise ValueError("bootstraps must be a positive whole number")
    if not 0 < confidence_level < 1:
        raise ValueError("confidence_level must be between 0 and 1")
    kind, spark, b = functional_of(functional, quantile_level, solver, weight is not None, counted), fcst.df.sparkSession, bootstraps or 0
    df, _ = align(fcst=fcst, obs=obs, **({"weight": weight} if weight is not None else {}))
    w = F.col("weight") if weight is not None else F.lit(1.0)
    rows = df.filter("fcst is not null and obs is not null").select("fcst", "obs", w.alias("w")).filter("w is not null")
    if isinstance(kind, Mean) and not b:
        rows = rows.groupBy("fcst").agg(F.when(F.sum("w") != 0, F.sum(F.col("obs") * F.col("w")) / F.sum("w")).alias("obs"), F.sum("w").alias("w"), F.count("*").alias("n"))
    else:
        rows = rows.groupBy("fcst", "obs", "w").agg(F.count("*").alias("n"))
    rows = staged(rows.select("fcst", "obs", "w", "n", F.xxhash64("fcst", "obs", "w", F.lit(seed)).alias("key")), "pairs")
    ranges = min(RANGES, max(1, -(-rows.count() * (b + 1) // range_rows)))
    dealt = rows.repartitionByRange(ranges, "fcst") if ranges > 1 else rows.coalesce(1)
    local = staged(dealt.sortWithinPartitions("fcst", F.desc("obs")).mapInArrow(_local(kind, b), BLOCK), "isotonic")
    lists = _Lists(local, kind)
    lists.settle()
    points = local.filter(f"list = {POINT}").select("range", F.col("lo").alias("fcst"), F.col("a")[0].cast("long").alias("count"))
    bounds = sorted((r["first"], r["range"]) for r in points.groupBy("range").agg(F.min("fcst").alias("first")).collect())  # a row for each range
    numbers = [r for _, r in bounds]
    # the block after a range's last one begins the next range that has any
    after = [(k, a, z) for k, held in lists.state.items() for a, z in zip(sorted(held), sorted(held)[1:], strict=False)]
    follow = spark.createDataFrame(after, "list int, range int, next int")
    blocks = lists.blocks().select("list", "range", "lo", "hi", "fit")
    heads = blocks.groupBy("list", "range").agg(F.min_by(F.struct("lo", "fit"), "lo").alias("head"))
    heads = follow.join(heads.withColumnRenamed("range", "next"), ["list", "next"]).select("list", "range", "head")
    here = Window.partitionBy("list", "range").orderBy("lo")
    chain = blocks.join(heads, ["list", "range"], "left").withColumn("then", F.coalesce(F.lead(F.struct("lo", "fit")).over(here), "head"))
    chain = chain.select("list", "lo", "hi", "fit", F.coalesce("then.lo", "hi").alias("reach"), F.coalesce("then.fit", "fit").alias("then"))
    segments = chain.mapInArrow(_segments(np.array([f for f, _ in bounds])), "list int, lo double, hi double, fit double, reach double, then double, to int")
    places = {r: i for i, r in enumerate(numbers)}
    to = F.element_at(F.create_map(*(F.lit(z) for p in places.items() for z in p)), F.col("range")) if places else F.lit(0)
    low, high = (1 - confidence_level) / 2, (1 + confidence_level) / 2

    def put(forecasts: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        forecasts = forecasts.sort_values("fcst")
        x = forecasts["fcst"].to_numpy()
        fits = np.full((len(x), b + 1), np.nan)
        for k, g in segments.sort_values(["list", "lo"]).groupby("list"):
            ends, fit = g[["lo", "hi"]].to_numpy().ravel(), np.repeat(g["fit"].to_numpy(), 2)
            fits[:, k] = np.interp(x, np.append(ends, g["reach"].iloc[-1]), np.append(fit, g["then"].iloc[-1]), left=np.nan, right=np.nan)
        out = pd.DataFrame({"fcst": x, "regression": fits[:, 0], "count": forecasts["count"].to_numpy()})
        if b:
            few = (~np.isnan(fits[:, 1:])).sum(1) < max(min_non_nan, 1)
            for name, q in (("lower", low), ("upper", high)):
                out[name] = np.where(few, np.nan, quantile_rows(fits[:, 1:], q))
            if report_bootstrap_results:
                out["bootstrap_results"] = list(fits[:, 1:])
        return out

    names = ["regression", *(["lower", "upper"] if b else [])]
    schema = "fcst double, regression double, count long" + (", lower double, upper double" if b else "") + (", bootstrap_results array<double>" if b and report_bootstrap_results else "")
    got = points.withColumn("to", to).groupBy("to").cogroup(segments.groupBy("to")).applyInPandas(put, schema)
    got = got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
    if "bootstrap_results" in got.columns:
        got = got.withColumn("bootstrap_results", F.transform("bootstrap_results", lambda v: F.when(~F.isnan(v), v)))
    return got


def isotonic_band(fcst: Field, obs: Field, *, bootstraps: int, **options) -> DataFrame:
    """isotonic_fit with a band."""
    return isotonic_fit(fcst, obs, bootstraps=bootstraps, **options)
