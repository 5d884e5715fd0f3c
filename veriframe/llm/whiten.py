"""Embedding whitening from an exact integer scatter matrix (operator 12).

Entries c become x = floor(64 c) + 1000000. A task subtracts the shift, so that numbers are small, and adds up the vectors and
their cross-products as whole numbers: by double-precision products where all partial sums are below 2^53, else with Python's
own integers. Sums leave a task as limbs of 32 bits, a row each, so Spark adds them exactly whatever their size, with partial
sums on the way. The driver forms n X'X - S S' from them in whole numbers, which doesn't depend on the shift, and only then
converts to floating point and decomposes by eigh. What reaches the driver is of the size of the matrix (its dimensions
squared, times limbs), never of the data.

A second pass measures the whitened vectors' covariance less the identity: tasks centre on their own means before they
multiply, and sums of the parts are put together by the means' differences. The last pass writes the rows.

Null vectors, and those with null or non-finite entries, are dropped; so are empty ones, which have no component. Vectors of
different lengths are whitened apart, each length with its own n. Components without variance (eigenvalue at most 1e-13 of
the largest, which is rounding) have no whitened value: it is NULL there, explained as measured, and identity_error is over
the others. A deviation beyond a long is NULL. Repeated and null vec_ids are rows of their own.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import byte_batches

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LIMB = 32
NULL_SHARE = 1e-13
CHUNK = 4096  # rows multiplied at once: 2^12 products below 2^40 each are below 2^53


def vectors(column: pa.Array):
    """(places, matrix) of the usable vectors of a list column, by length; the matrix holds doubles."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    known = ~flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(known & np.isfinite(x)))])
    end = np.cumsum(size)
    fine = (bad[end] == bad[end - size]) & (size > 0)
    for d in np.unique(size[fine]):
        at = np.flatnonzero(fine & (size == d))
        yield at, x[(end - size)[at][:, None] + np.arange(d)]


def integers(c: np.ndarray) -> np.ndarray:
    """floor(64 c), the entries without the shift: int64, or Python integers if some are large."""
    if not len(c) or np.abs(c).max() < 2**40:
        return np.floor(c * SCALE).astype(np.int64)
    return np.array([[floor(Fraction(v) * SCALE) for v in row] for row in c.tolist()], object)


def scatter(v: np.ndarray) -> np.ndarray:
    """v'v in Python integers."""
    if v.dtype == object or np.abs(v).max() >= 2**20:
        v = v.astype(object)
        return v.T.dot(v)
    total = np.zeros((v.shape[1],) * 2, object)
    for i in range(0, len(v), CHUNK):
        f = v[i : i + CHUNK].astype(np.float64)
        total += (f.T @ f).astype(np.int64).astype(object)
    return total


def limbs(values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, number of the limb, signed limb) of the values that aren't zero."""
    place, which, part = [], [], []
    for i, v in enumerate(values):
        sign, v, k = (-1, -v, 0) if v < 0 else (1, v, 0)
        while v:
            place.append(i)
            which.append(k)
            part.append(sign * (v & ((1 << LIMB) - 1)))
            v >>= LIMB
            k += 1
    return np.array(place, np.int64), np.array(which, np.int32), np.array(part, np.int64)


def _sums(batches):
    """Rows (dims, place, limb, part) of a task; place -1 counts, 0 to d - 1 are sums, then the matrix above its diagonal."""
    held: dict[int, list] = {}
    for b in batches:
        for _, c in vectors(b.column(0)):
            v = integers(c)
            d = v.shape[1]
            h = held.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            h[0] += len(v)
            h[1] += v.astype(object).sum(0)
            h[2] += scatter(v)
    for d, (n, s, m) in held.items():
        place, which, part = limbs([n, *s.tolist(), *m[np.triu_indices(d)].tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), d, np.int64)), pa.array(place - 1), pa.array(which), pa.array(part)], ["dims", "place", "limb", "part"])


class Fit:
    """Of the vectors of one length: n, sums and the components."""

    def __init__(self, d: int, values: list[int], components: int = COMPONENTS):
        n, self.s = values[0], values[1 : d + 1]
        exact = [[0] * d for _ in range(d)]
        for (i, j), m in zip(zip(*np.triu_indices(d), strict=True), values[d + 1 :], strict=True):
            exact[i][j] = exact[j][i] = n * m - self.s[i] * self.s[j]
        self.n, self.trace = n, sum(exact[i][i] for i in range(d)) / (n * n)
        e, u = np.linalg.eigh(np.array([[x / (n * n) for x in row] for row in exact]))
        k = min(components, d)
        self.e, self.u = e[::-1][:k], u[:, ::-1][:, :k]
        self.real = self.e > NULL_SHARE * max(self.e[0], 0.0)
        self.real &= self.e > 0
        self.explained = self.e / self.trace if self.trace else np.zeros(k)
        self.scaled = np.where(self.real, self.u / np.sqrt(np.where(self.real, self.e, 1.0)), 0.0)
        self.error = 0.0

    def off(self, v: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        most = int(np.abs(v).max()) if v.size else 0
        if v.dtype != object and self.n * most + max(map(abs, self.s), default=0) < 2**62:
            return self.n * v - np.array(self.s, np.int64)
        return self.n * v.astype(object) - np.array(self.s, object)

    def whitened(self, off: np.ndarray) -> np.ndarray:
        return (off / self.n).astype(np.float64) @ self.scaled

    @staticmethod
    def deviation(off: np.ndarray) -> list[int | None]:
        if off.dtype != object and (not off.size or int(np.abs(off).max()) ** 2 * off.shape[1] < 2**63):
            return (off * off).sum(1).tolist()
        got = (off.astype(object) ** 2).sum(1)
        return [int(x) if x < 2**63 else None for x in got]


def train(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each vector length among rows' embedding."""
    byte_batches(rows.sparkSession, 1 << 23, CHUNK)
    parts = rows.select("embedding").mapInArrow(_sums, "dims long, place long, limb int, part long")
    total: dict[int, dict[int, int]] = {}
    got = parts.groupBy("dims", "place", "limb").agg(F.sum("part").alias("part")).toPandas()
    for d, place, limb, part in zip(*(got[c].tolist() for c in ("dims", "place", "limb", "part")), strict=True):
        at = total.setdefault(d, {})
        at[place] = at.get(place, 0) + part * (1 << LIMB * limb)
    return {d: Fit(d, [at.get(p, 0) for p in range(-1, d + d * (d + 1) // 2)], components) for d, at in total.items()}


def _moments(fits):
    """Rows (dims, n, mean, scatter around it) of a task's whitened vectors."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for _, c in vectors(b.column(0)):
                fit = fits.value[c.shape[1]]
                z = fit.whitened(fit.off(integers(c)))
                n, mean = len(z), z.mean(0)
                around = (z - mean).T @ (z - mean)
                h = held.setdefault(c.shape[1], [0, np.zeros(len(mean)), np.zeros((len(mean),) * 2)])
                gap, both = mean - h[1], h[0] + n
                h[2] += around + np.outer(gap, gap) * (h[0] * n / both)
                h[1] += gap * (n / both)
                h[0] = both
        for d, (n, mean, around) in held.items():
            k = len(mean)
            i, j = (x.ravel() for x in np.indices((k, k)))
            cols = [np.full(k * k, d, np.int64), i, j, np.full(k * k, n, np.int64), mean[i], mean[j], around.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["dims", "i", "j", "n", "mi", "mj", "around"])

    return run


def measure(rows: DataFrame, fits: dict[int, Fit]) -> None:
    """Sets each fit's error: the largest absolute entry of the whitened vectors' covariance minus the identity."""
    held = rows.sparkSession.sparkContext.broadcast(fits)
    parts = rows.select("embedding").mapInArrow(_moments(held), "dims long, i long, j long, n long, mi double, mj double, around double")
    # parts meet by their means: around + n (mean - all's mean)^2, and the latter is near 0 as the vectors are centred
    n, means = F.sum("n").alias("n"), [F.sum(F.col("n") * F.col(c)).alias(c) for c in ("mi", "mj")]
    spread = F.sum(F.col("around") + F.col("n") * F.col("mi") * F.col("mj")).alias("spread")
    for r in parts.groupBy("dims", "i", "j").agg(n, *means, spread).collect():
        fit = fits[r["dims"]]
        if fit.real[r["i"]] and fit.real[r["j"]]:
            cov = (r["spread"] - r["mi"] * r["mj"] / r["n"]) / r["n"]
            fit.error = max(fit.error, abs(cov - (r["i"] == r["j"])))
    held.unpersist()


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each usable vector and component."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    fits = train(rows, components)
    measure(rows, fits)
    held = rows.sparkSession.sparkContext.broadcast(fits)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for b in batches:
            for at, c in vectors(b.column(1)):
                fit = held.value[c.shape[1]]
                off = fit.off(integers(c))
                z, k = fit.whitened(off), len(fit.e)
                none = np.tile(~fit.real, len(z))
                each = np.repeat(np.arange(len(z)), k)
                cols = [b.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(len(each), fit.n))]
                cols += [pa.array(fit.deviation(off), pa.int64()).take(pa.array(each)), pa.array(z.ravel(), mask=none)]
                cols += [pa.array(np.tile(fit.explained, len(z))), pa.array(np.full(len(each), fit.error))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
