"""Embedding whitening by TSQR.

Entries become whole numbers, x = floor(64 c) + 1,000,000.  The fit list holds each distinct
vector once.  Its exact sums centre the rows; each task reduces its centred rows to the triangular
factor R of a QR decomposition, batch by batch, and factors are merged FAN at a time up a tree.
The singular values s and right singular vectors v of the last R give the components: variance
s^2 / n along v, so rows are whitened by a projection on v over s / sqrt(n).  No covariance of the
vectors is formed; only that of the whitened components, in order to measure its error.

What reaches the driver is bounded by the vectors' width d: d sums, one d x d factor, and a
16 x 16 table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Factors that one task merges.
FAN = 16
#: Rows that are decomposed at a time.
PIECE = 4096
#: Entries beyond this are taken as this (so far |c| is some 2^56).
LARGEST = 1 << 62


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is neither null nor holds null or
    non-finite entries, and has the width that most such rows have (of equal ones the larger)."""
    c = F.col("embedding").cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & (F.size(c) > 0)
    whole = embeddings.select("vec_id", c.alias("embedding")).filter(F.col("embedding").isNotNull() & usable)
    # a handful of widths
    width = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = whole.filter(F.size("embedding") == (width.d if width else -1))
    bound = float(LARGEST)
    number = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-bound)), F.lit(bound))) + SHIFT)
    return whole.select("vec_id", number.alias("x"))


def _matrix(column) -> np.ndarray:
    """A column of lists of one width as rows of longs."""
    if not len(column):
        return np.empty((0, 0), np.int64)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _summed(batches):
    """(k, high, low): sums of the upper and the lower 32 bits of each dimension; dimension -1
    counts rows."""
    total, n = None, 0
    for batch in batches:
        x = _matrix(batch.column("x"))
        if len(x):
            n += len(x)
            part = np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
            total = part if total is None else total + part
    if n:
        d = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d), pa.int32()), pa.array(np.append(0, total[0])), pa.array(np.append(n, total[1]))], ["k", "high", "low"])


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""
    wide = "decimal(38,0)"
    rows = fit.select("x").mapInArrow(_summed, "k int, high long, low long").groupBy("k").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    got = {r.k: (int(r.high) << 32) + int(r.low) for r in rows.collect()}
    n = got.pop(-1, 0)
    return n, [got[k] for k in sorted(got)]


def scaled_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: longs if they fit, else Python's integers."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _reduced(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _factor_batch(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["part", "r"])


def _factors(n: int, sums: list[int]):
    """R of the centred rows of this task."""

    def run(batches):
        r = None
        for batch in batches:
            x = _matrix(batch.column("x"))
            for lo in range(0, len(x), PIECE):
                r = _reduced(r, (scaled_deviations(x[lo : lo + PIECE], n, sums) / n).astype(float))
        if r is not None:
            yield _factor_batch(TaskContext.get().partitionId(), r)

    return run


def _merge(d: int):
    def run(key, table):
        """R of up to FAN factors."""
        r = None
        for one in table.sort_by("part").column("r").to_pylist():
            r = _reduced(r, np.array(one).reshape(-1, d))
        return pa.Table.from_batches([_factor_batch(key[0].as_py(), r)])

    return run


def last_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows of ``fit``; d x d at most."""
    d = len(sums)
    factors = save(fit.select("x").mapInArrow(_factors(n, sums), "part int, r array<double>"))
    while factors.agg(F.max("part")).first()[0] > 0:
        group = F.floor(F.col("part") / FAN).cast("int").alias("group")
        merged = save(factors.groupBy(group).applyInArrow(_merge(d), "part int, r array<double>"))
        drop_saved(factors)
        factors = merged
    r = np.array(factors.first().r).reshape(-1, d)
    drop_saved(factors)
    return r


class Whitening:
    """A fitted whitening: n, sums, axes (d x k, scaled), explained share of each component."""

    def __init__(self, fit: DataFrame, most: int = COMPONENTS):
        self.n, self.sums = exact_sums(fit)
        self.axes, self.explained, self.error = np.empty((len(self.sums), 0)), [], 0.0
        if not self.n:
            return
        _, s, v = np.linalg.svd(last_factor(fit, self.n, self.sums))
        rank = int((s > s[0] * max(self.n, len(s)) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
        k = min(most, rank)
        self.axes = v[:k].T * (math.sqrt(self.n) / s[:k])
        self.explained = (s[:k] ** 2 / (s**2).sum()).tolist()
        self.error = self._identity_error(fit)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S, and the whitened components."""
        y = scaled_deviations(x, self.n, self.sums)
        return y, (y / self.n).astype(float) @ self.axes

    def _identity_error(self, fit: DataFrame) -> float:
        """The largest absolute entry of the whitened fit list's covariance minus the identity."""
        k, project = self.axes.shape[1], self.project
        if not k:
            return 0.0

        def moments(batches):
            total = np.zeros((k + 1, k))
            for batch in batches:
                x = _matrix(batch.column("x"))
                for lo in range(0, len(x), PIECE):
                    z = project(x[lo : lo + PIECE])[1]
                    total += np.vstack([z.T @ z, z.sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["k", "v"])

        rows = fit.select("x").mapInArrow(moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        total = np.array([r.v for r in sorted(rows)]).reshape(k + 1, k) / self.n
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())

    def transform(self, rows: DataFrame) -> DataFrame:
        """A row for each vector of ``rows`` (vec_id, x) and component."""
        n, explained, error, project = self.n, self.explained, self.error, self.project
        k = len(explained)

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("x"))
                if not k or not len(x):
                    continue
                for lo in range(0, len(x), PIECE):
                    y, z = project(x[lo : lo + PIECE])
                    if y.dtype == object or float((y.astype(float) ** 2).sum(1).max()) > 9e18:
                        far = [sum(v * v for v in row) for row in y.astype(object).tolist()]
                        far = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
                    else:
                        far = pa.array((y * y).sum(1))
                    m = len(z)
                    each = np.repeat(np.arange(m), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("vec_id")[lo : lo + m].take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                            far.take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                        ],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``embeddings`` (vec_id, embedding) and component: vec_id,
    component (from 1, by falling variance), n (vectors of the fit list), deviation (the sum over
    dimensions of (n x - S)^2, null where it doesn't fit a long), whitened, explained (the
    component's share of the variance) and identity_error.

    Vectors that are null or empty, hold null or non-finite entries, or have another width than
    most, take no part.  Repeated vectors count once in the fit and get rows each; null ids stay.
    Components without variance (fewer different vectors than dimensions) aren't returned, so a
    table of one vector, or an empty one, gives no rows.  Other columns are ignored.
    """
    rows = save(whole_vectors(embeddings))
    fit = save(rows.select("x").distinct())
    fitted = Whitening(fit, components)
    drop_saved(fit)
    return fitted.transform(rows)
