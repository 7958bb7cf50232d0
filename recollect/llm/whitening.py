"""Whitening of vectors by their leading principal components, found by contour integration (FEAST).

Entries become whole numbers, so counts and sums are exact. One pass sums the distinct vectors, a second the products of their
centred entries; only these dim x dim sums reach the driver. Inertia counts (signs of the pivots of a symmetric factorisation of
the shifted covariance) bracket the wanted eigenvalues and cut the spectrum into intervals at gaps. Each interval is a task:
a quadrature over a circle through its ends, with a complex shifted solve at each node, projects a random block onto the
interval's eigenvectors, Rayleigh-Ritz extracts them, and this is repeated until the residuals are at rounding level.
An interval that gives another number of eigenvalues than its inertia count stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _vectors as V
from recollect.llm._common import save

#: Whole numbers are floor(SCALE * entry) + SHIFT; entries beyond LARGEST in size after scaling count as LARGEST.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 62
#: Nodes on the half circle, eigenvalues of an interval (where gaps allow), relative size below which an eigenvalue counts as zero.
NODES, PER_INTERVAL, ZERO = 8, 8, 1e-12


@dataclass
class Whitening:
    """n and sums of the fit list; its leading eigenvalues (falling) and unit eigenvectors (columns); the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part is taken off in whole numbers."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole)])
        return _apart(x, whole).astype(float) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sums)^2, exactly; None beyond a long."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        part, rest = _apart(x, near), [s - self.n * w for s, w in zip(self.sums, near)]
        most = self.n * (max(abs(int(part.max())), abs(int(part.min()))) + 1)
        if most * most * x.shape[1] < 1 << 63:
            d = self.n * part - np.array(rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * part.astype(object) - np.array(rest, object)
        return [t if t < 1 << 63 else None for t in (d * d).sum(axis=1).tolist()]


def _apart(x: np.ndarray, whole: list[int]) -> np.ndarray:
    """x less whole numbers, in Python's numbers where longs could overflow."""
    if x.size and max(abs(int(x.max())), abs(int(x.min())), *map(abs, whole)) >= 1 << 61:
        return x.astype(object) - np.array(whole, object)
    return x - np.array(whole, np.int64)


def negatives(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are below zero: the negative pivots of a factorisation with pivot blocks of one or two rows."""
    a, n, k, count = a.copy(), len(a), 0, 0
    alpha = (1 + np.sqrt(17)) / 8
    while k < n:
        two = False
        if k < n - 1:
            r = k + 1 + int(np.abs(a[k + 1 :, k]).argmax())
            below = abs(a[r, k])
            if abs(a[k, k]) < alpha * below:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                largest = row.max()
                if abs(a[k, k]) * largest < alpha * below * below:
                    two = abs(a[r, r]) < alpha * largest
                    to = k + 1 if two else k
                    a[[to, r]] = a[[r, to]]
                    a[:, [to, r]] = a[:, [r, to]]
        if two:
            block, side = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            count += 1 if det < 0 else 2 * (block[0, 0] < 0)
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / det
            a[k + 2 :, k + 2 :] -= (side[:, :1] * inverse[0, 0] + side[:, 1:] * inverse[1, 0]) * side[:, 0] + (side[:, :1] * inverse[0, 1] + side[:, 1:] * inverse[1, 1]) * side[:, 1]
            k += 2
        else:
            p = a[k, k]
            count += p < 0
            if p:
                a[k + 1 :, k + 1 :] -= a[k + 1 :, k, None] * (a[k, k + 1 :] / p)
            k += 1
    return int(count)


def intervals(a: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals that together hold the k largest eigenvalues above ZERO, from above."""
    top = float(np.abs(a).sum(axis=1).max()) * (1 + 1e-9)
    if not top:
        return []
    known: dict[float, int] = {top: 0}

    def above(s: float) -> int:
        if s not in known:
            known[s] = len(a) - negatives(a - s * np.eye(len(a)))
        return known[s]

    def bracket(i: int, fine: float) -> tuple[float, float]:
        """low < eigenvalue i <= high (from 1, falling), fine apart."""
        lo = max((s for s, n in known.items() if n >= i), default=-top)
        hi = min(s for s, n in known.items() if n < i)
        while hi - lo > fine:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) >= i else (lo, mid)
        return lo, hi

    floor = ZERO * bracket(1, 1e-3 * top)[1]
    k = min(k, above(floor))

    def gap(i: int, fine: float) -> tuple[float, float]:
        """Width and middle of the room between eigenvalues i and i + 1; not above 0 where it can't be told."""
        lo, hi = bracket(i, fine)[0], bracket(i + 1, fine)[1] if i < len(a) else floor
        return lo - hi, (lo + hi) / 2

    out, high, done = [], bracket(1, 1e-3 * top)[1] + 1e-2 * top, 0
    while done < k:
        ends = range(done + 1, min(done + PER_INTERVAL, k) + 1)
        for fine in (1e-3, 1e-6, 1e-9, 1e-12):  # closer where eigenvalues crowd
            width, low, i = max((*gap(i, fine * top), i) for i in ends)
            if width > 0:
                break
        while width <= 0 and i < len(a):  # a cluster: to its end
            i += 1
            width, low = gap(i, 1e-12 * top)
        out.append((low, high, i - done))
        high, done = low, i
    return out


def feast(a: np.ndarray, low: float, high: float, many: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The many eigenvalues (falling) of a between low and high and their unit eigenvectors (columns)."""
    n, scale = len(a), float(np.abs(a).sum(axis=1).max())
    x, w = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(0.5j * np.pi * (x + 1))
    for size in (min(n, many + max(many, 8)), min(n, 3 * many + 16), n):
        block, last = np.random.default_rng([seed, size]).normal(size=(n, size)), np.inf
        for _ in range(30):
            projected = sum(0.5 * wj * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - a, block)).real for wj, t in zip(w, turn))
            basis, _ = np.linalg.qr(projected)
            basis, _ = np.linalg.qr(basis)
            values, small = np.linalg.eigh(basis.T @ a @ basis)
            block = basis @ small
            inside = (values > low) & (values <= high)
            rest = np.abs(a @ block[:, inside] - block[:, inside] * values[inside]).max() if inside.any() else np.inf
            if inside.sum() == many and rest <= 4e-16 * n * scale or (rest >= 0.5 * last and rest <= 1e-12 * scale):
                break
            last = rest
        if inside.sum() == many and rest <= 1e-10 * scale:
            order = np.argsort(-values[inside], kind="stable")
            return values[inside][order], block[:, inside][:, order]
    raise ArithmeticError(f"{many} eigenvalues are between {low} and {high} by inertia, {int(inside.sum())} were found")


def leading(spark, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above zero and their eigenvectors, each interval in a task of its own. a is dim x dim, whatever the rows."""
    cuts = intervals(a, k)
    if not cuts:
        return np.zeros(0), np.zeros((len(a), 0))
    sent = spark.sparkContext.broadcast(a)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, many in zip(*(c.to_pylist() for c in b.columns)):
                values, vectors = feast(sent.value, low, high, many)
                yield pa.RecordBatch.from_arrays([pa.array(values), V.rows(vectors.T)], names=["value", "vector"])

    table = spark.createDataFrame(cuts, "low double, high double, many int").repartition(len(cuts), "low")
    found = sorted(table.mapInArrow(solve, "value double, vector array<double>").collect(), key=lambda r: -r["value"])[:k]
    vectors = np.array([r["vector"] for r in found]).T
    return np.array([r["value"] for r in found]), vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(found))])


def whole_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and x (array of long) of rows whose vector is not null and holds only finite entries."""
    c = F.col("vec")
    fine = F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    bound = lambda v: F.greatest(F.least(F.floor(v * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)) + SHIFT
    rows = df.select(F.col(id_col).cast("long").alias("id"), V.doubles(df, vec_col).alias("vec"))
    return rows.filter(fine).select("id", F.transform("vec", bound).alias("x"))


def _longs(col: pa.Array) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _products(rows: DataFrame, width: int, of) -> np.ndarray:
    """Sum over rows of the products of all pairs of of(x); each task sends width rows of sums, which are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                d = of(_longs(b.column(0)))
                total += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(total.ravel())], names=["i", "j", "v"])

    summed = rows.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # width x width
    out = np.zeros((width, width))
    for r in summed:
        out[r["i"], r["j"]] = r["v"]
    return out


def fit(x: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on the distinct vectors of x (from whole_vectors), all of one length; None without rows."""
    spark = x.sparkSession
    distinct = save(x.select("x").distinct(), "distinct")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                m = _longs(b.column(0))
                wide = max(abs(int(m.max())), abs(int(m.min()))) * len(m) >= 1 << 62
                own = m.astype(object).sum(axis=0) if wide else m.sum(axis=0).astype(object)
                n, total = n + len(m), own if total is None else total + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    found = distinct.mapInArrow(sums, "i long, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # a row for each dimension
    if not found:
        return None
    model = Whitening(found[0]["n"], [int(r["s"]) for r in found], np.zeros(0), np.zeros((len(found), 0)), 0.0)
    covariance = _products(distinct, len(found), model.centred) / model.n
    covariance = (covariance + covariance.T) / 2
    model.trace = float(np.trace(covariance))
    model.values, model.vectors = leading(spark, covariance, components)
    if len(model.values):
        model.identity_error = float(np.abs(_products(distinct, len(model.values), model.project) / model.n - np.eye(len(model.values))).max())
    return model


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """vec_id, n, deviation, whitened (array, by falling eigenvalue), explained (array), identity_error of each row.

    Rows whose vector is null, empty or holds null or non-finite entries, or is of another length than most (of equally
    frequent lengths the smallest counts), are left out; zero vectors and null ids stay; repeated rows are returned each and
    fitted once. Components of zero variance are left out, so equal vectors get empty arrays. A deviation beyond a long is
    null. An empty table gives no rows; other columns are ignored.
    """
    x = whole_vectors(vectors, id_col, vec_col)
    usual = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    model = fit(x.filter(F.size("x") == usual["dim"]), components) if usual else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _longs(b.column(1))
            if len(m):
                white = V.rows(sent.value.project(m)) if len(sent.value.values) else pa.array([[]] * len(m), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.deviations(m), pa.int64()), white], names=["vec_id", "deviation", "whitened"])

    out = x.filter(F.size("x") == usual["dim"]).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values)).cast("array<double>")
    return out.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
