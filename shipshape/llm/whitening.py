"""Embedding whitening (operator 12): distributed centred covariance, tridiagonal eigensolver, broadcast projection.

Entries become whole numbers on a grid, so sums and products are exact and components don't depend
on the partitioning.
A first pass sums the dimensions; a second centres each vector at the rounded mean and sums its
outer products, whose remaining shift is taken out exactly. The covariance (dimensions squared,
whatever the number of rows) is reduced to tridiagonal form by Householder reflections; Sturm counts
bisect for the leading eigenvalues; inverse iteration, orthogonalised within clusters, gives their
vectors. The components are broadcast and every row is projected.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shipshape.llm.common import batches, written

#: Entries become floor(GRID * c) + SHIFT.
GRID, SHIFT = 1024, 100_000
#: Entries of this magnitude or more count as not finite: their whole numbers leave no room for exact sums.
LARGE = 2.0 ** 30
#: Rows multiplied at once, so that products of values below SPLIT sum exactly in double precision.
LOT = 2048
SPLIT = 1 << 21
_EPS = np.finfo(float).eps


# ---- symmetric eigenproblem, for the covariance only ----

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors (the k-th acts on rows k + 1 and on) of a symmetric matrix."""
    a, n, reflectors = np.array(a, float), len(a), []
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 1):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        off[k] = x[0]
        if k == n - 2 or size == 0 or not x[1:].any():
            reflectors.append(np.zeros_like(x))
            continue
        off[k] = -np.copysign(size, x[0])
        x[0] -= off[k]
        x /= np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ x
        w = p - (x @ p) * x
        rest -= 2 * (np.outer(x, w) + np.outer(w, x))
        reflectors.append(x)
    return np.diagonal(a).copy(), off, reflectors


def below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are less than each of ``at``."""
    tiny = max(np.abs(diag).max(), np.abs(off).max() if len(off) else 0, np.finfo(float).tiny) * _EPS ** 2
    count = np.zeros(len(at), int)
    pivot = np.ones(len(at))
    for i, d in enumerate(diag):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bit."""
    n = len(diag)
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    wide = max(np.abs(diag).max() + reach.max(), np.finfo(float).tiny)
    lo, hi = np.full(k, (diag - reach).min() - wide * _EPS * n), np.full(k, (diag + reach).max() + wide * _EPS * n)
    want = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    while True:
        mid = lo + (hi - lo) / 2
        if not ((mid > lo) & (mid < hi)).any():
            return mid
        over = below(diag, off, mid) > want
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)


def _solve(diag: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solve (T - shift) z = right by elimination with row exchanges."""
    n = len(diag)
    d, u, v, z = diag - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    low = off.copy()
    tiny = max(np.abs(diag).max(), np.abs(off).max() if len(off) else 0, np.finfo(float).tiny) * _EPS
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low[i], u[i], d[i + 1], v[i], u[i + 1] = low[i], d[i], d[i + 1], u[i], u[i + 1], 0.0
            z[i], z[i + 1] = z[i + 1], z[i]
        if d[i] == 0:
            d[i] = tiny
        f = low[i] / d[i]
        d[i + 1] -= f * u[i]
        u[i + 1] -= f * v[i]
        z[i + 1] -= f * z[i]
    for i in range(n - 1, -1, -1):
        rest = z[i] - (u[i] * z[i + 1] if i + 1 < n else 0) - (v[i] * z[i + 2] if i + 2 < n else 0)
        z[i] = rest / (d[i] if abs(d[i]) > tiny else np.copysign(tiny, d[i]))
    return z


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    n = len(matrix)
    k = min(k, n)
    scale = np.abs(matrix).max() if n else 0
    if not scale:
        return np.zeros(k), np.eye(n)[:, :k]
    diag, off, reflectors = tridiagonal(matrix / scale)
    values = leading(diag, off, k)
    norm = np.abs(diag).max() + (2 * np.abs(off).max() if len(off) else 0)
    random, vectors = np.random.default_rng(7), np.zeros((n, k))
    shift = np.inf
    for j in range(k):
        # equal eigenvalues are parted a little; vectors within a cluster are kept at right angles
        shift = min(values[j], shift - 4 * _EPS * norm)
        cluster = [i for i in range(j) if values[i] - values[j] <= 1e-3 * norm]
        z = random.normal(size=n)
        for _ in range(4):
            z = _solve(diag, off, shift, z / np.linalg.norm(z))
            z /= np.abs(z).max()
            for _ in range(2):
                for i in cluster:
                    z -= (vectors[:, i] @ z) * vectors[:, i]
        vectors[:, j] = z / np.linalg.norm(z)
    for at in range(len(reflectors) - 1, -1, -1):
        h = reflectors[at]
        vectors[at + 1:] -= 2 * np.outer(h, h @ vectors[at + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return values * scale, vectors


# ---- statistics of the vectors ----

def _whole(column, dim: int) -> np.ndarray:
    """The rows' whole numbers, one row each."""
    flat = np.asarray(column.flatten().cast(pa.float64()))
    return (np.floor(GRID * flat).astype(np.int64) + SHIFT).reshape(-1, dim)


@dataclass(frozen=True)
class Fit:
    """Statistics of the fit list: exact sums, whole mean and remainder, components and eigenvalues (falling)."""

    n: int
    dim: int
    sums: tuple[int, ...]
    middle: tuple[int, ...]
    reach: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rest(self) -> tuple[int, ...]:
        return tuple(s - self.n * m for s, m in zip(self.sums, self.middle))


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector is neither null nor holds null, non-finite or too large entries."""
    fine = F.forall(F.col(vector_col), lambda c: c.isNotNull() & (F.abs(c) < F.lit(LARGE)))
    return rows.where(fine).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))


def _sums(dim: int):
    def run(it):
        total, low, high, n = np.zeros(dim, np.int64), np.full(dim, 1 << 62), np.full(dim, -(1 << 62)), 0
        for b in it:
            x = _whole(b.column("v"), dim)
            if len(x):
                total, low, high, n = total + x.sum(0), np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total), pa.array(low), pa.array(high), pa.array(np.full(dim, n))],
                                             names=["j", "s", "low", "high", "n"])
    return run


def _products(dim: int, middle: np.ndarray, reach: int):
    """Per task the upper triangle of the sums of outer products about ``middle``, as whole numbers."""
    at = np.triu_indices(dim)
    shift = 21 if reach > SPLIT else 0

    def out(parts) -> pa.RecordBatch:
        if shift:
            hh, hl, ll = (p[at].astype(object) for p in parts)
            values = pa.array([decimal.Decimal(int(v)) for v in (hh << (2 * shift)) + ((hl + parts[1].T[at].astype(object)) << shift) + ll], pa.decimal128(38, 0))
        else:
            values = pa.array(parts[0][at]).cast(pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), values], names=["i", "j", "g"])

    def run(it):
        parts, rows = [np.zeros((dim, dim), np.int64) for _ in range(3 if shift else 1)], 0
        for b in it:
            x = _whole(b.column("v"), dim) - middle
            for k in range(0, len(x), LOT):
                lot = x[k:k + LOT]
                if shift:
                    high, low = (lot >> shift).astype(float), (lot & ((1 << shift) - 1)).astype(float)
                    for p, more in zip(parts, (high.T @ high, high.T @ low, low.T @ low)):
                        p += more.astype(np.int64)
                else:
                    lot = lot.astype(float)
                    parts[0] += (lot.T @ lot).astype(np.int64)
                rows += len(lot)
            if rows >= 1 << 19:  # before a sum could leave 63 bits
                yield out(parts)
                parts, rows = [np.zeros((dim, dim), np.int64) for _ in parts], 0
        if rows:
            yield out(parts)
    return run


def fit(vectors: DataFrame, dim: int, k: int) -> Fit:
    """Sums, covariance and leading components of (id, v); what reaches the driver depends on the dimension alone."""
    stats = vectors.select("v").mapInArrow(_sums(dim), "j int, s long, low long, high long, n long").groupBy("j").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("j").collect()
    n = stats[0]["n"]
    sums = tuple(int(r["s"]) for r in stats)
    middle = tuple((2 * s + n) // (2 * n) for s in sums)
    reach = max(max(r["high"] - m, m - r["low"]) for r, m in zip(stats, middle))
    rest = [s - n * m for s, m in zip(sums, middle)]
    summed = vectors.select("v").mapInArrow(_products(dim, np.array(middle), reach), "i int, j int, g decimal(38,0)").groupBy("i", "j").agg(F.sum("g").alias("g"))
    cov = np.zeros((dim, dim))
    trace = 0
    for r in summed.toLocalIterator():
        i, j = r["i"], r["j"]
        exact = n * int(r["g"]) - rest[i] * rest[j]
        cov[i, j] = cov[j, i] = exact / (n * n)
        trace += exact if i == j else 0
    values, components = eigen(cov, k)
    held = values > max(values[0], 0) * dim * 16 * _EPS if len(values) else np.zeros(0, bool)
    return Fit(n, dim, sums, middle, reach, values[held], components[:, held], trace / (n * n))


def _projected(f: Fit):
    middle, rest = np.array(f.middle), np.array(f.rest, object)
    to = f.vectors / np.sqrt(f.values)
    shift = np.array([r / f.n for r in f.rest]) @ to
    # n * x - S fits 63 bits with its squares' sum, or is taken as Python's whole numbers
    small = f.dim * (f.n * f.reach + max(map(abs, f.rest))) ** 2 < 1 << 63

    def run(it):
        for b in it:
            y = _whole(b.column("v"), f.dim) - middle
            if small:
                dev = pa.array(((f.n * y - rest.astype(np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = ((f.n * y.astype(object) - rest) ** 2).sum(1) if len(y) else []
                dev = pa.array([decimal.Decimal(int(e)) if e < 10 ** 38 else None for e in exact], pa.decimal128(38, 0))
            w = y.astype(float) @ to - shift
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * to.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), dev, lists], names=["id", "deviation", "whitened"])
    return run


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component, n, deviation (decimal), whitened, explained, identity_error.

    Vectors that are null or hold null, non-finite or (2^30 or more) too large entries take no part,
    nor do vectors of another dimension than the commonest one above 0 (ties: the smallest). Rows
    that repeat an id, or have none, are vectors like any other. Components are numbered by falling
    eigenvalue; their largest entry is positive. Components without variance (of equal rows, or
    beyond the rank of the vectors) can't be scaled and are left out. ``deviation`` is null beyond 38
    digits. A table without vectors, or of equal ones only, gives no rows.
    """
    spark = rows.sparkSession
    batches(spark)
    vectors = usable(rows, id_col, vector_col)
    kind = dict(vectors.dtypes)["id"]
    sizes = vectors.groupBy(F.size("v").alias("dim")).count().where("dim > 0").orderBy(F.col("count").desc(), "dim").limit(1).collect()
    schema = f"id {kind}, deviation decimal(38,0), whitened array<double>"
    if sizes:
        vectors = vectors.where(F.size("v") == sizes[0]["dim"])
        f = fit(vectors, sizes[0]["dim"], k)
        held = len(f.values)
    else:
        held = 0
    if held:
        done = written(vectors.mapInArrow(_projected(f), schema))
        at = [(i, j) for i in range(held) for j in range(i, held)]
        got = done.agg(*(F.covar_pop(F.get("whitened", i), F.get("whitened", j)).alias(f"c{i}_{j}") for i, j in at)).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(got, at))
        n, shares = f.n, (f.values / f.trace).tolist()
    else:
        done, n, error, shares = spark.createDataFrame([], schema), 0, 0.0, [0.0]
    return done.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("c", "whitened")).select(
        id_col, (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)), F.col("c")).alias("explained"), F.lit(float(error)).alias("identity_error"))
