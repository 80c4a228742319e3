"""Whitening of embeddings with principal components from contour integrals (FEAST).

Spark makes exact integer sums of the quantised vectors and of their centred products; of those only the matrix of
columns x columns (at most `MOST` columns) reaches the driver. Its components are found interval by interval: the matrix is
brought to tridiagonal form once, the inertia of the shifted form counts the eigenvalues below a bound, and bisection cuts the spectrum into
intervals of a few eigenvalues each. For an interval, a Gauss rule on a circle through its ends sums solutions of the
complex shifted matrix: a filter that keeps the eigenvectors within and damps the others. Rayleigh-Ritz on the filtered vectors gives
components, and rounds go on until as many have settled as the inertia counts, so none is missed.

Defined results: null vectors and vectors with null or non-finite entries take no part, nor do empty ones, nor those of another length than
most of the rest have (ties: the longer). No vector left, or an empty table: no rows. A null vec_id is kept, repeated rows are rows of their
own, columns besides the two named are not looked at. Directions without variance (an eigenvalue of at most 1e-13 of the
trace) have null whitened; without any variance explained is null too. An entry beyond 2**50 / 64 raises OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 4096
SHIFT = 1_000_000
_SUM = "i int, j int, s decimal(38,0)"


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows whose vector has entries, all of them finite."""
    v = F.col(vector).cast("array<double>")
    rows = df.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def quantised(batch: pa.RecordBatch) -> np.ndarray:
    """floor(64 * c) + SHIFT of the vectors v of a batch, which all have one length."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    x = np.floor(64.0 * flat)
    if len(x) and np.abs(x).max() > 2.0**50:
        raise OverflowError("an entry is beyond 2**50 / 64")
    return (x.astype(np.int64) + SHIFT).reshape(batch.num_rows, -1)


def _exact(sums: dict) -> Iterator[pa.RecordBatch]:
    """Sums by (i, j) as rows."""
    keys = sorted(sums)
    if keys:
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(int(sums[k])) for k in keys], pa.decimal128(38, 0))]
        yield pa.record_batch(columns, ["i", "j", "s"])


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S): number and per-dimension sums of the quantised vectors of the most frequent length; S is empty without rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            for p in np.unique(lengths):
                x = quantised(batch.filter(pa.array(lengths == p)))
                # (length, dimension); dimension -1 has the number of rows
                sums[(int(p), -1)] = sums.get((int(p), -1), 0) + len(x)
                for j, s in enumerate(_column_sums(x)):
                    sums[(int(p), j)] = sums.get((int(p), j), 0) + s
        yield from _exact(sums)

    found = rows.select("v").mapInArrow(summed, _SUM).groupBy("i", "j").agg(F.sum("s").alias("s"))
    heads = sorted(((int(r.s), r.i) for r in found.where("j = -1").collect()), reverse=True)
    if not heads:
        return 0, []
    n, p = heads[0]
    if p > MOST:
        raise ValueError(f"vectors have {p} entries; {MOST} at most")
    by = {r.j: int(r.s) for r in found.where((F.col("i") == p) & (F.col("j") >= 0)).collect()}
    return n, [by[j] for j in range(p)]


def _column_sums(x: np.ndarray) -> list[int]:
    """Exact column sums of whole numbers of at most 2**51."""
    out = [0] * x.shape[1]
    for k in range(0, len(x), 2048):
        out = [a + int(b) for a, b in zip(out, x[k : k + 2048].sum(0), strict=True)]
    return out


def scatter(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """The covariance with divisor n, each entry the exact value rounded once.

    Vectors are centred at the whole number next to the mean, products are summed exactly, and the rest of the mean is taken off."""
    p, centre = len(s), np.array([round(x / n) for x in s], np.int64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p), object)
        for batch in batches:
            d = quantised(batch) - centre
            for k in range(0, len(d), 1024):
                total = total + _products(d[k : k + 1024])
        yield from _exact({(i, j): total[i, j] for i in range(p) for j in range(i, p) if total[i, j]})

    out = np.zeros((p, p))
    off = [a - n * int(c) for a, c in zip(s, centre, strict=True)]  # sums of the centred vectors
    got = {(r.i, r.j): int(r.s) for r in rows.select("v").mapInArrow(summed, _SUM).groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator()}
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = (n * got.get((i, j), 0) - off[i] * off[j]) / (n * n)  # whole numbers, divided once
    return out


def _products(d: np.ndarray) -> np.ndarray:
    """d.T @ d, exactly: in doubles while all sums stay below 2**53, else in whole numbers of any size."""
    most = float(np.abs(d).max(initial=0))
    if most * most * len(d) < 2.0**53:
        z = d.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = d.astype(object)
    return z.T @ z


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of a, by Householder reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm > 0:
            v[0] += np.copysign(norm, v[0])
            v /= np.linalg.norm(v)
            a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(tri: tuple[np.ndarray, np.ndarray], bound: float) -> int:
    """Inertia: how many eigenvalues are below the bound, by the signs of the pivots of the shifted tridiagonal form."""
    count, pivot, tiny = 0, 1.0, 1e-300
    for d, e in zip(tri[0], np.concatenate([[0.0], tri[1]]), strict=True):
        pivot = d - bound - e * e / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def intervals(tri: tuple[np.ndarray, np.ndarray], top: int, most: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, count) of disjoint intervals with the `top` largest eigenvalues, falling, each with at most `most` but for clusters."""
    p = len(tri[0])
    reach = np.abs(np.concatenate([[0.0], tri[1]])) + np.abs(np.concatenate([tri[1], [0.0]]))
    high, least = float((tri[0] + reach).max()), float((tri[0] - reach).min())
    slack = 1e-13 * max(abs(high), abs(least), 1e-300) * p
    high, low = high + slack, least - slack
    stack, out, found = [(low, high, 0, p)], [], 0  # bounds, and how many are below each
    while stack and found < top:
        a, b, under_a, under_b = stack.pop()
        if under_a == under_b:
            continue
        if under_b - under_a <= most or b - a <= 4 * slack:
            out.append((a, b, under_b - under_a))
            found += under_b - under_a
            continue
        mid = (a + b) / 2
        under = below(tri, mid)
        stack += [(a, mid, under_a, under), (mid, b, under, under_b)]
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, tri: tuple[np.ndarray, np.ndarray], nodes: int = 8, rounds: int = 60) -> np.ndarray:
    """The `count` unit eigenvectors of the symmetric matrix a with eigenvalues from low to high, as columns."""
    p = len(a)
    scale = np.abs(np.concatenate(tri)).max()
    centre, radius = (low + high) / 2, max((high - low) / 2, 1e-14 * scale)
    x, w = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi / 2 * (1 - x)  # the upper half of the circle; the lower is its mirror image
    z = centre + radius * np.exp(1j * angles)
    size = min(p, count + max(6, count // 2))
    rng = np.random.default_rng(0)
    y = rng.standard_normal((p, size))
    for k in range(rounds):
        q = np.zeros_like(y)
        for zj, wj, t in zip(z, w, angles, strict=True):
            solved = np.linalg.solve(zj * np.eye(p) - a, y.astype(complex))
            q += 0.5 * wj * (radius * np.exp(1j * t) * solved).real
        q, _ = np.linalg.qr(q)
        theta, v = np.linalg.eigh(q.T @ a @ q)
        y = q @ v
        rest = np.linalg.norm(a @ y - y * theta, axis=0)
        # Ritz values within half a rounding of the ends count as inside; strays have large residuals
        edge = 1e-12 * scale
        inside = np.flatnonzero((theta >= low - edge) & (theta < high + edge) & (rest <= 1e-13 * scale * np.sqrt(p)))
        if len(inside) > count:  # settled neighbours at an end: the inertia says which side they are on
            mid = (low + high) / 2
            inside = inside[np.argsort(np.abs(theta[inside] - mid), kind="stable")[:count]]
        if len(inside) == count:
            return y[:, np.sort(inside)]
        if k % 12 == 11 and size < p:  # neighbours just outside slow it down: take more vectors
            size = min(p, 2 * size)
            y = np.column_stack([y, rng.standard_normal((p, size - y.shape[1]))])
    raise RuntimeError("an eigenvalue interval did not settle")


def components(v: np.ndarray, top: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(e, u): the `top` largest eigenvalues of the covariance v, falling, and their unit eigenvectors as columns.

    Each vector's entry of largest size is positive."""
    p, scale = len(v), float(np.abs(v).max(initial=0))
    top = min(top, p)
    if scale == 0:
        return np.zeros(top), np.eye(p)[:, :top]
    a = v / scale
    tri = tridiagonal(a)
    u = np.column_stack([feast(a, low, high, count, tri) for low, high, count in intervals(tri, top)])
    q, _ = np.linalg.qr(u)  # vectors of neighbouring intervals are orthogonal but for rounding
    if q.shape[1] < top:
        raise RuntimeError("components are missing")
    theta, w = np.linalg.eigh(q.T @ a @ q)
    e, u = theta[::-1][:top] * scale, (q @ w)[:, ::-1][:, :top]
    return e, u * np.sign(u[np.abs(u).argmax(0), np.arange(top)])


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """Exact sums of (n * x - S)^2 over the dimensions, as longs; a larger one raises OverflowError."""
    sizes = np.abs(n * x.astype(np.float64) - s.astype(np.float64))
    if float(n) * float(np.abs(x).max(initial=0)) < 2.0**62 and (sizes * sizes).sum(1).max(initial=0) < 2.0**62:
        d = n * x - s.astype(np.int64)
        return (d * d).sum(1)
    d = n * x.astype(object) - s
    found = (d * d).sum(1)
    if max(found, default=0) >= 1 << 63:
        raise OverflowError("a deviation is beyond a long")
    return found.astype(np.int64)


def whiten(df: DataFrame, top: int = 32, vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, at most `top`), n, deviation, whitened, explained and identity_error of each usable row of df.

    x are the quantised vectors, S their sums. deviation: sum of (n * x - S)^2. whitened: x - S / n on the component, over the root of its eigenvalue;
    explained: eigenvalue / trace; identity_error: largest absolute entry of the covariance of all whitened rows minus the identity."""
    rows = usable(df, vector)
    n, s = totals(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    p, sums = len(s), np.array(s, object)
    rows = rows.where(F.size("v") == p).select(F.col("vec_id").cast("long"), "v")
    v = scatter(rows, n, s)
    e, u = components(v, top)
    trace, k = float(np.trace(v)), u.shape[1]
    real = e > 1e-13 * max(trace, 1e-300)
    axes = u[:, real] / np.sqrt(e[real])
    near = np.array([x // n for x in s], np.int64)
    rest = np.array([x % n / n for x in s])

    def white(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = quantised(batch)
        # the whole part of the mean is taken off in whole numbers
        return x, ((x - near).astype(np.float64) - rest) @ axes

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((axes.shape[1], axes.shape[1] + 1))
        for batch in batches:
            _, w = white(batch)
            total += np.column_stack([w.T @ w, w.sum(0)])
        i, j = np.indices(total.shape)
        # as decimals, so that the sum does not depend on the order of tasks
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array([Decimal(repr(float(t))).quantize(Decimal("1e-15")) for t in total.ravel()], pa.decimal128(38, 15))], ["i", "j", "s"])

    error, live = None, axes.shape[1]
    if live:
        got = np.zeros((live, live + 1))
        for r in rows.mapInArrow(squared, "i int, j int, s decimal(38,15)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            got[r.i, r.j] = float(r.s) / n
        error = float(np.abs(got[:, :-1] - np.outer(got[:, -1], got[:, -1]) - np.eye(live)).max())
    share = [float(x / trace) if trace > 0 else None for x in e]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x, w = white(batch)
                m = len(x)
                full = np.full((m, k), np.nan)
                full[:, real] = w
                values = pa.array(full.ravel(), mask=~np.tile(real, m))
                ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(deviations(x, n, sums), k)), values]
                columns += [pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64())]
                yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(coded, schema)
