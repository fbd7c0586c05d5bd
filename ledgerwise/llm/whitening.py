"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor.

1. Every entry c becomes the long floor(64 * c) + 1000000.  One pass sums each dimension, exactly.
2. A second pass centres the entries at the rounded means (integers) and multiplies them.  The products are integers:
   blocks whose sums stay below 2^53 go through floating point without rounding, others through Python integers.  The
   partial sums travel as two longs per cell and are added as decimals, so the scatter is exact and independent of
   partitioning; the rest of the mean is taken off in integers on the driver.
3. The driver factors the d x d scatter: A[p, p] = L L' by Cholesky with the largest remaining diagonal as pivot, stopped at the
   numerical rank.  One-sided Jacobi turns pairs of columns of L until all are orthogonal.  Squared column norms are
   the eigenvalues, the columns divided by their norms the components; A V = V E follows from A = (L J)(L J)'.
4. A third pass measures the covariance of the whitened vectors, a fourth writes the rows.

What reaches the driver is d sums and d(d + 1)/2 cells, whatever the number of vectors; more than ``MAX_DIM``
dimensions are refused.

Results: one row per vector and component up to ``top``.  Vectors that are null or hold a null or non-finite entry are
left out, and so are empty ones.  If lengths differ, the most frequent length counts (ties: the larger) and vectors of other lengths are
left out.  Entries beyond 2^40 in absolute value count as 2^40.  Directions without variance (numerical rank) have no
component, so equal vectors, a single vector or an empty table give no rows.  Equal eigenvalues share a subspace,
in which any basis may come out.  Null ids and repeated rows are kept, each row counts.  A deviation beyond a long is null.  Other
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIM = 4096
TOP = 32
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 40)
#: Cells travel as hi * 2^32 + lo.
_LIMB = 32


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer entries floor(64 c), without the shift, of clean vectors of one length."""
    flat = pa.chunked_array([column]).combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(np.clip(c * SCALE, -LARGEST, LARGEST)).astype(np.int64)


def exact_products(x: np.ndarray, block: int = 4096) -> np.ndarray:
    """x'x of an integer matrix in Python integers; blocks go through floating point where no sum can round."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for i in range(0, len(x), block):
        part = x[i:i + block]
        if int(np.abs(part).max(initial=0)) ** 2 * len(part) < 1 << 53:
            f = part.astype(np.float64)
            total = total + (f.T @ f).astype(np.int64)
        else:
            o = part.astype(object)
            total = total + o.T @ o
    return total


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor g (d x rank, lower triangular but for the order of its rows) with g g' = a."""
    d = len(a)
    rest, g = np.diag(a).copy(), np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    left = np.ones(d, bool)
    for k in range(d):
        p = int(np.where(left, rest, -np.inf).argmax())
        if rest[p] <= floor:
            return g[:, :k]
        left[p] = False
        g[p, k] = np.sqrt(rest[p])
        g[left, k] = (a[left, p] - g[left, :k] @ g[p, :k]) / g[p, k]
        rest[left] -= g[left, k] ** 2
    return g


def jacobi(g: np.ndarray, sweeps: int = 40, tol: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of g g' by turning pairs of columns of g until all are orthogonal.

    A round turns disjoint pairs at once; r - 1 rounds of a tournament meet every pair.
    """
    u = g[:, np.argsort(-(g * g).sum(0), kind="stable")].copy()
    r = u.shape[1]
    ring = np.arange(r + r % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            a, b = ring[:len(ring) // 2], ring[::-1][:len(ring) // 2]
            real = (a < r) & (b < r)
            a, b = a[real], b[real]
            x, y = u[:, a], u[:, b]
            aa, bb, ab = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            act = np.abs(ab) > tol * np.sqrt(aa * bb)
            if act.any():
                turned = True
                zeta = (bb - aa) / (2 * np.where(act, ab, 1.0))
                t = np.where(act, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                u[:, a], u[:, b] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    values = (u * u).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order] / np.sqrt(values[order])


@dataclass
class Whitening:
    """What ``fit`` learns: bounded by the dimension, not by the number of vectors."""

    n: int
    sums: list[int]  # of the entries with the shift
    values: np.ndarray  # eigenvalues of the covariance, falling
    components: np.ndarray  # d x rank, unit columns
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the integer part taken off first."""
        base = [(s // self.n) - SHIFT for s in self.sums]
        rest = [(s % self.n) / self.n for s in self.sums]
        return (x - np.array(base)).astype(np.float64) - np.array(rest)

    def whiten(self, x: np.ndarray, top: int) -> np.ndarray:
        return self.centre(x) @ self.components[:, :top] / np.sqrt(self.values[:top])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n x - S)^2, null beyond a long."""
        base = np.array([(s // self.n) - SHIFT for s in self.sums])
        y, r = x - base, [s % self.n for s in self.sums]  # n x - S = n y - r
        big = int(np.abs(y).max(initial=0)) + 1
        if (big * self.n) ** 2 * self.dim < 1 << 63:
            return ((y * self.n - np.array(r)) ** 2).sum(1).tolist()
        o = y.astype(object) * self.n - np.array(r, dtype=object)
        return [v if v < 1 << 63 else None for v in (o * o).sum(1)]


def clean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that count, and their length."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = most.d if most else 0
    if dim > MAX_DIM:
        raise ValueError(f"more than {MAX_DIM} dimensions")
    return rows.filter(F.size("v") == dim), dim


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for b in batches:
            x = matrix(b.column(0), dim)  # entries are at most 2^40 and a batch below 2^20 rows
            n, total = n + len(x), total + x.sum(0)
        hi, lo = [v >> _LIMB for v in total] + [0], [v & ((1 << _LIMB) - 1) for v in total] + [n]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim + 1), pa.int32()), "hi": pa.array(map(int, hi), pa.int64()),
                                          "lo": pa.array(map(int, lo), pa.int64())})

    found = {r.i: int(r.hi) * (1 << _LIMB) + int(r.lo) for r in _added(rows.select("v").mapInArrow(part, "i int, hi bigint, lo bigint"), "i")}
    n = found.get(dim, 0)
    return n, [found.get(i, 0) + n * SHIFT for i in range(dim)]


def _added(parts: DataFrame, *keys: str) -> list:
    whole = "decimal(38,0)"
    return parts.groupBy(*keys).agg(F.sum(F.col("hi").cast(whole)).alias("hi"), F.sum(F.col("lo").cast(whole)).alias("lo")).collect()


def _scatter(rows: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n, rounded once from exact integers."""
    at = np.array([(2 * (s - n * SHIFT) + n) // (2 * n) for s in sums])  # rounded means
    upper = np.triu_indices(dim)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), dtype=object)
        for b in batches:
            total = total + exact_products(matrix(b.column(0), dim) - at)
        cells = total[upper]
        for s in range(0, len(cells), 65_536):
            c = cells[s:s + 65_536]
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(upper[0][s:s + 65_536], pa.int32()), "j": pa.array(upper[1][s:s + 65_536], pa.int32()),
                "hi": pa.array([int(v) >> _LIMB for v in c], pa.int64()),
                "lo": pa.array([int(v) & ((1 << _LIMB) - 1) for v in c], pa.int64())})

    off = [s - n * SHIFT - n * int(a) for s, a in zip(sums, at)]
    cov = np.zeros((dim, dim))
    for r in _added(rows.select("v").mapInArrow(part, "i int, j int, hi bigint, lo bigint"), "i", "j"):
        exact = n * (int(r.hi) * (1 << _LIMB) + int(r.lo)) - off[r.i] * off[r.j]
        cov[r.i, r.j] = cov[r.j, r.i] = exact / (n * n)  # integers divide with one rounding
    return cov


def fit(rows: DataFrame, dim: int) -> Whitening:
    """Whitening of clean vectors (``clean``) of length ``dim``."""
    n, sums = _sums(rows, dim) if dim else (0, [])
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    cov = _scatter(rows, dim, n, sums)
    values, components = jacobi(pivoted_cholesky(cov))
    return Whitening(n, sums, values, components, float(np.trace(cov)))


def identity_error(rows: DataFrame, model: Whitening, top: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, measured on all of them."""
    k = min(top, len(model.values))
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))  # plain values: workers have no copy of this package

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, model = np.zeros(k), np.zeros((k, k)), Whitening(**shared.value)
        for b in batches:
            w = model.whiten(matrix(b.column(0), model.dim), k)
            total, square = total + w.sum(0), square + w.T @ w
        cells = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(cells)), pa.int32()), "x": pa.array(cells, pa.float64())})

    cells = np.zeros(k + k * k)
    for r in rows.select("v").mapInArrow(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        cells[r.i] = r.x
    mean = cells[:k] / model.n
    cov = cells[k:].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows, dim = clean(vectors, id_col, vec_col)
    model = fit(rows, dim)
    k = min(top, len(model.values))
    schema = "vec_id bigint, deviation bigint, w array<double>"
    if k:
        error = identity_error(rows, model, top)
        shared = rows.sparkSession.sparkContext.broadcast(vars(model))  # plain values: workers have no copy of this package

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Whitening(**shared.value)
            for b in batches:
                x = matrix(b.column("v"), model.dim)
                w = model.whiten(x, k)
                at = pa.array(np.arange(len(x) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(model.deviation(x), pa.int64()),
                     pa.ListArray.from_arrays(at, pa.array(w.ravel(), pa.float64()))], ["vec_id", "deviation", "w"])

        out = rows.mapInArrow(part, schema)
    else:
        error, out = 0.0, rows.sparkSession.createDataFrame([], schema)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]]) if k else F.array().cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
