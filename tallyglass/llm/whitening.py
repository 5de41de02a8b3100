"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Vectors are numbers of a fixed grid: floor(64 c) + 1,000,000. Their count and sums are exact. The
scatter is summed over centred vectors, in tasks, and only its upper triangle reaches the driver
(MOST_DIMENSIONS bounds it, whatever the number of rows). There it is factored with diagonal
pivots into L L', and plane rotations from the right make the columns of L orthogonal to each other.
A rotated column's squared norm is an eigenvalue, and the column itself, normalised and with its
rows back in their order, the eigenvector: L J = U S gives L L' = U S^2 U'. The scatter is never
diagonalised as such, so small eigenvalues keep their digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.common import prepare

SCALE, SHIFT = 64, 1_000_000  # fixed values of the grid
COMPONENTS = 32
MOST_DIMENSIONS = 2048
SWEEPS, CLOSE = 60, 1e-15
LONG = 1 << 63


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L'; L has as many columns as a has rank."""
    left, d = np.array(a, float), len(a)
    order, out = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(left.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        at = k + int(np.argmax(left.diagonal()[k:]))
        if left[at, at] <= least:
            return out[:, :k], order
        if at != k:
            left[[k, at]], out[[k, at]], order[[k, at]] = left[[at, k]], out[[at, k]], order[[at, k]]
            left[:, [k, at]] = left[:, [at, k]]
        column = left[k:, k] / np.sqrt(left[k, k])
        out[k:, k] = column
        left[k + 1:, k + 1:] -= np.outer(column[1:], column[1:])
    return out, order


def rounds(n: int):
    """Rounds of disjoint pairs in which each two of n columns meet once."""
    ring = list(range(n)) + ([-1] if n % 2 else [])
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[:half - 1:-1], strict=True)
                 if a >= 0 and b >= 0]
        if pairs:
            yield np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns rotated until all are orthogonal to each other."""
    a = np.array(factor, float)
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in rounds(a.shape[1]):
            x, y = a[:, i], a[:, j]
            p, q, r = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(r) / np.maximum(np.sqrt(p * q), np.finfo(float).tiny)
            worst = max(worst, float(cosine.max()))
            turn = cosine > CLOSE
            zeta = (q - p) / np.where(turn, 2 * r, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, i], a[:, j] = c * (x - t * y), c * (y + t * x)
        if worst <= 4 * CLOSE:
            break
    return a


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors in columns) of a covariance, largest first; as many as it has rank.

    A vector's largest entry is positive.
    """
    factor, order = pivoted_cholesky(v)
    turned = jacobi(factor)
    norms = np.sqrt((turned ** 2).sum(0))
    rank = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(turned)
    vectors[order] = turned[:, rank] / norms[rank]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(rank))]) if len(rank) else 1
    return norms[rank] ** 2, vectors * signs


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>): vectors without null or non-finite entries, of the commonest length.

    Of lengths equally common, the greater one counts.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
                          ).where("size(v) > 0 and not exists(v, c -> c is null or isnan(c) "
                                  "or abs(c) = double('infinity'))")
    lengths = rows.groupBy(F.size("v").alias("d")).count()
    best = lengths.agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    if best is not None and best > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {best} dimensions; at most {MOST_DIMENSIONS} are supported")
    return rows.where(F.size("v") == F.lit(best or 0))


def grid(batch, column: int = 1) -> np.ndarray:
    """The rows of a batch as floor(64 c), without the shift, which no covariance sees."""
    flat = batch.column(column)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values).reshape(len(flat), -1)


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors, and for each dimension the exact sum of floor(64 c)."""
    def sums(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = grid(batch, 0)
                small = np.abs(x).max() * len(x) < 2.0 ** 53
                own = [int(c) for c in x.sum(0)] if small else [sum(map(int, c)) for c in x.T]
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
                n += batch.num_rows
        if n:
            yield pa.record_batch([pa.array([-1, *range(len(total))], pa.int32()),
                                   pa.array([str(n), *map(str, total)])], ["i", "s"])

    got = rows.select("v").mapInArrow(sums, "i int, s string").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    at = {r.i: int(r.s) for r in got}
    return at.get(-1, 0), [at[i] for i in range(len(at) - 1)]


def scatter(rows: DataFrame, centre: np.ndarray, turned: np.ndarray | None = None) -> np.ndarray:
    """The sum over all vectors of u u', for u = floor(64 c) - centre, times `turned` if given.

    A task sends one upper triangle.
    """
    shared = rows.sparkSession.sparkContext.broadcast((centre, turned))

    def products(batches):
        centre, turned = shared.value
        total = None
        for batch in batches:
            if batch.num_rows:
                u = grid(batch, 0) - centre
                u = u if turned is None else u @ turned
                total = u.T @ u if total is None else total + u.T @ u
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                   pa.array(total[i, j])], ["i", "j", "s"])

    d = len(centre) if turned is None else turned.shape[1]
    out = np.zeros((d, d))
    for r in rows.select("v").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(
            F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row.

    Rows whose vector is null, empty or of another than the commonest length, or holds null or
    non-finite entries, are left out. There are `components` components, or as many as the
    covariance has rank: none for one vector or for equal ones, and then no rows. deviation is null
    where it exceeds 64 bits. Repeated rows and null ids stay. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors, vec_id, vector)
    n, sums = moments(rows)
    schema = rows.select(
        "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"),
        F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    if not n:
        return schema.limit(0)
    centre = np.array([s / n for s in sums])
    v = scatter(rows, centre) / n
    values, axes = eigen(v)
    values, axes = values[:components], axes[:, :components]
    if not len(values):
        return schema.limit(0)
    turned = axes / np.sqrt(values)
    # Whitened vectors are centred already; what rounding leaves of their mean is taken off too.
    error = np.abs(scatter(rows, centre, turned) / n - np.eye(len(values))).max()
    shared = spark.sparkContext.broadcast((sums, centre, turned, values / np.trace(v), float(error)))

    def out(batches):
        sums, centre, turned, explained, error = shared.value
        k = turned.shape[1]
        small = np.array([min(max(s, -LONG), LONG - 1) for s in sums], np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = grid(part)
                if n * np.abs(x).max() + max(map(abs, sums)) < 2.0 ** 31 / len(centre) ** .5:
                    off = n * x.astype(np.int64) - small
                    deviation = [int(d) for d in (off * off).sum(1)]
                else:
                    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True))
                                 for row in x]
                    deviation = [d if d < LONG else None for d in deviation]
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(rows), n, np.int64)),
                     pa.array(deviation, pa.int64()).take(pa.array(rows)),
                     pa.array(((x - centre) @ turned).ravel()),
                     pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained",
                     "identity_error"])

    return rows.mapInArrow(out, schema.schema)
