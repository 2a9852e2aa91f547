"""Whitening of embeddings by principal components, from an exact scatter matrix.

Entries become integers, so sums are exact. The scatter is taken about the rounded mean and then moved to the mean itself, still in
integers; each task sends one number for each pair of dimensions. Of the d x d matrix, whose size the data do not change, the
components are found by pivoted Cholesky, which gives a triangular factor L with scatter = L L', and by one-sided Jacobi on L
itself: its columns are rotated against each other until all are at right angles. The squared norms of the rotated columns are
the eigenvalues, the columns at unit length the components; the product L L' is never formed again, so small eigenvalues keep
their relative accuracy.

Defined cases: vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another length
than the most frequent one (of equally frequent ones the longest). Entries beyond 2^40 count as 2^40. Repeated rows, and null or
repeated ids, count and are returned row by row. Components without variance (an eigenvalue below 1e-12 of the trace) do not
exist, so equal vectors give no rows, nor does an empty table. A deviation beyond 64 bits is null. Extra columns do not matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
_MOST = float(1 << 40)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is neither null nor empty and has neither null nor non-finite entries."""
    good = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    """Entries of a batch of vectors of one length as integers, without the offset."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(np.clip(SCALE * flat, -_MOST, _MOST)).astype(np.int64).reshape(-1, d)


def _sums(rows: DataFrame, vector: str) -> tuple[int, int, list[int]]:
    """Dimensions, count and sums by dimension (offset left out) of the vectors of the most frequent length."""
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if sizes is None:
        return 0, 0, []
    d, n = sizes["d"], sizes["n"]

    def run(batches):
        total = np.zeros(d, np.int64)
        for b in batches:
            total += _integers(b.column(0), d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], ["i", "total"])

    by = rows.where(F.size(vector) == d).select(vector).mapInArrow(run, "i int, total long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = dict(by.collect())  # a row for each dimension
    return d, n, [int(found[i]) for i in range(d)]


def _products(rows: DataFrame, vector: str, d: int, about: list[int]) -> list[list[int]]:
    """Sums of products of each two dimensions, about the given integers: a number for each pair from each task."""
    upper = np.triu_indices(d)
    centre = np.array(about, np.int64)

    def run(batches):
        total: list | np.ndarray = np.zeros((d, d), np.int64)
        wide = np.zeros((d, d), object)
        held = 0.0
        for b in batches:
            y = _integers(b.column(0), d) - centre
            most = float(np.abs(y).max(initial=0)) ** 2 * max(1, len(y))
            if most < 2.0**52:  # products of floats are exact
                part = (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
            else:
                part = y.astype(object).T @ y.astype(object)
            held += most
            if part.dtype == object or held >= 2.0**62:
                wide, total, held = wide + total.astype(object) + part, np.zeros((d, d), np.int64), 0.0
            else:
                total += part
        out = (wide + total.astype(object))[upper]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(map(str, out))], ["i", "j", "part"])

    parts = rows.select(vector).mapInArrow(run, "i int, j int, part string").groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    out = [[0] * d for _ in range(d)]
    for r in parts.toLocalIterator():  # d * (d + 1) / 2 rows
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["part"])
    return out


def pivoted_cholesky(a: np.ndarray, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """L (lower triangular) and an order p of dimensions, with a[p][:, p] = L L'. Each step takes the dimension with the largest
    rest on the diagonal; it ends where that is below tolerance times the largest."""
    rest, d = a.astype(np.float64).copy(), len(a)
    p, low, rank, first = np.arange(d), np.zeros((d, d)), 0, float(np.diag(a).max(initial=0.0))
    for k in range(d):
        j = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[j, j] <= tolerance * first or rest[j, j] <= 0:
            break
        if j != k:
            rest[[k, j]], low[[k, j]], p[[k, j]] = rest[[j, k]], low[[j, k]], p[[j, k]]
            rest[:, [k, j]] = rest[:, [j, k]]
        low[k, k] = np.sqrt(rest[k, k])
        low[k + 1 :, k] = rest[k + 1 :, k] / low[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
        rank += 1
    return low[:, :rank], p


def one_sided_jacobi(low: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> np.ndarray:
    """low with its columns rotated against each other until all are at right angles. A sweep meets each pair once, in rounds of
    pairs that share no column, and each round is a few operations on matrices."""
    x, r = low.copy(), low.shape[1]
    seats = list(range(r + r % 2))  # an odd number sits out in turn
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if a < r and b < r]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            i, j = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
            u, v = x[:, i], x[:, j]
            uu, vv, uv = (u * u).sum(0), (v * v).sum(0), (u * v).sum(0)
            scale = np.sqrt(uu * vv)
            turn = np.abs(uv) > tolerance * scale
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(uv[turn]) / scale[turn]).max()))
            z = (vv - uu)[turn] / (2 * uv[turn])
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            u, v = u[:, turn].copy(), v[:, turn].copy()
            x[:, i[turn]], x[:, j[turn]] = c * u - s * v, s * u + c * v
        if worst < 4 * tolerance:
            break
    return x


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of a positive semidefinite matrix; of those that do not vanish."""
    low, p = pivoted_cholesky(scatter)
    x = one_sided_jacobi(low)
    norms = np.sqrt((x * x).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] ** 2 > 1e-12 * max(float(np.trace(scatter)), 5e-324)]
    vectors = np.zeros((len(scatter), len(order)))
    vectors[p] = x[:, order] / norms[order]
    return norms[order] ** 2, vectors


def fit(rows: DataFrame, vector: str = "embedding", keep: int = 8) -> dict | None:
    """The model of the usable rows: dimensions, n, sums, eigenvalues of the covariance (divisor n), components, trace."""
    d, n, sums = _sums(rows, vector)
    if not n:
        return None
    about = [(2 * s + n) // (2 * n) for s in sums]  # the rounded mean
    left = [s - n * m for s, m in zip(sums, about, strict=True)]
    products = _products(rows.where(F.size(vector) == d), vector, d, about)
    exact = [[n * products[i][j] - left[i] * left[j] for j in range(d)] for i in range(d)]  # n * scatter, in integers
    squared = n * n
    covariance = np.array([[e / squared for e in row] for row in exact])
    values, vectors = components(covariance)
    return {"d": d, "n": n, "about": about, "left": left, "values": values[:keep], "vectors": vectors[:, :keep], "trace": sum(exact[i][i] for i in range(d)) / squared}


def _whitened(y: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S as integers, and the whitened vectors."""
    n = model["n"]
    far = n * y - np.array(model["left"], np.int64) if float(np.abs(y).max(initial=0)) * n < 2.0**62 else n * y.astype(object) - np.array(model["left"], object)
    return far, (far.astype(np.float64) / n) @ model["vectors"] / np.sqrt(model["values"])


def identity_error(rows: DataFrame, model: dict, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity. Whitened rows are centred by themselves."""
    k, centre, d = len(model["values"]), np.array(model["about"], np.int64), model["d"]

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            _, w = _whitened(_integers(b.column(0), d) - centre, model)
            total += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], ["i", "j", "part"])

    parts = rows.where(F.size(vector) == d).select(vector).mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part"))
    return parts.agg(F.max(F.abs(F.col("part") / model["n"] - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whiten(embeddings: DataFrame, vector: str = "embedding", row_id: str = "vec_id", keep: int = 8) -> DataFrame:
    """A row for each usable vector and each of the first ``keep`` components: the id, component, n, deviation, whitened,
    explained, identity_error."""
    rows = usable(embeddings.select(row_id, vector), vector)
    kind = embeddings.schema[row_id].dataType.simpleString()
    schema = f"{row_id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, vector, keep)
    if model is None or not len(model["values"]):
        return embeddings.sparkSession.createDataFrame([], schema)
    error, k, d = identity_error(rows, model, vector), len(model["values"]), model["d"]
    centre, names = np.array(model["about"], np.int64), [row_id, *(x.split(" ")[0] for x in schema.split(", ")[1:])]

    def deviations(far: np.ndarray) -> pa.Array:
        if far.dtype != object and float(np.abs(far).max(initial=0)) ** 2 * d < 2.0**63:
            return pa.array((far * far).sum(1))
        sums = [sum(int(x) * int(x) for x in row) for row in far]
        return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())

    def run(batches):
        for b in batches:
            far, w = _whitened(_integers(b.column(1), d) - centre, model)
            at, m = pa.array(np.repeat(np.arange(len(w)), k)), len(w) * k
            explained = np.tile(model["values"] / model["trace"], len(w))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(m, model["n"])), deviations(far).take(at), pa.array(w.reshape(-1)), pa.array(explained), pa.array(np.full(m, error))], names)

    return rows.where(F.size(vector) == d).mapInArrow(run, schema)
