"""Whitening of embeddings by their leading components, found by contour integration.

Entries are taken as whole numbers, x = floor(scale * entry). Every distinct x vector is once in the fit list; its
size, sums and covariance are gathered by Spark, a row of the matrix for each task and dimension, so that the driver
holds no more than dimension x dimension numbers. The covariance is centred before multiplying, and its sums of
whole numbers are exact.

The components of the symmetric matrix are found by FEAST: the number of eigenvalues above a shift is the inertia of
the shifted matrix, read off its tridiagonal form, and bisection on it gives an interval that holds the wanted
eigenvalues and a gap below them. Quadrature over a circle through the interval's ends, of solutions of complex
shifted systems, projects a block of vectors onto their eigenvectors; Rayleigh-Ritz extracts them, and is repeated
on its own vectors until the residual is at rounding. That as many were found as the inertia says is checked.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are rows
whose vector has another length than most (the longer if equally many); entries beyond the range of long take its
ends; repeated rows count once in the fit list and get a result each; components without variance beyond rounding
are not returned, so that a table without two different vectors gives no rows; of equal eigenvalues any orthogonal
components are returned; a deviation beyond the range of long is null; an empty table gives an empty table; further
columns are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, stored

SCALE, COMPONENTS = 256, 4
MOST = 2**63 - 1
POINTS, ROUNDS = 8, 30


def whole(vectors: pa.Array, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an array of lists count, and their entries as whole numbers."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    owner = pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
    good = lengths == length
    good[owner[~np.isfinite(values)]] = False
    entries = np.floor(scale * values[good[owner]].reshape(-1, length))
    x = np.clip(entries, -(2.0**63), 2.0**62 * (2 - 2**-52)).astype(np.int64)
    x[entries >= 2.0**63] = MOST
    return good, x


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: two for each entry where all of the row fit, else eight."""
    short = ((x >= -(2**15)) & (x < 2**15)).all(1)
    return [(row.astype("<i2") if s else row.astype("<i8")).tobytes() for row, s in zip(x, short)]


def unpacked(rows: list[bytes], length: int) -> np.ndarray:
    out = np.zeros((len(rows), length), np.int64)
    short = np.array([len(r) == 2 * length for r in rows], bool)
    for kind, own in (("<i2", short), ("<i8", ~short)):
        if own.any():
            out[own] = np.frombuffer(b"".join(r for r, o in zip(rows, own) if o), kind).reshape(-1, length)
    return out


def tridiagonal(a: np.ndarray) -> tuple[list[float], list[float]]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
        a[k, k + 1 :] = a[k + 1 :, k]
    return a.diagonal().tolist(), a.diagonal(-1).tolist()


def above(form: tuple[list[float], list[float]], shift: float, tiny: float) -> int:
    """How many eigenvalues are above `shift`: the positive pivots of the shifted matrix."""
    n, pivot = 0, 1.0
    for d, e in zip(form[0], [0.0, *form[1]]):
        pivot = d - shift - e * e / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        n += pivot > 0
    return n


def eigenvalue(form: tuple[list[float], list[float]], k: int, low: float, high: float, tiny: float) -> float:
    """The k-th largest eigenvalue, by bisection on the inertia."""
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (middle, high) if above(form, middle, tiny) >= k else (low, middle)
    return low


def feast(v: np.ndarray, low: float, high: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues between low and high, falling, and their eigenvectors as columns."""
    n, scale = len(v), np.abs(v).max()
    block = min(n, max(wanted + 4, 3 * wanted // 2))
    y = np.random.default_rng(n).standard_normal((n, block))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(0.5j * np.pi * (1 - nodes))
    centre, radius = (low + high) / 2, (high - low) / 2
    last = np.inf
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for t, w in zip(turns, weights):
            q += w / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - v, y)).real
        q, _ = np.linalg.qr(q)
        ritz, small = np.linalg.eigh(q.T @ v @ q)
        y = q @ small
        inside = np.flatnonzero((ritz > low) & (ritz < high))[::-1]
        residual = np.abs(v @ y[:, inside] - ritz[inside] * y[:, inside]).max(initial=0) if len(inside) == wanted else np.inf
        if residual <= 4e-16 * n * scale and residual >= last / 2:  # at rounding, and better no more
            break
        last = residual
    if len(inside) != wanted:
        raise ArithmeticError(f"{len(inside)} eigenvalues found where the inertia says {wanted}")
    return ritz[inside], y[:, inside]


def leading(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are above rounding, at most `components`, and their eigenvectors."""
    n, bound = len(v), float(np.abs(v).sum(1).max())
    if not bound:
        return np.zeros(0), np.zeros((n, 0))
    v = v / bound  # eigenvalues from -1 to 1
    form, tiny, rounding = tridiagonal(v), 1e-300, 1e-15 * n
    high = eigenvalue(form, 1, -1.1, 1.1, tiny)
    real = min(components, above(form, rounding * high, tiny))
    if not real:
        return np.zeros(0), np.zeros((n, 0))
    # the interval ends in a gap, so that no eigenvalue that equals a wanted one to rounding is left outside
    last, following = eigenvalue(form, real, -1.1, 1.1, tiny), -0.1
    wanted = real
    while wanted < n:
        following = eigenvalue(form, wanted + 1, -1.1, 1.1, tiny)
        if last - following > 1e3 * rounding * high:
            break
        wanted, last, following = wanted + 1, following, -0.1
    values, vectors = feast(v, (last + following) / 2, high + (high - (last + following) / 2) / 8, wanted)
    return values[:real] * bound, vectors[:, :real]


@dataclass
class Fit:
    length: int
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - sum) squared, in whole numbers."""
        most = self.n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, self.sums))
        if self.length * most**2 <= MOST:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1).tolist()
        return [e if e <= MOST else None for e in exact]


def rows_of(df: DataFrame, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id and x (packed) of the rows that count, stored, and their length."""
    bounded_batches(df.sparkSession)
    given = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    lengths = given.filter("size(vector) > 0").groupBy(F.size("vector").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    length = most["length"] if most else 1

    def cut(batches):
        claim("whitening")
        for b in batches:
            vectors = b.column("vector")
            good, x = whole(vectors, length, scale)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(good)), pa.array(packed(x), pa.binary())], names=["vec_id", "x"])

    kind = given.schema["vec_id"].dataType.simpleString()
    return stored(given.mapInArrow(cut, f"vec_id {kind}, x binary"), "whole-vectors"), length


def summed(fit_list: DataFrame, length: int, of) -> dict[int, np.ndarray]:
    """Sums over all tasks of the rows of the matrix that `of` makes of a batch of x vectors, added up task by task."""

    def part(batches):
        claim("whitening")
        total = None
        for b in batches:
            if b.num_rows:
                own = of(unpacked(b.column("x").to_pylist(), length))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.from_numpy_dtype(total.dtype)))], names=["i", "row"])

    def merge(group):
        rows = np.array(group.column("row").to_pylist()).sum(0)  # a row a task
        return pa.table({"i": group.column("i").slice(0, 1), "row": pa.array([rows.tolist()], group.schema.field("row").type)})

    kind = "array<bigint>" if of(np.zeros((1, length), np.int64)).dtype == np.int64 else "array<double>"
    parts = fit_list.mapInArrow(part, f"i int, row {kind}").groupBy("i").applyInArrow(merge, f"i int, row {kind}")
    return {i: np.array(row) for i, row in parts.collect()}


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> Fit | None:
    """The fit of the distinct x vectors of rows_of(), or None where there are none."""
    fit_list = stored(rows.select("x").distinct(), "fit-list")
    n = fit_list.count()
    if not n:
        return None
    # high and low halves by themselves: exact whatever the entries are
    halves = summed(fit_list, length, lambda x: np.array([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]))
    found = Fit(length, n, [(int(h) << 32) + int(low) for h, low in zip(halves[0], halves[1])], np.zeros(0), np.zeros((length, 0)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        y = found.centred(x)
        return y.T @ y

    matrix = summed(fit_list, length, products)
    v = np.array([matrix[i] for i in range(length)]) / n
    v = (v + v.T) / 2
    values, vectors = leading(v, components)
    found = Fit(length, n, found.sums, values, vectors, float(np.trace(v)))
    if len(values):

        def moments(x: np.ndarray) -> np.ndarray:
            w = found.whitened(x)
            return np.vstack([w.T @ w, w.sum(0)])

        rows_ = summed(fit_list, length, moments)
        mean = rows_[len(values)] / n
        cov = np.array([rows_[i] for i in range(len(values))]) / n - np.outer(mean, mean)
        found.identity_error = float(np.abs(cov - np.eye(len(values))).max())
    return found


def whitened(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row that counts and component."""
    rows, length = rows_of(df, scale, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(rows, length, components)
    if found is None or not len(found.values):
        return df.sparkSession.createDataFrame([], schema)
    share = found.values / found.trace

    def project(batches):
        claim("whitening")
        k = len(found.values)
        for b in batches:
            x = unpacked(b.column("x").to_pylist(), length)
            at = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(found.deviations(x), pa.int64())
            columns = [b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), found.n)), deviation.take(pa.array(at))]
            columns += [pa.array(found.whitened(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(at), found.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
