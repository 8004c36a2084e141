"""Embedding whitening by a bidiagonal qd solver.

Vectors are taken as integers, ``floor(scale * c) + offset``, so that counts, sums and deviations are exact. Centred
rows are reduced block by block to a triangular factor R (QR of each block stacked on the factor so far); the factors
of all tasks meet in a tree. Householder reflections bring R to bidiagonal form, dqds finds the singular values to
high relative accuracy, twisted factorisations give their right singular vectors, and the reflections carry these back:
the eigenvectors of the covariance, which is never formed.

A task holds one block and one factor of ``width`` squared numbers; the driver holds one factor. Nothing else grows.

Defined cases: a null vector and one with a null or non-finite entry is left out, as is one with an entry too large
for exact arithmetic (``LARGEST`` after scaling); of vectors of unlike lengths those of the commonest length (of
equally common ones the greatest) make the fit list and the others are left out; directions without variance are no
components, so one row, equal rows and an empty table give no rows; rows with a null id and repeated rows count
like any other; other columns are ignored. A deviation beyond the range of a long is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import folded, matrix

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Rows of a block stacked on the factor before it is reduced again.
BLOCK = 4096
#: Scaled entries from here on are not exact in double precision.
LARGEST = 1 << 50
#: Relative gap of neighbouring eigenvalues below which their vectors are made orthogonal one by one.
CLOSE = 1e-6
EPS = float(np.finfo(np.float64).eps)


class Whitening(NamedTuple):
    """Fit over ``n`` vectors of ``width`` entries: sums, unit directions (columns) and their eigenvalues, falling."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int
    offset: int
    #: Greatest and least entry: whether 64-bit deviations can overflow.
    spread: int

    @property
    def width(self) -> int:
        return len(self.sums)


def usable(vector: Column, scale: int = SCALE) -> Column:
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST)
    return F.coalesce(F.forall(vector, entry), F.lit(False))


# ---- the small dense part, on one triangular factor -----------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """``v, beta, alpha``: the reflection ``1 - beta v v'`` that takes ``x`` to ``(alpha, 0, ...)``."""
    v = x.copy()
    norm = float(np.linalg.norm(x))
    if norm == 0 or len(x) == 1:
        return np.zeros_like(v), 0.0, float(x[0])
    alpha = -math.copysign(norm, float(x[0]))
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal, and ``p`` with ``r = u b p'`` (``u`` is not needed)."""
    a, d = r.copy(), r.shape[1]
    right = []
    for k in range(d):
        v, beta, alpha = _reflector(a[k:, k])
        if beta:
            a[k:, k + 1 :] -= np.outer(beta * v, v @ a[k:, k + 1 :])
        a[k:, k], a[k, k] = 0, alpha
        if k < d - 1:
            v, beta, alpha = _reflector(a[k, k + 1 :])
            if beta:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k + 1 :] @ v, beta * v)
            a[k, k + 1 :], a[k, k + 1] = 0, alpha
            right.append((k + 1, v, beta))
    p = np.eye(d)
    for k, v, beta in reversed(right):
        if beta:
            p[k:, k:] -= np.outer(beta * v, v @ p[k:, k:])
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _shifted(q: list[float], e: list[float], n: int, shift: float) -> tuple[list[float], list[float], float, bool]:
    """One dqds step: new ``q, e``, the least ``d`` and whether it is the last one; stops early when ``d`` is negative."""
    new_q, new_e = [0.0] * n, [0.0] * n
    d = least = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return new_q, new_e, d, False
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e[i] = e[i] * ratio
        # with nothing left in this row the next one stands alone
        d = (d * ratio if new_q[i] else q[i + 1]) - shift
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least, least == d


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, each to high relative accuracy."""
    q, e = (diagonal * diagonal).tolist(), [*(above * above).tolist(), 0.0]
    tolerance, n, sigma, found, guess = (10 * EPS) ** 2, len(q), 0.0, [], 0.0
    while n:
        if n == 1 or e[n - 2] <= tolerance * (sigma + q[n - 1]):
            found.append(sigma + q[n - 1])
            n -= 1
            guess = 0.0
            continue
        shift, tries = guess, 0
        while True:
            new_q, new_e, least, at_end = _shifted(q, e, n, shift)
            if least >= 0:
                break
            # a failure at the very end says how far the shift went too far
            tries += 1
            shift = 0.0 if tries > 3 else max(0.0, (shift + least) * (1 - 4 * EPS)) if at_end else shift / 4
        q[:n], e[: n - 1] = new_q, new_e[: n - 1]
        sigma += shift
        if at_end and n > 1:
            x, y, off = q[n - 2] + (e[n - 3] if n > 2 else 0.0), q[n - 1] + e[n - 2], q[n - 2] * e[n - 2]
            half = (x - y) / 2
            guess = max(0.0, y - off / (abs(half) + math.sqrt(half * half + off))) if off and half > 0 else least / 4
        else:
            guess = least / 4
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, eigenvalue: float, twist: int = 0) -> np.ndarray:
    """Unit eigenvector of ``b'b`` by a twisted factorisation of ``b'b - eigenvalue``.

    The factorisations from the top and from the bottom meet at the row with the least remainder (or, for a further
    vector of a cluster, the row with the ``twist``-th least).
    """
    n = len(diagonal)
    square, cross, high = diagonal * diagonal, diagonal[:-1] * above, above * above
    tiny = (EPS * max(float(np.abs(diagonal).max()), 1e-150)) ** 2
    top, bottom = np.empty(n), np.empty(n)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    top[0] = -eigenvalue
    for i in range(n - 1):
        pivot = top[i] + square[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = cross[i] / pivot
        top[i + 1] = high[i] * top[i] / pivot - eigenvalue
    bottom[n - 1] = square[n - 1] - eigenvalue
    for i in range(n - 2, -1, -1):
        pivot = high[i] + bottom[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        up[i] = cross[i] / pivot
        bottom[i] = square[i] * bottom[i + 1] / pivot - eigenvalue
    k = int(np.argsort(np.abs(top + bottom + eigenvalue), kind="stable")[min(twist, n - 1)])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _block_vectors(diagonal: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and vectors (columns) of ``b'b`` for a bidiagonal without negligible entries above."""
    values, n = dqds(diagonal, above), len(diagonal)
    vectors = np.empty((n, n))
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLOSE * values[i - 1]:
            first = i
        z = twisted(diagonal, above, value)
        for twist in range(1, n + 1):
            # within a cluster only what no earlier vector of it has; a vector that has nothing left gives way
            if first == i:
                break
            rest = z
            for _ in range(2):
                rest = rest - vectors[:, first:i] @ (vectors[:, first:i].T @ rest)
            norm = float(np.linalg.norm(rest))
            if norm > 1e-3:
                z = rest / norm
                break
            z = twisted(diagonal, above, value, twist)
        vectors[:, i] = z
    return values, vectors


def principal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``r'r``, falling, and unit eigenvectors as columns; directions without variance are left out."""
    diagonal, above, p = bidiagonalise(r)
    limit = EPS * (np.abs(diagonal[:-1]) + np.abs(diagonal[1:]))
    cuts = [0, *(np.flatnonzero(np.abs(above) <= limit) + 1).tolist(), len(diagonal)]
    values, vectors = [], []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        some, z = _block_vectors(diagonal[s:e], above[s : e - 1])
        whole = np.zeros((len(diagonal), e - s))
        whole[s:e] = z
        values.append(some), vectors.append(whole)
    value, vector = np.concatenate(values), np.concatenate(vectors, 1)
    order = np.argsort(-value, kind="stable")
    value, vector = value[order], vector[:, order]
    real = value > (len(diagonal) * EPS) ** 2 * value[0] if value[0] > 0 else np.zeros(len(value), bool)
    return value[real], p @ vector[:, real]


# ---- over all rows ----------------------------------------------------------------------


def _integers(column: pa.Array, scale: int, offset: int) -> np.ndarray:
    return np.floor(scale * matrix(column).astype(np.float64)).astype(np.int64) + offset


def _tasks(rows: DataFrame, work) -> DataFrame:
    """``part, state``: what ``work`` makes of the batches of each task; nothing of a task without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = work(b for b in batches if b.num_rows)
        if state is not None:
            part = [TaskContext.get().partitionId()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([state], pa.binary())], ["part", "state"])

    return rows.mapInArrow(run, "part long, state binary")


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n``, from the mean's whole and broken part so that nothing is lost."""
    mean = sums // n
    return (x - mean) - (sums - mean * n) / n


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _reduced(blocks: Iterator[np.ndarray]) -> bytes | None:
    factor = None
    for rows in blocks:
        factor = _triangle(rows if factor is None else np.concatenate([factor, rows]))
    return None if factor is None else factor.tobytes()


def _moments(blocks: Iterator[np.ndarray]) -> bytes | None:
    """Count, means and centred products, merged block by block."""
    state = None
    for y in blocks:
        mean = y.mean(0)
        part = (len(y), mean, (y - mean).T @ (y - mean))
        state = part if state is None else _together(state, part)
    return None if state is None else _packed(state)


def _together(a: tuple, b: tuple) -> tuple:
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _packed(state: tuple) -> bytes:
    return np.concatenate([[state[0]], state[1], state[2].ravel()]).tobytes()


def fit(
    vectors: DataFrame,
    vector: str = "embedding",
    scale: int = SCALE,
    offset: int = OFFSET,
    components: int = COMPONENTS,
) -> Whitening | None:
    """Whitening over all usable rows of ``vectors``, or None where there is no variance."""
    rows = vectors.filter(usable(F.col(vector), scale)).select(F.col(vector).alias("v"))
    widths = rows.groupBy(F.size("v").alias("width")).count().filter("width > 0")
    common = widths.orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return None
    width, n = common["width"], common["count"]
    rows = rows.filter(F.size("v") == width)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, low, high = np.zeros(width, np.int64), None, None
        for b in batches:
            if b.num_rows:
                x = _integers(b.column(0), scale, offset)
                sums += x.sum(0)
                least, most = x.min(0), x.max(0)
                low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
        if low is not None:
            columns = [np.arange(width, dtype=np.int32), sums, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "total", "low", "high"])

    sums = rows.mapInArrow(totals, "at int, total long, low long, high long").groupBy("at")
    found = sums.agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    found.sort(key=lambda r: r["at"])
    total = np.array([r["total"] for r in found], np.int64)
    spread = max(r["high"] - r["low"] for r in found)

    def reduce(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        def blocks() -> Iterator[np.ndarray]:
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    yield _centred(_integers(b.column(0).slice(at, BLOCK), scale, offset), n, total)

        return _reduced(blocks())

    def merge(states: Iterator[bytes]) -> bytes:
        return _reduced(np.frombuffer(s, np.float64).reshape(-1, width) for s in states)

    factor = np.zeros((width, width))
    r = np.frombuffer(folded(_tasks(rows, reduce), merge, "factors"), np.float64).reshape(-1, width)
    factor[: len(r)] = r
    values, directions = principal(factor)
    if not len(values):
        return None
    trace = float((factor * factor).sum()) / n
    return Whitening(n, total, directions[:, :components], values[:components] / n, trace, scale, offset, spread)


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ (model.directions / np.sqrt(model.eigenvalues))


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    mean = model.sums // model.n
    rest = model.sums - mean * model.n
    if (model.n * (model.spread + 1)) ** 2 * model.width < 1 << 63:
        d = model.n * (x - mean) - rest
        return (d * d).sum(1).tolist()
    exact = ((x - mean).astype(object) * model.n - rest.astype(object)) ** 2
    return [v if v < 1 << 63 else None for v in exact.sum(1).tolist()]


def _fitting(vectors: DataFrame, vector: str, model: Whitening) -> DataFrame:
    v = F.col(vector)
    return vectors.filter(usable(v, model.scale) & (F.size(v) == model.width))


def transform(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, deviation, whitened`` (one number per component) of each usable row."""
    kind = vectors.select(key).dtypes[0][1]
    rows = _fitting(vectors, vector, model).select(F.col(key).alias("k"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _integers(b.column(1), model.scale, model.offset)
                y = _whitened(x, model)
                ends = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(y.ravel()))
                columns = [b.column(0), pa.array(_deviations(x, model), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, [key, "deviation", "whitened"])

    return rows.mapInArrow(run, f"`{key}` {kind}, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over all rows."""
    rows, k = _fitting(vectors, vector, model).select(F.col(vector).alias("v")), len(model.eigenvalues)

    def measure(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        return _moments(_whitened(_integers(b.column(0), model.scale, model.offset), model) for b in batches)

    def merge(states: Iterator[bytes]) -> bytes:
        held = None
        for s in states:
            a = np.frombuffer(s, np.float64)
            part = (a[0], a[1 : k + 1], a[k + 1 :].reshape(k, k))
            held = part if held is None else _together(held, part)
        return _packed(held)

    a = np.frombuffer(folded(_tasks(rows, measure), merge, "moments"), np.float64)
    return float(np.abs(a[k + 1 :].reshape(k, k) / a[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """One row per usable vector and component: ``key, component, n, deviation, whitened, explained, identity_error``."""
    model = fit(vectors, vector, **how)
    kind = vectors.select(key).dtypes[0][1]
    if model is None:
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}")
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.eigenvalues])
    rows = transform(vectors, model, key, vector).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        key,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(identity_error(vectors, model, vector)).alias("identity_error"),
    )
