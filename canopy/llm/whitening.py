"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Components become integers, ``floor(1024 c) + 100000``, so sums are exact. Two passes over the rows give
their count and sums, then the scatter around the mean rounded to integers; what rounding left out
is put right in exact integers. The scatter has as many entries as a vector has components
squared, whatever the number of rows; that matrix is all the driver sees. There it is factored,
``P V P' = L L'`` with the greatest remaining diagonal as pivot, and columns of ``L`` are rotated
pairwise until all are orthogonal: their norms squared are the eigenvalues of ``V``, their
directions the components. Working on the factor instead of on ``V`` keeps small eigenvalues
accurate. A third pass measures the covariance of the whitened rows, the last one returns them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import map_rows

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Products of integers are summed as doubles while the sum stays below this, which is exact.
EXACT = 1 << 53
LONG = 1 << 63
LIMB = 10**18


def finite(vector: Column) -> Column:
    """Not null, and all entries present and finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def integers(rows: list, size: int) -> np.ndarray:
    """``floor(1024 c) + 100000`` of each entry as int64; beyond the range of long it stays at its ends."""
    x = np.floor(np.array(rows, np.float64).reshape(len(rows), size) * SCALE)
    edge = float(1 << 62)
    return np.clip(x, -edge, edge).astype(np.int64) + OFFSET


def products(y: np.ndarray) -> np.ndarray:
    """``y' y`` of an integer matrix, exactly, as Python integers."""
    size = y.shape[1]
    total = np.zeros((size, size), object)
    top = int(max(y.max(initial=0), -y.min(initial=0)))
    if top * top >= EXACT:
        wide = y.astype(object)
        return total + wide.T @ wide
    step = max(1, (EXACT - 1) // max(1, top * top))
    for lo in range(0, len(y), step):
        part = y[lo : lo + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(vectors: DataFrame, size: int) -> dict[int, int]:
    def task(batches: Iterator[dict]) -> Iterator[dict]:
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = integers(batch["v"], size)
            n += len(x)
            narrow = float(np.abs(x).max(initial=0)) * len(x) < LONG / 2
            total = total + (x if narrow else x.astype(object)).sum(0).astype(object)
        yield {"at": [-1, *range(size)], "total": [n, *total.tolist()]}

    return _added(vectors.select("v"), task)


def _scatter(vectors: DataFrame, size: int, middle: list[int]) -> dict[int, int]:
    def task(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros((size, size), object)
        for batch in batches:
            total = total + products(integers(batch["v"], size) - np.array(middle, np.int64))
        low = np.tril_indices(size)
        yield {"at": (low[0] * size + low[1]).tolist(), "total": total[low].tolist()}

    return _added(vectors.select("v"), task)


def _added(vectors: DataFrame, task: Callable[[Iterator[dict]], Iterator[dict]]) -> dict[int, int]:
    """Exact sums, by place, of the integers that each task gives; high and low digits are added apart."""

    def limbs(batches: Iterator[dict]) -> Iterator[dict]:
        for out in task(batches):
            high, low = zip(*(divmod(int(t), LIMB) for t in out["total"]))
            yield {"at": out["at"], "high": [str(h) for h in high], "low": list(low)}

    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    added = map_rows(vectors, "at int, high string, low long", limbs).groupBy("at").agg(*sums)
    return {r["at"]: int(r["high"]) * LIMB + int(r["low"]) for r in added.collect()}


@dataclass(frozen=True)
class Moments:
    """Count, sums per dimension, and ``n * n`` times the covariance, as exact integers."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    def covariance(self) -> np.ndarray:
        square = self.n * self.n
        return np.array([[float(Fraction(int(c), square)) for c in row] for row in self.scatter])


def moments(vectors: DataFrame, size: int) -> Moments:
    """Exact moments of the rows' vectors (column ``v``, all of length ``size``)."""
    found = _sums(vectors, size)  # size + 1 numbers
    n, sums = found.get(-1, 0), [found.get(i, 0) for i in range(size)]
    if not n:
        return Moments(0, sums, np.zeros((size, size), object))
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([s - n * m for s, m in zip(sums, middle)], object)
    around = np.zeros((size, size), object)
    for at, total in _scatter(vectors, size, middle).items():  # size * (size + 1) / 2 numbers
        i, j = divmod(at, size)
        around[i, j] = around[j, i] = total
    return Moments(n, sums, n * around - np.outer(rest, rest))


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` (dimensions by rank, rows in the order of ``v``) with ``L L' = v``.

    The pivot is the greatest remaining diagonal, the first of equal ones; it ends when what
    remains is rounding error.
    """
    size = len(v)
    rest = v.astype(np.float64).copy()
    columns = []
    diagonal = np.diag(rest).copy()
    floor = size * np.finfo(float).eps * max(diagonal.max(initial=0.0), 0.0)
    done = np.zeros(size, bool)
    for _ in range(size):
        pivot = int(np.argmax(np.where(done, -np.inf, diagonal)))
        if diagonal[pivot] <= floor:
            break
        column = rest[:, pivot] / np.sqrt(diagonal[pivot])
        column[done] = 0.0
        columns.append(column)
        rest -= np.outer(column, column)
        diagonal = np.diag(rest).copy()
        done[pivot] = True
    return np.stack(columns, 1) if columns else np.zeros((size, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of ``factor factor'``.

    Disjoint pairs of columns are rotated together, in round-robin order, until every pair is
    orthogonal to working precision.
    """
    w = factor.astype(np.float64).copy()
    width = w.shape[1]
    seats = list(range(width)) + ([-1] if width % 2 else [])
    tolerance = np.finfo(float).eps * max(1, len(w)) ** 0.5
    for _ in range(sweeps if width > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if a >= 0 and b >= 0]
            p, q = (np.array(side) for side in zip(*pairs))
            a, b = w[:, p], w[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            off = np.abs(ab) / np.where(size > 0, size, 1.0)
            worst = max(worst, float(off.max()))
            turn = off > tolerance
            zeta = (bb - aa) / np.where(turn, 2 * ab, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            w[:, p], w[:, q] = c * a - c * t * b, c * t * a + c * b
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= tolerance:
            break
    norms = np.sqrt((w * w).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, w[:, order] / norms[order]


@dataclass(frozen=True)
class Whitening:
    """The means (as count and exact sums), eigenvalues, unit components as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n x - sums``, exact (int64, or Python integers where that is too small), and ``x`` minus the mean."""
        top = max(int(max(x.max(initial=0), -x.min(initial=0))) * self.n, *(abs(s) for s in self.sums), 0)
        kind = np.int64 if 2 * top < LONG else object
        z = x.astype(kind) * self.n - np.array(self.sums, kind)
        return z, (z / self.n).astype(np.float64)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.values)


def deviations(z: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null where it is beyond the range of long."""
    top = float(max(z.max(initial=0), -z.min(initial=0)))
    if z.dtype != object and top * top * z.shape[1] < LONG / 2:
        return (z * z).sum(1).tolist()
    return [s if (s := sum(int(e) ** 2 for e in row)) < LONG else None for row in z.tolist()]


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the rows' vectors; as many components as asked for, or as the rank allows."""
    m = moments(vectors, size) if size else Moments(0, [], np.zeros((0, 0), object))
    if not m.n:
        return Whitening(0, m.sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    v = m.covariance()
    values, directions = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(m.n, m.sums, values[:components], directions[:, :components], float(np.trace(v)))


def identity_error(vectors: DataFrame, size: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Each task centres its own rows before it multiplies; means and products of tasks are then
    put together. One small row per task and pair of components is added up.
    """
    width = len(model.values)
    if not width:
        return 0.0

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        n, mean, scatter = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = model.project(model.centred(integers(batch["v"], size))[1])
            if not len(w):
                continue
            own = w.mean(0)
            away = w - own
            apart = own - mean
            both = n + len(w)
            scatter += away.T @ away + np.outer(apart, apart) * (n * len(w) / both)
            mean = mean + apart * (len(w) / both)
            n = both
        if n:
            low = np.tril_indices(width)
            at = list(range(-width, 0)) + (low[0] * width + low[1]).tolist()
            # A task's products around its own mean, and what its mean adds around the common one.
            yield {"at": at, "total": [*(n * mean).tolist(), *(scatter + n * np.outer(mean, mean))[low].tolist()]}

    partial = map_rows(vectors.select("v"), "at int, total double", task)
    total = {r["at"]: r["total"] for r in partial.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    mean = np.array([total[i - width] for i in range(width)]) / model.n
    worst = 0.0
    for i in range(width):
        for j in range(i + 1):
            worst = max(worst, abs(total[i * width + j] / model.n - mean[i] * mean[j] - (i == j)))
    return worst


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of the vectors (column ``v``), of equally frequent ones the greatest; 0 if none."""
    lengths = vectors.groupBy(F.size("v").alias("size")).count().where("size > 0")
    top = lengths.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error: one row per vector and component.

    Vectors that are null or hold null or non-finite entries are left out, as are empty ones and
    those that do not have the table's most frequent length. Fewer components come back where the
    covariance has a smaller rank, none for fewer than two different vectors. Rows with a null or
    repeated key count and come back as often as they occur. A deviation beyond the range of
    long is null.
    """
    kind = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    wide = rows.select(F.col(key).alias("key"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    wide = wide.where(finite(F.col("v")))
    size = dimension(wide)
    wide = wide.where(F.size("v") == size)
    model = fit(wide, size, components)
    error = identity_error(wide, size, model)
    width = len(model.values)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            z, centred = model.centred(integers(batch["v"], size))
            w = model.project(centred)
            far = deviations(z)
            yield {
                "key": [k for k in batch["key"] for _ in range(width)],
                "component": list(range(1, width + 1)) * len(far),
                "n": [model.n] * (width * len(far)),
                "deviation": [d for d in far for _ in range(width)],
                "whitened": w.ravel().tolist(),
                "explained": (model.values / model.trace).tolist() * len(far) if width else [],
                "identity_error": [error] * (width * len(far)),
            }

    kind = rows.schema[key].dataType.simpleString()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = map_rows(wide, f"key {kind}, {schema}", task)
    return found.withColumnRenamed("key", key)
