"""PCA whitening of embeddings.

Vectors become whole numbers, so counts and sums are exact. The covariance of the centred
vectors is summed over all partitions; the driver holds that one matrix, whose size follows
the dimensions and not the rows. Its leading eigenvalues come from Householder
tridiagonalisation and bisection by Sturm counts, its eigenvectors from inverse iteration with
reorthogonalisation inside clusters of close eigenvalues. The components are broadcast and
every vector is projected on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limitlens.llm import words as W
from limitlens.plans.reuse import materialized

#: Components returned; an entry c becomes floor(SCALE * c) + SHIFT.
COMPONENTS, SCALE, SHIFT = 8, 1024.0, 100_000
# Scaled entries saturate here, as a cast to long does at its ends.
_TOP = float(1 << 62)
# Whole numbers up to here are added and multiplied in 64 bits; larger ones in Python's.
_SAFE = 1 << 62
_EPSILON = float(np.finfo(np.float64).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflectors that make a symmetric matrix tridiagonal.

    Reflector k acts on the entries from k + 1 on; one of zeros does nothing.
    """
    a = np.array(matrix, np.float64)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        length = np.linalg.norm(u)
        if length == 0 or np.all(u[1:] == 0):
            reflectors.append(np.zeros(n - k - 1))
            continue
        u[0] += np.copysign(length, u[0])
        u /= np.linalg.norm(u)
        reflectors.append(u)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        q = p - u * (u @ p)
        rest -= 2 * (np.outer(u, q) + np.outer(q, u))
        column = a[k + 1 :, k] - 2 * u * (u @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = column
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of T - at * I."""
    tiny = max(float(np.max(np.abs(off), initial=0)) ** 2, 1.0) * np.finfo(np.float64).tiny / _EPSILON
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - at - e * e / pivot
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection inside Gershgorin's bounds."""
    n = len(diagonal)
    around = np.zeros(n)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    bound = max(abs((diagonal - around).min()), abs((diagonal + around).max()))
    low, high = np.full(count, (diagonal - around).min() - _EPSILON * bound), np.full(count, (diagonal + around).max() + _EPSILON * bound)
    rank = n - np.arange(count)  # eigenvalue k has n - 1 - k smaller ones
    while True:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        below = sturm_count(diagonal, off, middle) >= rank
        low, high = np.where(below, low, middle), np.where(below, middle, high)


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift * I) x = right by elimination with row exchanges; zero pivots become ``least``."""
    n = len(diagonal)
    own, above, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], right.tolist()
    solved = []  # each row from its diagonal on: three entries
    row = (own[0], above[0], 0.0)
    for i in range(n - 1):
        below = (above[i], own[i + 1], above[i + 1])
        if abs(below[0]) > abs(row[0]):
            row, below = below, row
            x[i], x[i + 1] = x[i + 1], x[i]
        row = (row[0] or least, row[1], row[2])
        factor = below[0] / row[0]
        solved.append(row)
        x[i + 1] -= factor * x[i]
        row = (below[1] - factor * row[1], below[2] - factor * row[2], 0.0)
    solved.append((row[0] if abs(row[0]) >= least else least, 0.0, 0.0))
    for i in reversed(range(n)):
        a, b, c = solved[i]
        x[i] = (x[i] - (b * x[i + 1] if i + 1 < n else 0.0) - (c * x[i + 2] if i + 2 < n else 0.0)) / a
    return np.array(x)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors, as columns, of falling eigenvalues: inverse iteration.

    Vectors of eigenvalues closer than a thousandth of the matrix's size to the one before
    belong to one cluster and are made orthogonal to all earlier ones of it in every round.
    Equal eigenvalues are moved apart by a few roundings, so that their iterations differ.
    """
    n = len(diagonal)
    size = float(max(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(off), initial=0), np.finfo(np.float64).tiny))
    rng = np.random.default_rng(17)
    vectors = np.zeros((n, len(values)))
    cluster, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            cluster = k
        shift = min(value, shift - 4 * _EPSILON * size)
        v = rng.normal(size=n)
        for _ in range(rounds):
            for _ in range(2):  # once more, for what rounding leaves
                v = v - vectors[:, cluster:k] @ (vectors[:, cluster:k].T @ v)
            v = _solve_shifted(diagonal, off, shift, v / np.linalg.norm(v), _EPSILON * size)
            v /= np.abs(v).max()
        for _ in range(2):
            v = v - vectors[:, cluster:k] @ (vectors[:, cluster:k].T @ v)
        vectors[:, k] = v / np.linalg.norm(v)
    return vectors


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    scale = float(np.abs(matrix).max(initial=0))
    if not len(matrix) or not scale:
        return np.zeros(count), np.eye(len(matrix), count)
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    vectors = tridiagonal_vectors(diagonal, off, leading_eigenvalues(diagonal, off, count))
    for k, u in reversed(list(enumerate(reflectors))):
        vectors[k + 1 :] -= 2 * np.outer(u, u @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ik,ij,jk->k", vectors, matrix, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x): rows whose vector has entries, all of them finite numbers."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(key).alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)


def _whole(column) -> np.ndarray:
    """x of each entry, end to end, as longs."""
    entries = np.asarray(column.flatten(), np.float64)
    return np.clip(np.floor(SCALE * entries), -_TOP, _TOP).astype(np.int64) + SHIFT


def _sums(usable: DataFrame) -> DataFrame:
    """(d, j, n, s): rows of d dimensions and their exact sums per dimension j."""

    def run(batches):
        seen: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            width = np.diff(np.asarray(column.offsets))
            x = _whole(column)
            owner = np.repeat(width, width)
            for d in np.unique(width).tolist():
                part = x[owner == d].reshape(-1, d)
                far = int(np.abs(part).max()) * len(part) >= _SAFE
                total = part.astype(object).sum(axis=0) if far else part.sum(axis=0).astype(object)
                held = seen.setdefault(d, [0, 0])
                held[0], held[1] = held[0] + len(part), held[1] + total
        for d, (n, total) in seen.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "j": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": [str(t) for t in total]})

    partial = W.map_batches(usable.select("x"), run, "d int, j int, n long, s string")
    return partial.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


@dataclass
class Centre:
    """Rows, exact sums and their whole and broken parts of the mean, per dimension."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.floor = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s % self.n for s in self.sums]
        self.broken = np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole parts are subtracted exactly."""
        return (x - self.floor).astype(np.float64) - self.broken

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n*x - S)**2, exact: n**2*y*y - 2*n*y*r + r*r with y = x - floor."""
        y, rest = x - self.floor, np.array(self.rest, object)
        high = int(np.abs(y).max(initial=0)) + 1
        if high * max(high, self.n) * x.shape[1] >= _SAFE:
            y = y.astype(object)
        else:
            rest = rest.astype(np.int64)
        square, cross = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist()
        last = sum(r * r for r in self.rest)
        return [self.n * (self.n * int(a) - 2 * int(b)) + last for a, b in zip(square, cross)]


def covariance(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """Covariance of x over all rows, divisor n; centred before multiplying.

    Every task adds up its rows' products; the sums of the upper triangle are added by cell.
    """
    d = len(centre.sums)
    i, j = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            z = centre.centred(_whole(batch.column(0)).reshape(-1, d))
            total += z.T @ z
        for cut in range(0, len(i), 1 << 14):
            at = slice(cut, cut + (1 << 14))
            yield pa.RecordBatch.from_arrays([pa.array((i[at] * d + j[at]).astype(np.int64)), pa.array(total[i[at], j[at]])], ["cell", "value"])

    cells = W.map_batches(vectors.select("x"), run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((d, d))
    out.ravel()[cells["cell"].to_numpy()] = cells["value"].to_numpy() / centre.n
    return out + np.triu(out, 1).T


def _identity_error(table: DataFrame, n: int, count: int) -> float | None:
    """Largest entry of the covariance of the whitened columns minus the identity."""
    if not count:
        return None
    column = [F.col("whitened")[k] for k in range(count)]
    means = table.agg(*[F.sum(c).alias(f"m{k}") for k, c in enumerate(column)]).first()
    centred = [c - means[k] / n for k, c in enumerate(column)]
    pairs = [(a, b) for a in range(count) for b in range(a + 1)]
    sums = table.agg(*[F.sum(centred[a] * centred[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(s / n - (a == b)) for (a, b), s in zip(pairs, sums))


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact).

    Rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so
    are those of another length than the most frequent one (the longest of equally frequent
    ones). Scaled entries beyond 2**62 saturate there. deviation is null where it passes a
    long, deviation_exact where it passes 38 digits. A component without variance (all vectors
    equal, fewer independent vectors than components) has a null whitened and explained 0,
    or null where nothing varies; identity_error covers the others and is null without any.
    Repeated rows and rows without id count and return like others; further columns are
    ignored. No usable row: no rows.
    """
    spark = df.sparkSession
    usable = _usable(df, key, vector)
    sums = materialized(_sums(usable))
    found = sums.filter("j = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if found is None:
        return spark.createDataFrame([], _SCHEMA)
    n, d = found["n"], found["d"]
    rows = sums.filter(F.col("d") == d).orderBy("j").collect()  # a row per dimension
    centre = Centre(n, [int(r["s"]) for r in rows])
    vectors = usable.filter(F.size("x") == d)
    matrix = covariance(vectors, centre)
    count = min(components, d)
    values, axes = leading_components(matrix, count)
    trace = float(np.trace(matrix))
    real = int((values > d * _EPSILON * max(values[0], 0)).sum()) if trace > 0 else 0
    held = spark.sparkContext.broadcast((centre, axes[:, :real] / np.sqrt(values[:real])))

    def project(batches):
        where, scaled = held.value
        for batch in batches:
            x = _whole(batch.column(1)).reshape(-1, d)
            out = np.full((len(x), count), np.nan)
            out[:, :real] = where.centred(x) @ scaled
            flat = pa.array(out.ravel(), from_pandas=True)  # NaN becomes null
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(t) for t in where.deviations(x)]), pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "deviation", "whitened"])

    projected = W.map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x"), project, "vec_id long, deviation string, whitened array<double>")
    table = materialized(projected)
    error = _identity_error(table, n, real)
    explained = F.array(*[F.lit(max(float(v), 0.0) / trace if k < real else 0.0 if trace > 0 else None).cast("double") for k, v in enumerate(values)])
    return table.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", explained[F.col("k")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation_exact"),
    )
