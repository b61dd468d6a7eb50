"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries c become whole numbers x = floor(1024 c) + 100000.  The scatter of
the centred vectors is factored by a Cholesky decomposition with diagonal
pivoting, which also gives the rank; one-sided Jacobi rotations then make
the columns of the triangular factor orthogonal.  The squared norms of the
rotated columns are the scatter's eigenvalues, the normalised columns its
eigenvectors: neither the scatter nor the factor is multiplied out again,
so small eigenvalues keep their accuracy.

Passes over the table, each of the two columns needed only: (1) exact sums
per dimension, added up as longs by a grouped aggregate; (2) the scatter
about the exact means, one d x d partial per task, added up in two levels
so that no task reads the partials of all tasks at once; (3) the covariance
of the whitened vectors, which gives ``identity_error``; (4) the result.
Only d x d figures, whatever the number of rows, come to the driver.

Defined results: rows whose vector is null or holds a null, NaN or infinite
entry are dropped; an empty vector and one shorter than the longest are
taken as followed by zeros; entries beyond +-2**31 / 1024 count as that
bound; repeated rows and repeated or null ids give one result row each;
``deviation`` is null where it exceeds a long; components whose eigenvalue
is zero (constant dimensions, fewer vectors than dimensions) are whitened
to null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_tasks

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 31)      # of |floor(1024 c)|
COMPONENTS = 8
MAX_SWEEPS = 60               # Jacobi needs about ten; reaching this raises


@dataclass(frozen=True)
class Whitening:
    """n vectors; per dimension the exact sum of x - 100000; eigenvalues of the
    covariance (falling) and unit eigenvectors as columns; the covariance's trace."""
    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, y: np.ndarray) -> np.ndarray:
        """Exact n * (x - mean), whole numbers."""
        return self.n * y - self.sums

    def whiten(self, y: np.ndarray, k: int) -> np.ndarray:
        """Rows of whitened values of the first k components (zero eigenvalue: NaN)."""
        out = np.full((len(y), k), np.nan)
        r = min(k, len(self.eigenvalues))
        out[:, :r] = self.centred(y) / self.n @ (self.components[:, :r] / np.sqrt(self.eigenvalues[:r]))
        return out


# -- linear algebra on one d x d matrix -----------------------------------------

def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G with G G' = a (positive semidefinite) and one column per rank; its
    rows, taken in pivot order, form a lower triangle."""
    d = len(a)
    g, rest = np.zeros((d, d)), np.array(np.diag(a), float)
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    taken = np.zeros(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(taken, -np.inf, rest)))
        if rest[p] <= least:
            return g[:, :k]
        column = (a[:, p] - g[:, :k] @ g[p, :k]) / np.sqrt(rest[p])
        column[taken] = 0.0
        g[:, k] = column
        rest -= column ** 2
        taken[p] = True
    return g


def rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of r columns once, as rounds of disjoint pairs (a tournament)."""
    seats = list(range(r + r % 2))
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:len(seats) // 2], reversed(seats[len(seats) // 2:])) if max(a, b) < r]
        if pairs:
            yield tuple(np.array(x) for x in zip(*pairs))
        seats.insert(1, seats.pop())


def one_sided_jacobi(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared column norms, normalised columns) of g after rotations from
    the right have made its columns orthogonal, by falling norm."""
    g = g.copy()
    tight = np.finfo(float).eps * max(1, len(g)) ** 0.5
    for _ in range(MAX_SWEEPS):
        off = 0.0
        for p, q in rounds(g.shape[1]):
            gp, gq = g[:, p], g[:, q]
            a, b, c = (gp * gp).sum(axis=0), (gq * gq).sum(axis=0), (gp * gq).sum(axis=0)
            cosine = np.abs(c) / np.sqrt(a * b)
            off = max(off, float(cosine.max()))
            turn = cosine > tight
            half = np.where(turn, (b - a) / (2 * np.where(turn, c, 1.0)), 0.0)
            t = np.where(turn, np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.sqrt(1 + half * half)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            g[:, p], g[:, q] = cos * gp - sin * gq, sin * gp + cos * gq
        if off <= tight:
            break
    else:
        raise RuntimeError(f"Jacobi rotations did not settle in {MAX_SWEEPS} sweeps")
    squares = (g * g).sum(axis=0)
    order = np.argsort(-squares, kind="stable")
    g, squares = g[:, order], squares[order]
    unit = g / np.sqrt(squares)
    if unit.size:       # either sign is right; reruns and all rows take the same
        unit *= np.where(unit[np.abs(unit).argmax(axis=0), np.arange(unit.shape[1])] < 0, -1.0, 1.0)
    return squares, unit


# -- vectors of a batch -----------------------------------------------------------

def whole(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(kept, y): which rows are used, and their x - 100000 as int64, zero-padded
    to ``dims`` (default: the longest kept vector)."""
    n = len(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(n), lengths)
    bad = np.bincount(owner[~np.isfinite(values)], minlength=n) > 0
    kept = pc.is_valid(column).to_numpy(zero_copy_only=False) & ~bad
    width = int(lengths[kept].max(initial=0)) if dims is None else dims
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    y = np.zeros((n, width), np.int64)
    used = kept[owner]
    with np.errstate(over="ignore"):
        y[owner[used], at[used]] = np.clip(np.floor(SCALE * values[used]), -LARGEST, LARGEST).astype(np.int64)
    return kept, y[kept]


def _vectors(df: DataFrame, vector: str, *more: str) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"), *more)


# -- partial sums over the cluster --------------------------------------------------

def _sums(df: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, np.int64)
        for batch in batches:
            kept, y = whole(batch.column(0))
            n += len(y)
            if y.shape[1] > len(sums):
                sums = np.pad(sums, (0, y.shape[1] - len(sums)))
            sums[:y.shape[1]] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(sums))], pa.int32()), pa.array([n, *sums.tolist()], pa.int64())], names=["at", "total"])

    rows = _vectors(df, vector).mapInArrow(run, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
    found = {r["at"]: r["total"] for r in rows}
    return found.pop(-1, 0), np.array([found[i] for i in range(len(found))], np.int64)


def _moments(df: DataFrame, vector: str, dims: int, shape: Callable[[np.ndarray], np.ndarray], width: int):
    """(n, mean, centred scatter) of ``shape`` of the vectors.  A batch is
    centred before it is multiplied; two partials join by their exact shift."""
    layout = "part long, payload binary"

    def join(a, b):
        if a is None or not a[0]:
            return b
        n, shift = a[0] + b[0], b[1] - a[1]
        return (n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)) if b[0] else a

    def pack(part: int, m) -> pa.RecordBatch:
        data = np.concatenate(([float(m[0])], m[1], m[2].ravel())).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([data], pa.binary())], names=["part", "payload"])

    def unpack(data: bytes):
        x = np.frombuffer(data)
        return int(x[0]), x[1:1 + width], x[1 + width:].reshape(width, width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = shape(whole(batch.column(0), dims)[1])
            if len(z):
                mean = z.mean(axis=0)
                total = join(total, (len(z), mean, (z - mean).T @ (z - mean)))
        if total is not None:
            yield pack(TaskContext.get().partitionId(), total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py() if total is None else part
                total = join(total, unpack(batch.column(1)[i].as_py()))
        if total is not None:
            yield pack(part, total)

    partials = _vectors(df, vector).mapInArrow(partial, layout)
    few = max(1, isqrt(input_tasks(df.sparkSession)))
    merged = partials.repartition(few, F.pmod("part", F.lit(few))).sortWithinPartitions("part").mapInArrow(merge, layout)
    row = merged.repartition(1).sortWithinPartitions("part").mapInArrow(merge, layout).first()
    return unpack(bytes(row["payload"]))


# -- the operator -----------------------------------------------------------------

def fit(df: DataFrame, vector: str = "embedding") -> Whitening:
    """Means, eigenvalues and components of all usable vectors of ``df``."""
    n, sums = _sums(df, vector)
    dims = len(sums)
    if not n or not dims:
        return Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    # (n x - S) / n is exact up to the last rounding, however far the means are from zero
    _, _, scatter = _moments(df, vector, dims, lambda y: (n * y - sums) / n, dims)
    squares, unit = one_sided_jacobi(pivoted_cholesky(scatter))
    return Whitening(n, sums, squares / n, unit, float(np.trace(scatter)) / n)


def identity_error(df: DataFrame, model: Whitening, k: int = COMPONENTS, vector: str = "embedding") -> float | None:
    """Largest absolute entry of (covariance of the whitened vectors - identity),
    over the first k components with an eigenvalue above zero (none: null)."""
    k = min(k, len(model.eigenvalues))
    if not k:
        return None
    n, _, scatter = _moments(df, vector, len(model.sums), lambda y: model.whiten(y, k), k)
    return float(np.abs(scatter / n - np.eye(k)).max())


def transform(df: DataFrame, model: Whitening, k: int = COMPONENTS, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: its id, ``deviation`` and the array of its
    first k whitened values (fewer dimensions: as many)."""
    k = min(k, len(model.sums))
    kind = df.schema[ident].dataType.simpleString()

    def squared(y: np.ndarray) -> pa.Array:
        c = model.centred(y)
        top = int(np.abs(c).max(initial=0))
        if top * top * max(1, c.shape[1]) < 1 << 63:
            return pa.array((c * c).sum(axis=1), pa.int64())
        exact = (sum(v * v for v in row) for row in c.tolist())
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, y = whole(batch.column(0), len(model.sums))
            z = model.whiten(y, k).ravel()
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()),
                                              pa.array(z, pa.float64(), mask=np.isnan(z)))
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(kept)), squared(y), values],
                                             names=["vec_id", "deviation", "whitened"])

    return _vectors(df, vector, ident).mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten_rows(df: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error."""
    model = fit(df)
    error = identity_error(df, model, k)
    shares = [float(e / model.trace) for e in model.eigenvalues[:k]]
    shares += [0.0] * (min(k, len(model.sums)) - len(shares))
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]) if shares else F.array(F.lit(None).cast("double")), F.col("component"))
    return transform(df, model, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        "at").withColumn("explained", explained).withColumn("identity_error", F.lit(error).cast("double")).drop("at")
