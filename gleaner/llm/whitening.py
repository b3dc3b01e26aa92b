"""Embedding whitening: streamed covariance, merged across partitions, and a symmetric QR eigen-solve.

Each partition streams its vectors through Welford's rank-one updates of mean and scatter. The states, one a partition, are
merged FAN at a time by the parallel update formula, as a tree of Spark jobs, until one is left; the driver gets that one
alone, whose size is the square of the dimensions. It is reduced to tridiagonal form by reflections and solved by implicit
QR steps with Wilkinson's shifts. The vectors are then projected, and the projections go through the same streamed covariance
once more, which tells how far they are from white.

Entries are fixed-point: x = floor(1024 c) + 100000 of each entry c. Sums of x are exact integers, so a vector's distance from
the mean is taken from n x - S, without rounding.

Defined results: vectors that are null or hold a null, NaN or infinite entry are left out, as are those of another length than
most (of equally frequent lengths the longer counts); repeated rows and rows without an id count as they stand; a component
without variance (to double precision) is left out, as it can't be whitened, so one vector, or equal ones, give no rows; an
empty table gives none; a deviation too large for 64 bits is null; other columns, whatever their names, are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fresh, numbered, own_columns, stored

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: States merged by one task.
FAN = 8
#: Values up to this bound can be added up or squared in 64 bits, as far as a batch goes.
SMALL = 1 << 40
STATE = "part int, n long, sums array<decimal(38,0)>, mean binary, scatter binary"


class Moments:
    """How many vectors, their mean, and the sum of outer products of their distances from it."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, [0] * dims
        self.mean, self.scatter = np.zeros(dims), np.zeros((dims, dims))
        self._step = np.zeros((dims, dims))

    def update(self, rows: np.ndarray) -> None:
        """Takes in vectors one after the other, each by a rank-one update."""
        mean, scatter, step, n = self.mean, self.scatter, self._step, self.n
        for x in rows:
            n += 1
            apart = x - mean
            mean += apart / n
            np.multiply.outer(apart, x - mean, out=step)
            scatter += step
        self.n = n

    def merge(self, other: Moments) -> None:
        """The state of both lots of vectors together."""
        if not other.n:
            return
        n, apart = self.n + other.n, other.mean - self.mean
        self.mean = self.mean + apart * (other.n / n)
        self.scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)

    def row(self, part: int) -> pd.DataFrame:
        from decimal import Decimal

        return pd.DataFrame({"part": [part], "n": [self.n], "sums": [[Decimal(s) for s in self.sums]], "mean": [self.mean.tobytes()], "scatter": [self.scatter.tobytes()]})

    @staticmethod
    def of(row) -> Moments:
        mean = np.frombuffer(bytes(row.mean), np.float64)
        out = Moments(len(mean))
        out.n, out.sums, out.mean = int(row.n), [int(s) for s in row.sums], mean.copy()
        out.scatter = np.frombuffer(bytes(row.scatter), np.float64).reshape(len(mean), -1).copy()
        return out


@dataclass(frozen=True)
class Fit:
    """What the vectors were found to be like: eigenvalues and unit eigenvectors (as rows), by falling value."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def matrix(column: pa.Array) -> np.ndarray:
    """Usable vectors of one length as the rows of a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fixed_point(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as 64-bit integers, held within 62 bits."""
    return np.clip(np.floor(values * SCALE), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    small = not x.size or max(int(x.max()), -int(x.min())) < SMALL
    return [int(s) for s in x.sum(0, dtype=np.int64 if small else object)]


def moments(df: DataFrame, dims: int, column: str, as_fixed: bool) -> Moments | None:
    """The state of all vectors of a column, merged in a tree; None if there is none."""

    def stream(batches):
        state = Moments(dims)
        for batch in batches:
            rows = matrix(batch.column(0))
            if as_fixed:
                x = fixed_point(rows)
                state.sums = [a + b for a, b in zip(state.sums, exact_sums(x), strict=True)]
                rows = x.astype(np.float64)
            state.update(rows)
        if state.n:
            got = state.row(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(got[n], t) for n, t in (("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.binary()), ("scatter", pa.binary()))], ["part", "n", "sums", "mean", "scatter"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [Moments.of(r) for r in pdf.sort_values("part").itertuples()]
        for other in states[1:]:
            states[0].merge(other)
        return states[0].row(int(pdf["part"].min()) // FAN)

    states = stored(df.select(column).mapInArrow(stream, STATE))
    while states.count() > 1:
        states = stored(states.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInPandas(merged, STATE))
    one = states.first()
    return Moments.of(one) if one else None


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and q, with q' a q of that form, by reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        part = a[k + 1 :, k:]
        part -= np.outer(2 * v, v @ part)
        part = a[k:, k + 1 :]
        part -= np.outer(part @ v, 2 * v)
        part = q[:, k + 1 :]
        part -= np.outer(part @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in falling order and unit eigenvectors as rows, by symmetric QR.

    Each step chases a bulge of rotations down the unreduced block at the end, shifted by the eigenvalue of its last two
    rows that is nearer to its last entry. Of each vector the largest entry is positive.
    """
    d, e, q = tridiagonal(np.asarray(a, np.float64))
    z = np.ascontiguousarray(q.T)  # rows are rotated in place
    hi = len(d) - 1
    eps = np.finfo(np.float64).eps
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi -= 1
            continue
        above = np.flatnonzero(small)
        lo = int(above[-1]) + 1 if len(above) else 0
        gap = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (gap + np.copysign(np.hypot(gap, e[hi - 1]), gap))
        f, g = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            size = np.hypot(f, g)
            c, s = (f / size, g / size) if size else (1.0, 0.0)
            if k > lo:
                e[k - 1] = size
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < hi:
                f, g = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = c * z[k] + s * z[k + 1]
            z[k + 1] = c * z[k + 1] - s * z[k]
            z[k] = upper
    order = np.argsort(-d, kind="stable")
    z = z[order]
    return d[order], z * np.sign(z[np.arange(len(z)), np.abs(z).argmax(1)])[:, None]


def usual(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows with usable vectors of the usual length, and that length."""
    good = df.where(usable(F.col(column)))
    top = good.groupBy(F.size(column).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = int(top[0]) if top else 0
    return good.where(F.size(column) == dims), dims


def fit(df: DataFrame, column: str = "embedding") -> Fit | None:
    """Eigenvalues and vectors of the covariance of the fixed-point vectors; None where there are none."""
    rows, dims = usual(df, column)
    state = moments(rows, dims, column, as_fixed=True) if dims else None
    if state is None:
        return None
    covariance = state.covariance()
    values, vectors = eigen(covariance)
    return Fit(state.n, state.sums, values, vectors, float(np.trace(covariance)))


def whitened(df: DataFrame, found: Fit, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """The rows with usable vectors with their own columns, and as the last two their deviation and their whitened vector."""
    dims = len(found.sums)
    solid = found.values > dims * np.finfo(np.float64).eps * max(found.values[0], 0.0)
    k = min(most, int(solid.sum()))
    project = (found.vectors[:k] / np.sqrt(found.values[:k])[:, None]).T
    sums, n = found.sums, found.n
    good = df.where(usable(F.col(column)) & (F.size(column) == dims))
    at = df.columns.index(column)
    wide = numbered(good, F.lit(None).cast("long"), F.lit(None).cast("array<double>"))

    def run(batches):
        for batch in batches:
            x = fixed_point(matrix(batch.column(at)))
            least = max([abs(s) for s in sums] + [n * int(np.abs(x).max(initial=0))])
            apart = x * n - np.array(sums, np.int64) if least < 1 << 62 else x.astype(object) * n - np.array(sums, object)
            far = int(np.abs(apart).max(initial=0))
            squares = (apart * apart).sum(1) if far * far * dims < 1 << 63 else [s if s < 1 << 63 else None for s in (apart.astype(object) ** 2).sum(1)]
            w = (apart.astype(np.float64) / n) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.reshape(-1)))
            last = batch.num_columns - 1
            batch = batch.set_column(last - 1, batch.schema.field(last - 1), pa.array(squares, pa.int64()))
            yield batch.set_column(last, batch.schema.field(last), lists.cast(batch.schema.field(last).type))

    return wide.mapInArrow(run, wide.schema).toDF(*df.columns, fresh(df, "deviation"), fresh(df, "whitened"))


def report(df: DataFrame) -> DataFrame:
    """The digest of the query: a row for each usable vector and component."""
    narrow = df.select("vec_id", "embedding")
    found = fit(narrow)
    empty = df.sparkSession.createDataFrame([], f"vec_id {dict(df.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if found is None:
        return empty
    got = stored(whitened(narrow, found).select(F.col("vec_id"), F.col(fresh(narrow, "deviation")).alias("deviation"), F.col(fresh(narrow, "whitened")).alias("w")))
    k = got.select(F.size("w")).first()[0]
    if not k:
        return empty
    error = float(np.abs(moments(got, k, "w", as_fixed=False).covariance() - np.eye(k)).max())
    shares = F.array(*[F.lit(float(v / found.trace)) for v in found.values[:k]])
    return got.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
