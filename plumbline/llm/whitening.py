"""Whitening of vectors: an exact distributed scatter, cyclic Jacobi on the driver, a broadcast matrix.

Components are integers, so the sums, and the scatter around the integer nearest each mean, are whole numbers
that tasks add up without rounding, in any order: the covariance is rounded once, and equal tables give equal
models however they are dealt.  Jacobi's rotations keep the small eigenvalues as exact as the large ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import common, vectors

SCALE, OFFSET = 1024, 100_000
#: Components that are returned.
COMPONENTS = 8
#: Integers are held within plus and minus this, so that sums of their products fit 38 digits.
LARGEST = 2**40
#: Rows and deviations up to which products of doubles add up exactly.
_ROWS, _SMALL = 8192, 2**20
#: An eigenvalue of at most this share of the trace is rounding.
NOTHING = 2.0**-45
_MOST = 2**63 - 1


def integers(values: np.ndarray) -> np.ndarray:
    """``floor(SCALE * c) + OFFSET`` of doubles, held within LARGEST."""
    return np.clip(np.floor(SCALE * values) + OFFSET, -LARGEST, LARGEST).astype(np.int64)


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix, by cyclic rotations.

    Each pair (p, q) in turn is rotated until its entry vanishes; a sweep without a rotation ends it.  Entries too small to
    change either diagonal entry are taken for zero.  Of equal eigenvalues the one found at the smaller place comes first.
    """
    a = np.array(a, float)
    n = len(a)
    v = np.eye(n)
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x = a[p, q]
                if abs(x) <= 2.0**-54 * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    a[p, q] = a[q, p] = 0.0
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = 1 / (abs(theta) + np.hypot(1.0, theta)) * (1 if theta >= 0 else -1)  # the smaller angle
                c = 1 / np.hypot(1.0, t)
                s = t * c
                tau, h = s / (1 + c), t * x
                left, right = a[p].copy(), a[q].copy()
                a[p], a[q] = left - s * (right + tau * left), right + s * (left - tau * right)
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q] = left[p] - h, right[q] + h
                a[p, q] = a[q, p] = 0.0
                left, right = v[p].copy(), v[q].copy()
                v[p], v[q] = left - s * (right + tau * left), right + s * (left - tau * right)
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], v[order]


class Model:
    """What whitening needs: the number of rows, sums and the components with their eigenvalues."""

    def __init__(self, dim: int, n: int, sums: list[int], scatter: list[list[int]], components: int):
        """``scatter``: sums of products of the differences from ``center``, the integers nearest the means."""
        self.dim, self.n, self.sums = dim, n, sums
        self.center = centers(n, sums)
        rest = [s - n * c for s, c in zip(sums, self.center)]
        self.fraction = np.array([r / n if n else 0.0 for r in rest])  # the mean less its integer
        v = np.array([[(n * scatter[i][j] - rest[i] * rest[j]) / (n * n) if n else 0.0 for j in range(dim)] for i in range(dim)]).reshape(dim, dim)  # rounded once
        values, rows = jacobi(v)
        self.trace = float(np.trace(v))
        self.values = np.where(values > NOTHING * self.trace, values, 0.0)[:components]
        self.explained = self.values / self.trace if self.trace else np.zeros(len(self.values))
        root = np.sqrt(self.values)
        self.matrix = np.divide(rows[:components], root[:, None], out=np.zeros((len(root), dim)), where=root[:, None] > 0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Each row's value on each component; 0 on those without variance.  Row by row, so equal rows get equal values."""
        centred = (x - np.array(self.center, np.int64)) - self.fraction
        return np.stack([(centred * row).sum(1) for row in self.matrix], 1) if len(self.matrix) else np.zeros((len(x), 0))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over components of ``(n x - S)^2``, exact, held at the largest long."""
        rest = [s - self.n * c for s, c in zip(self.sums, self.center)]
        d = x - np.array(self.center, np.int64)
        largest = self.n * int(np.abs(d).max(initial=0)) + self.n
        if largest * largest * max(1, self.dim) < 2**62:
            return ((self.n * d - np.array(rest, np.int64)) ** 2).sum(1)
        wide = ((self.n * d.astype(object) - np.array(rest, object)) ** 2).sum(1)
        return np.array([min(int(v), _MOST) for v in wide], np.int64)


def centers(n: int, sums: list[int]) -> list[int]:
    """The integers nearest the means."""
    return [(2 * s + n) // (2 * n) if n else 0 for s in sums]


def _products(d: np.ndarray) -> np.ndarray:
    """``d' d`` of integers as Python's, exact."""
    dim, out = d.shape[1], 0
    odd = (np.abs(d) > _SMALL).any(axis=1)
    plain = d[~odd].astype(float)
    for k in range(0, len(plain), _ROWS):  # below 2^53 doubles add up exactly
        part = plain[k : k + _ROWS]
        out = out + (part.T @ part).astype(np.int64).astype(object)
    wide = d[odd].astype(object)
    return out + (wide.T @ wide if len(wide) else np.zeros((dim, dim), object))


def _summed(df: DataFrame, vector_col: str, dim: int, make) -> dict[int, int]:
    """By place, the exact sums over all rows of what ``make`` gives for the integers of a batch; a task sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + make(integers(vectors.matrix(batch.column(0), dim)[1]))
        if not isinstance(total, int):
            flat = [Decimal(int(t)) for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.decimal128(38, 0))], ["at", "total"])

    parts = df.select(F.col(vector_col)).mapInArrow(run, "at int, total decimal(38,0)")
    return {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect()}  # dim * dim rows at most


def fitted(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Model:
    """The model of all vectors: one pass for the sums, one for the centred scatter; only sums reach the driver."""
    dim = vectors.commonest_length(df, vector_col)
    wide = lambda x: x if np.abs(x).max(initial=0) < 2**30 else x.astype(object)

    found = _summed(df, vector_col, dim, lambda x: np.concatenate([[len(x)], wide(x).sum(axis=0)]).astype(object))
    n, sums = found.get(0, 0), [found.get(k + 1, 0) for k in range(dim)]
    center = np.array(centers(n, sums), np.int64)
    upper = np.triu_indices(dim)
    found = _summed(df, vector_col, dim, lambda x: _products(x - center)[upper])
    scatter = [[0] * dim for _ in range(dim)]
    for k, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
        scatter[i][j] = scatter[j][i] = found.get(k, 0)
    return Model(dim, n, sums, scatter, components)


def whitened(df: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, deviation, whitened array<double>)`` of each vector that the model's fit would take."""
    opened, kind, dim = common.sent(df.sparkSession, model), df.schema[id_col].dataType.simpleString(), model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = opened()
        for batch in batches:
            mask, found = vectors.matrix(batch.column(1), dim)
            x = integers(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(mask)), pa.array(held.deviation(x), pa.int64()), vectors.lists(held.whiten(x), pa.float64())], ["vec_id", "deviation", "whitened"])

    return df.select(F.col(id_col), F.col(vector_col)).mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(df: DataFrame, model: Model, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened values' covariance less the identity, over the components that have variance; 0 without any."""
    opened, dim, k = common.sent(df.sparkSession, model), model.dim, int((model.values > 0).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = opened(), np.zeros((k, k + 1))
        for batch in batches:
            w = held.whiten(integers(vectors.matrix(batch.column(0), dim)[1]))[:, :k]
            total += np.concatenate([w.T @ w, w.sum(0)[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "total"])

    if not k:
        return 0.0
    parts = df.select(F.col(vector_col)).mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    total = np.zeros(k * (k + 1))
    for r in parts.collect():  # k * (k + 1) rows
        total[r["at"]] = r["total"]
    total = total.reshape(k, k + 1) / model.n
    mean = total[:, k]  # rounding alone: values are centred already
    return float(np.abs(total[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Vectors that are null, hold null or non-finite components, or have another length than the commonest (the
    smaller of two) are left out.  Vectors with fewer components than ``wanted`` give as many rows as they have.
    A component without variance has whitened 0 and explained 0 and no part in ``identity_error``.  Rows without an
    id stay, repeated rows count as often as they occur and get equal values; an empty table gives none, other
    columns play no part.  Integers are held within LARGEST, deviations at the largest long.  Of equal
    eigenvalues any base of their space is right.
    """
    kind = df.schema[id_col].dataType.simpleString()
    if id_col.lower() == vector_col.lower() or not vectors.commonest_length(df, vector_col):
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model = fitted(df, vector_col, wanted)
    error = identity_error(df, model, vector_col)
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    return whitened(df, model, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
