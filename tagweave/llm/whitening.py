"""Whitening of embeddings by principal components in mixed precision.

Vectors become whole numbers, so counts, sums and products are exact: tasks multiply what is left of a whole-number
centre, Spark adds the products as decimals, and only the finished covariance is rounded. What reaches the driver is
one matrix of dimension by dimension, whatever the number of rows. Its eigenvectors are found in float32 and then
corrected in higher precision by the iterations of Ogita and Aishima, which are products of matrices; where eigenvalues lie too
close for a correction, the small problem on their common subspace is solved by itself.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are left out, as are those of
another length than most rows have (of lengths equally frequent the greatest counts); a null key is kept; rows that
repeat count once in the fit and are returned each; components without variance are not returned, so vectors that are all the
same, and empty tables, give no rows; other columns are not read, whatever their names. Sums are exact up to 38 digits and the job
fails beyond; a deviation that a long cannot hold is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import table
from tagweave.session import settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: The driver holds a few matrices of dimension by dimension.
MAX_DIMENSION = 4096
_LONG = np.iinfo(np.int64)
_SAFE = float(1 << 53)


def quantised(df: DataFrame, vector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and `x`, the vector in whole numbers, of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(v.isNotNull() & (F.size(v) > 0) & good)
    sizes = rows.groupBy(F.size(f"`{vector}`").alias("size")).count().agg(F.max(F.struct("count", "size"))["size"]).first()[0]
    return rows.filter(F.size(f"`{vector}`") == F.lit(sizes or 0)).select(
        *[F.col(f"`{c}`") for c in keep],
        F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y exactly, as Python numbers; by float products where these cannot round."""
    most = float(np.abs(y.astype(float)).max(initial=0))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    step = int(min(_SAFE / max(most * most, 1), 1 << 16))
    if step < 1:
        return y.astype(object).T @ y.astype(object)
    for a in range(0, len(y), step):
        part = y[a:a + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _added(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray]) -> dict[int, int]:
    """Sums by place of the arrays of whole numbers that `values` gives for a batch of vectors."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = values(_matrix(batch))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int64()),
                 pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["at", "v"])
    sums = rows.mapInArrow(partial, "at long, v decimal(38,0)").groupBy("at").agg(
        F.expr("sum(v)").alias("v"), F.count(F.lit(1)).alias("k"))
    out = {}
    for r in sums.collect():
        if r.v is None:
            raise OverflowError("sums of products beyond 38 digits")
        out[r["at"]] = int(r.v)
    return out


def _column_sums(x: np.ndarray) -> np.ndarray:
    low, high = x & 0xFFFFFFFF, x >> 32
    exact = [int(b) * (1 << 32) + int(a) for a, b in zip(low.sum(0).tolist(), high.sum(0).tolist())]
    return np.array([len(x), *exact], object)


def moments(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, exact sums and the covariance (divisor n), rounded once from exact products."""
    sums = _added(fit, _column_sums)
    if not sums:
        return 0, [], np.zeros((0, 0))
    n, total = sums[0], [sums[i] for i in range(1, len(sums))]
    d = len(total)
    centre = np.array([s // n for s in total], np.int64)
    upper = np.triu_indices(d)

    def centred(x: np.ndarray) -> np.ndarray:
        return _products(x - centre)[upper]
    found = _added(fit, centred)
    left = [s - n * int(c) for s, c in zip(total, centre)]
    covariance = np.zeros((d, d))
    for at, (i, j) in enumerate(zip(*upper)):
        covariance[i, j] = covariance[j, i] = (n * found[at] - left[i] * left[j]) / (n * n)
    return n, total, covariance


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of two or more sorted eigenvalues that follow one another within `gap`."""
    cuts = np.flatnonzero(np.diff(values) > gap) + 1
    return [c for c in np.split(np.arange(len(values)), cuts) if len(c) > 1]


def eigenpairs(v: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Starts in float32. A round takes the products R = I - X'X and S = X'VX and corrects X by X E, where E follows
    from R alone between eigenvalues that S cannot tell apart and from both else. Such close eigenvalues are then
    solved for on their own subspace, shifted by their mean, so that their differences carry the precision.
    """
    scale = float(np.abs(v).max(initial=0)) or 1.0
    a = v.astype(np.longdouble) / scale
    x = np.linalg.eigh((v / scale).astype(np.float32))[1].astype(np.longdouble)
    eye, eps = np.eye(len(v), dtype=np.longdouble), np.finfo(np.float64).eps
    values, last = np.zeros(len(v), np.longdouble), math.inf
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ a @ x
        s = (s + s.T) / 2  # rounding that differs by side would be blown up by small gaps
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * float(np.linalg.norm(off.astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
        apart = values[None, :] - values[:, None]
        told = np.abs(apart) > near
        e = np.where(told, (s + values[None, :] * r) / np.where(told, apart, 1), r / 2)
        x = x + x @ e
        order = np.argsort(values.astype(float), kind="stable")
        x, values = x[:, order], values[order]
        for cluster in _clusters(values.astype(float), near):
            part = x[:, cluster]
            mean = values[cluster].mean()
            inner = part.T @ (a @ part - mean * part)
            size = np.abs(inner).max()
            if size > 0:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))[1]
                x[:, cluster] = part @ turn.astype(np.longdouble)
        change = float(np.abs(e).max(initial=0))
        if change < eps or (change >= last and change < 16 * eps):
            break
        last = change
    x = x / np.sqrt((x * x).sum(0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values.astype(float), kind="stable")
    x, values = x[:, order], values[order]
    signs = np.sign(x[np.abs(x).argmax(0), np.arange(x.shape[1])]) if len(v) else np.ones(0)
    return values.astype(float) * scale, (x * signs).astype(float)


class Whitener:
    """What the fit leaves: count, exact sums, eigenvalues and components that have variance."""

    def __init__(self, n: int, total: list[int], covariance: np.ndarray, components: int):
        self.n, self.total = n, total
        values, vectors = eigenpairs(covariance)
        trace = float(np.trace(covariance))
        floor = len(values) * np.finfo(float).eps * (values[0] if len(values) else 0)
        count = min(components, int((values > max(floor, 0)).sum()))
        self.values, self.vectors = values[:count], vectors[:, :count]
        self.explained = self.values / trace if trace > 0 else self.values
        self.mean = np.array([s // n for s in total], np.int64) if n else np.zeros(0, np.int64)
        # what is left of the exact mean below its whole part
        self.rest = np.array([(s - n * (s // n)) / n for s in total]) if n else np.zeros(0)

    def white(self, x: np.ndarray) -> np.ndarray:
        """Whole-number vectors, centred, projected and scaled to unit variance."""
        return ((x - self.mean) - self.rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared, exactly."""
        most = float(np.abs((x - self.mean).astype(float)).max(initial=0)) + 1
        if most * self.n < 2.0 ** 31 / math.sqrt(x.shape[1] + 1):
            d = self.n * x - np.array(self.total, np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * x.astype(object) - np.array(self.total, object)
        return [s if s <= _LONG.max else None for s in (d * d).sum(1)]


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest entry by which the covariance of the whitened fit list differs from the identity, measured on the rows."""
    k = len(model.values)
    upper = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.white(_matrix(batch))
                sums += w.sum(0)
                products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + len(upper[0])), pa.int64()),
                                          pa.array(np.concatenate([sums, products[upper]]))], names=["at", "v"])
    found = dict(map(tuple, fit.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v")).collect()))
    mean = np.array([found[i] for i in range(k)]) / model.n
    worst = 0.0
    for at, (i, j) in enumerate(zip(*upper)):
        worst = max(worst, abs(found[k + at] / model.n - mean[i] * mean[j] - (i == j)))
    return float(worst)


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once."""
    return rows.select("x").distinct()


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Key, component, n, deviation, whitened, explained, identity_error for each row that takes part."""
    rows = quantised(df, vector, (key,))
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(n, t) for n, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])
    fit = settle(fit_list(rows))
    n, total, covariance = moments(fit)
    if len(total) > MAX_DIMENSION:
        raise ValueError(f"vectors of {len(total)} entries; the matrix on the driver is held to {MAX_DIMENSION}")
    model = Whitener(n, total, covariance, components) if n else None
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(fit, model), len(model.values)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                x = _matrix(batch)
                at = np.repeat(np.arange(len(x)), k)
                far = pa.array(model.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(at), n)), far.take(pa.array(at)), pa.array(model.white(x).ravel()),
                     pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(at), error))],
                    names=schema.names)
    return rows.mapInArrow(spread, schema)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Up to 16 whitened components of every embedding of the table."""
    return whiten(table(spark, folder, "embeddings"), "vec_id", "embedding")
