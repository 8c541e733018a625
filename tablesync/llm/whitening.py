"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

Vectors are scaled to whole numbers x = floor(scale * c). The fit list holds every distinct x once: n rows X with sums S, a
written table. From a unit vector v, X (rows minus S/n) is multiplied alternately: u = Xv, then v' = X'u, each made orthogonal
to all earlier ones and brought to length 1. That gives X = U B V' with a small bidiagonal B; its singular values s
and right vectors yield the components and the deviations s / sqrt(n) along them. One scan of the fit list a step: products and
sums run in tasks, Spark adds up one short vector a partition, and the driver keeps vectors of the length of an embedding only.
The long vectors u are never stored: each is X times a known short vector m, and tasks form the products again where earlier
ones are needed. A step whose u loses most of its length to the earlier ones is made orthogonal in a second scan.

The steps end when the wanted singular triplets have residuals at rounding level against their gaps, or when V spans the space
(as many steps as components of a vector). Where the iteration closes early (repeated or zero singular values), it
goes on from a new direction orthogonal to all earlier ones. Every step rereads the written table, so lost executors cost a
task, not the iteration.

Defined cases: rows whose vector is null or holds null or non-finite components take no part, nor those with a scaled component of
2^53 or more (not exact as double) or of another length than the most common one (ties: the longer); empty vectors have
no components. Rows that repeat an id or a vector all get their results; the fit list holds a vector once. Components
with a deviation below 1e-10 of the largest do not exist (one distinct vector: none), so no rows are returned for them.
``deviation`` is null where it exceeds a long. An empty table gives no rows. Extra columns are not read. Signs: the largest entry
of a component is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import written

SCALE = 256.0
#: Largest scaled component: whole numbers below are exact as doubles.
EXACT = float(1 << 53)
#: Numbers of a chunk that a task turns into doubles at once.
CHUNK = 1 << 20
#: Singular values below this part of the largest count as zero.
ZERO = 1e-10


@dataclass
class Whitening:
    """A fitted whitening: n vectors of the fit list, their sums, components as columns with eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    steps: int


def scaled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    rows = rows.select("vec_id", F.transform("c", lambda c: F.lit(float(scale)) * c).alias("c"))
    good = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < EXACT))
    rows = rows.where(F.col("c").isNotNull()).where(F.coalesce(good, F.lit(False)))
    rows = rows.select("vec_id", F.transform("c", lambda c: F.floor(c)).alias("x"))
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("x") == (length["n"] if length else 0))


def chunks(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    """A list column of whole numbers as matrices of a bounded size."""
    rows = max(1, CHUNK // max(length, 1))
    for at in range(0, len(column), rows):
        part = column[at : at + rows]
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), length)


def summed(fit: DataFrame, length: int, width: int, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of ``function(matrix)``, a vector of ``width`` doubles: one such vector a partition is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for matrix in chunks(batch.column(0), length):
                total += function(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(width)
    for i, v in fit.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out


def exact_sums(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of rows and sum of every component, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, [0] * length
        for batch in batches:
            for matrix in chunks(batch.column(0), length):
                # A chunk of fewer than 2^9 rows cannot leave a long; others are added as Python numbers by pieces.
                for at in range(0, len(matrix), 512):
                    rows += len(matrix[at : at + 512])
                    total = [a + int(b) for a, b in zip(total, matrix[at : at + 512].sum(axis=0), strict=True)]
        values = [Decimal(v) for v in [*total, rows]]
        yield pa.RecordBatch.from_arrays([pa.array(range(length + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["i", "v"])

    found = {i: int(v) for i, v in fit.mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v")).collect()}
    return found.get(length, 0), [found.get(i, 0) for i in range(length)]


class Bidiagonal:
    """The state of the iteration on the driver: short vectors only.

    Columns of ``v`` are the right vectors, columns of ``m`` the short forms of the left ones (u = Xm), columns of ``g`` the
    products X'u, and ``b[i, j]`` = u_i'Xv_j.
    """

    def __init__(self, fit: DataFrame, mean: np.ndarray, seed: int):
        self.fit, self.mean, self.d = fit, mean, len(mean)
        self.random = np.random.default_rng(seed)
        self.v, self.m, self.g = (np.zeros((self.d, 0)) for _ in range(3))
        self.b = np.zeros((0, 0))
        self.size = 0.0  # of the largest product so far, to tell rounding from results

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - self.v @ (self.v.T @ x)
        return x

    def new_direction(self) -> np.ndarray:
        x = self.orthogonal(self.random.standard_normal(self.d))
        return x / np.linalg.norm(x)

    def left(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(short form, X'u, length) of u = Xc made orthogonal to all earlier left vectors."""
        start = None
        for _ in range(3):
            mean, factors, k, d = self.mean, np.column_stack([self.m, c]), self.m.shape[1], self.d

            def products(x: np.ndarray, mean=mean, factors=factors, k=k) -> np.ndarray:
                x = x - mean
                t = x @ factors
                u = t[:, k]
                return np.concatenate([t[:, :k].T @ u, [u @ u], x.T @ u])

            found = summed(self.fit, d, k + 1 + d, products)
            h, square, g = found[:k], found[k], found[k + 1 :]
            c, g = c - self.m @ h, g - self.g @ h
            left = max(square - h @ h, 0.0)
            start = square if start is None else start
            # Half of the length left: the remainder is orthogonal up to rounding.
            if left >= 0.5 * square or left <= (1e-15 * self.size) ** 2:
                break
        return c, g, float(np.sqrt(left))

    def step(self, v: np.ndarray, beta: float) -> tuple[np.ndarray, float]:
        """Takes in the next right vector; returns the one after it and its length before scaling (0: closed)."""
        k = self.m.shape[1]
        c = v - beta * self.m[:, -1] if beta else v
        c, g, alpha = self.left(c)
        self.size = max(self.size, alpha, beta)
        self.v = np.column_stack([self.v, v])
        column = np.zeros(k)
        if beta:
            column[-1] = beta
        self.b = np.column_stack([self.b, column]) if k else np.zeros((0, self.v.shape[1]))
        if alpha <= ZERO * self.size:
            return v, 0.0
        self.m, self.g = np.column_stack([self.m, c / alpha]), np.column_stack([self.g, g / alpha])
        self.b = np.vstack([self.b, np.zeros(self.v.shape[1])])
        self.b[-1, -1] = alpha
        after = self.orthogonal(self.g[:, -1] - alpha * v)
        length = float(np.linalg.norm(after))
        return (after / length, length) if length > ZERO * self.size else (v, 0.0)

    def converged(self, wanted: int, beta: float) -> bool:
        """Whether residuals of the wanted triplets are at rounding level against the gaps between singular values."""
        if min(self.b.shape) <= wanted:
            return False
        left, values, _ = np.linalg.svd(self.b)
        gap = (values[:wanted] - values[1 : wanted + 1]).min()
        return bool(beta * np.abs(left[-1, :wanted]).max() <= np.finfo(float).eps * gap)


def fit_whitening(rows: DataFrame, components: int = 4, seed: int = 1) -> Whitening | None:
    """Whitening of rows (vec_id, x); None without a component."""
    fit = written(rows.select("x").distinct(), "whitening")
    first = fit.select(F.size("x")).first()
    if not first or not first[0]:
        return None
    d = first[0]
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])
    trace = float(summed(fit, d, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0])
    if trace == 0:
        return None
    state = Bidiagonal(fit, mean, seed)
    v, beta = state.new_direction(), 0.0
    while True:
        v, beta = state.step(v, beta)
        k = state.v.shape[1]
        if k == d or (beta and state.converged(components, beta)):
            break
        if not beta:
            v = state.new_direction()
    _, values, right = np.linalg.svd(state.b)
    kept = [i for i in range(min(components, len(values))) if values[i] > ZERO * values[0]]
    found = state.v @ right[kept].T
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(kept))])
    eigenvalues = values[kept] ** 2 / n
    factors = found / np.sqrt(eigenvalues)

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ factors
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    c = len(kept)
    total = summed(fit, d, c * c + c, moments) / n
    error = np.abs(total[: c * c].reshape(c, c) - np.outer(total[c * c :], total[c * c :]) - np.eye(c)).max()
    return Whitening(n, sums, found, eigenvalues, trace / n, float(error), k)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the components of (n x - S)^2 for every row, in whole numbers; None beyond a long."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if x.shape[1] * reach * reach < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], fields)
    n, sums, c, length = model.n, model.sums, len(model.eigenvalues), len(model.sums)
    mean, factors = np.array([s / n for s in sums]), model.components / np.sqrt(model.eigenvalues)
    explained, error = model.eigenvalues / model.trace, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in chunks(batch.column("x"), length):
                ids, m = batch.column("vec_id")[at : at + len(x)], len(x)
                at += m
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(m), c))),
                        pa.array(np.tile(np.arange(1, c + 1), m), pa.int32()),
                        pa.array(np.full(m * c, n), pa.int64()),
                        pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), c))),
                        pa.array(((x - mean) @ factors).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * c, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, fields)


def whitened_embeddings(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Scales, fits and whitens a table of embeddings."""
    rows = scaled(vectors, vec_id, vector)
    return whiten(rows, fit_whitening(rows, components))
