"""Whitening of embeddings: leading eigenvectors of their covariance by LOBPCG over distributed block products.

Entries are taken as whole numbers, x = floor(64 c) + OFFSET. Rows never leave the executors: every task
adds up its own part of a product and Spark sums the parts by place, so that the driver gets d x m numbers
for d dimensions and a block of m columns, whatever the number of rows.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry, or one whose x would
not fit 53 bits, are left out, as are vectors of another length than the most frequent one (on ties the
longer). Keys may be null or repeat; equal rows are so many rows. Directions without variance can't be
whitened and are no components, so that equal vectors, a single one and an empty table give no rows. Other
columns of the table play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, widened

#: What is added to each scaled entry.
OFFSET = 1_000_000
#: Columns of the block besides the components asked for; they speed up the last of those.
GUARD = 8
#: A component is certified if its residual is at most this share of the largest eigenvalue.
CERTIFIED = 1e-13
#: Rounds without a smaller residual, after which rounding is taken to be all that is left of it.
STALLED = 4
#: Rounds at most; the residuals that were reached are part of the result.
ROUNDS = 300
#: Eigenvalues of at most this share of the trace are directions without variance.
FLAT = 1e-14


@dataclass(frozen=True)
class Whitening:
    """n rows with sums of x - OFFSET by dimension; components as columns, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    residuals: np.ndarray
    products: int

    @property
    def dims(self) -> int:
        return len(self.sums)


def scaled(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df's usable rows, the vector as array<long> of x - OFFSET. Lengths may still differ."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * 64))
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * 64) < 2.0**53)
    return df.filter((F.size(vector) > 0) & F.forall(vector, sound)).withColumn(vector, x)


def _rows(batch: pa.RecordBatch, vector: str, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, vector: str, d: int, shape: tuple[int, ...], part: Callable, kind: str = "double") -> np.ndarray:
    """The sum over all rows of part(matrix of some rows): each task sums its own rows, then Spark the tasks."""
    size, dtype = int(np.prod(shape)), {"double": np.float64, "long": np.int64}[kind]

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(_rows(batch, vector, d))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.asarray(total, dtype).ravel())], names=["at", "v"])

    out = mapped(rows.select(vector), run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(size, dtype)
    total[out["at"].to_numpy()] = out["v"].to_numpy()
    return total.reshape(shape)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean; taken as whole numbers before the one division, where they fit."""
    if n * max(1, int(abs(x).max(initial=0))) + int(abs(sums).max(initial=0)) < 2**62:
        return (n * x - sums) / n
    return x - sums / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum over dimensions of (n x - S)^2 of each row; null where it exceeds a long."""
    most = n * int(abs(x).max(initial=0)) + int(abs(sums).max(initial=0))
    if x.shape[1] * most * most < 2**63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    far = n * x.astype(object) - sums.astype(object)
    return [v if v < 2**63 else None for v in (far * far).sum(axis=1).tolist()]


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the orthonormal columns of `against`."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-300] / size[size > 1e-300]
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10 * s[0]]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residuals, products) of the k largest eigenpairs of a symmetric d x d matrix known by its products with blocks.

    Rayleigh-Ritz on the span of the iterate, its residual and the block by which it last moved. A round
    asks for one product with the new columns alone; pairs are certified by a fresh product with the
    iterate itself, and the rounds go on where that fails.
    """
    m = min(d, k + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    ax, fresh, products = product(x), True, 1
    moved = np.empty((d, 0))
    best, stalled = np.inf, 0
    for _ in range(ROUNDS):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        x, ax, values = x @ turn[:, ::-1], ax @ turn[:, ::-1], values[::-1]
        rest = ax - x * values
        residuals = np.linalg.norm(rest[:, :k], axis=0)
        worst = residuals.max(initial=0.0)
        stalled = 0 if worst < 0.5 * best else stalled + 1
        best = min(best, worst)
        if worst <= CERTIFIED * max(values[0], 0.0) or stalled >= STALLED or m == d and fresh:
            if fresh:
                break
            x = np.linalg.qr(x)[0]
            ax, fresh, products = product(x), True, products + 1
            continue
        new = _orthonormal(rest, x)
        new = np.hstack([new, _orthonormal(moved, np.hstack([x, new]))])[:, : d - m]
        if new.shape[1]:
            basis, along = np.hstack([x, new]), np.hstack([ax, product(new)])
            products += 1
            h = basis.T @ along
            pick = np.linalg.eigh((h + h.T) / 2)[1][:, ::-1][:, :m]
            moved = new @ pick[m:]
            x, ax, fresh = basis @ pick, along @ pick, False
        elif fresh:
            break
        else:
            ax, fresh, products = product(x), True, products + 1
    sign = np.sign(x[abs(x).argmax(axis=0), np.arange(m)])
    return values[:k], (x * sign)[:, :k], residuals, products


def fit(df: DataFrame, k: int = 32, vector: str = "embedding") -> Whitening | None:
    """Up to k components over all usable rows of df; None where there are none."""
    rows = scaled(df.select(vector), vector)
    common = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    d, n = common["d"], common["n"]
    rows = rows.filter(F.size(vector) == d)
    sums = summed(rows, vector, d, (d,), lambda x: x.sum(axis=0), "long")

    def product(block: np.ndarray) -> np.ndarray:
        def part(x):
            c = centred(x, n, sums)
            return c.T @ (c @ block)

        return summed(rows, vector, d, block.shape, part) / n

    trace = float(summed(rows, vector, d, (1,), lambda x: (centred(x, n, sums) ** 2).sum(keepdims=True).ravel())[0]) / n
    if not trace > 0:
        return None
    values, components, residuals, products = lobpcg(product, d, min(k, d))
    real = values > FLAT * trace
    return Whitening(n, tuple(int(s) for s in sums), values[real], components[:, real], trace, residuals[real], products)


def _whitened(x: np.ndarray, model: Whitening, sums: np.ndarray) -> np.ndarray:
    return centred(x, model.n, sums) @ model.components / np.sqrt(model.values)


def usable(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    rows = scaled(df, vector)
    return rows.filter(F.size(vector) == model.dims)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k, sums = len(model.values), np.array(model.sums, np.int64)

    def part(x):
        w = _whitened(x, model, sums)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = summed(usable(df.select(vector), model, vector), vector, model.dims, (k + 1, k), part) / model.n
    return float(abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened) of each usable row: the exact sum of squares of n x - S, and its components (array<double>)."""
    sums = np.array(model.sums, np.int64)

    def run(batches):
        for batch in batches:
            x = _rows(batch, vector, model.dims)
            w = _whitened(x, model, sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, model.n, sums), pa.int64()), lists], names=[key, "deviation", "whitened"])

    rows = usable(df.select(key, vector), model, vector)
    return mapped(rows, run, widened(df, [key], "deviation long, whitened array<double>"))


def components(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row of df and component: (key, component, n, deviation, whitened, explained, identity_error, residual)."""
    error = identity_error(df, model, vector)
    share = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    left = F.array(*(F.lit(float(r)) for r in model.residuals))
    each = whiten(df, model, key, vector).select(key, "deviation", F.posexplode("whitened").alias("_at", "w"))
    return each.select(
        key, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.get(share, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"), F.get(left, F.col("_at")).alias("residual"),
    )


def empty(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """The result of components() where there is nothing to whiten."""
    return df.sparkSession.createDataFrame([], widened(df, [key], "component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"))
