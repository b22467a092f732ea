"""Whitening of vectors on their principal components, found by the Jacobi-Davidson method.

Components become integers x = floor(scale * component).  The covariance V of the distinct vectors is never formed: the method asks for its
products with a few directions at a time, and each is one pass over the vectors, as tasks sum (x - mean) times
((x - mean) . direction) over blocks of them.  The driver holds matrices as wide as a vector with a few dozen columns.

Each step takes the best approximations from the search space (Rayleigh-Ritz), locks those whose residual has reached double precision,
and widens the space for the others by the solutions t of the correction equations
(I - ZZ')(V - theta I)(I - ZZ') t = -residual, where Z holds the locked and the approximate eigenvectors.  Inner MINRES
solves them side by side, so that a pass serves all.  Eigenvectors have their largest entry positive.

The vectors are stored as blocks of integers, so a pass reads bytes and a lost executor costs the reading of its blocks.  Tasks' sums
are added in the order of their partitions, in groups of 256, before they reach the driver.

Edge cases: vectors that are NULL or hold NULL, NaN or infinity take no part; shorter ones end in zeros; integers beyond 64
bits become the nearest that fit; rows that repeat, or have no id, are each whitened, and count once among the distinct vectors; a deviation beyond 38
digits is NULL; components without variance to double precision (fewer distinct vectors than components, constant ones) are left out; a
table without vectors, or with one distinct vector, gives no row.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import decimal
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import give_back, in_arrow, table, written
from tabloom.llm.vectors import matrix, whole

TOGETHER = 256
ROWS = 4096
EPS = float(np.finfo(np.float64).eps)


def integer_vectors(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """The rows whose vectors take part, with ``x``: floor(scale * component) as integers, all of one length."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    rows = df.filter(whole(vector)).withColumn("x", x)
    width = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    missing = F.lit(width) - F.size("x")
    return rows.withColumn("x", F.when(missing > 0, F.concat("x", F.array_repeat(F.lit(0).cast("long"), missing))).otherwise(F.col("x")))


def exact_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row for each list of integers; all lists are of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def in_blocks(vectors: DataFrame) -> DataFrame:
    """The vectors ``x`` as blocks of bytes: (kind, width, data), integers of the fewest bytes that hold a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = exact_matrix(batch.column("x"))
            for low in range(0, len(x), ROWS):
                part = x[low:low + ROWS]
                kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if part.size == 0 or (
                    np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind]), pa.array([part.shape[1]], pa.int32()), pa.array([part.astype(kind).tobytes()])],
                    ["kind", "width", "data"])

    return in_arrow(vectors.select("x"), run, "kind string, width int, data binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, width, data in zip(*(c.to_pylist() for c in batch.columns)):
            yield np.frombuffer(data, kind).reshape(-1, width) if width else np.zeros((0, 0))


def summed(blocks: DataFrame, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of_block`` over all blocks, added in the order of the partitions."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches):
            part = of_block(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps(total)])], ["part", "total"])
        give_back()

    def joined(rows: list[tuple]) -> np.ndarray:
        return sum((pickle.loads(t) for _, t in sorted(rows)[1:]), pickle.loads(min(rows)[1]))

    def together(group: pa.Table) -> pa.Table:
        rows = list(zip(*(c.to_pylist() for c in group.columns)))
        return pa.table({"part": pa.array([min(rows)[0]]), "total": pa.array([pickle.dumps(joined(rows))])})

    parts = blocks.mapInArrow(task, "part long, total binary")
    if blocks.rdd.getNumPartitions() > TOGETHER:
        parts = parts.groupBy((F.col("part") / TOGETHER).cast("long")).applyInArrow(together, "part long, total binary")
    groups: dict[int, list] = {}
    for part, total in parts.collect():
        groups.setdefault(part // TOGETHER, []).append((part, total))
    rows = [(g, pickle.dumps(joined(r))) for g, r in groups.items()]
    return joined(rows) if rows else None


def totals(x: np.ndarray) -> np.ndarray:
    """Exact integers of a block: its rows, sums of each column, sum of all squares."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    exact = x.astype(np.int64 if most * most * max(x.size, 1) < 1 << 62 else object)
    return np.array([len(x), *(int(v) for v in exact.sum(0)), int((exact * exact).sum())], object)


class Covariance:
    """Products of the covariance with directions, one pass over the blocks each."""

    def __init__(self, blocks: DataFrame, mean: np.ndarray, n: int):
        self.blocks, self.mean, self.n, self.passes = blocks, mean, n, 0

    def __call__(self, directions: np.ndarray) -> np.ndarray:
        mean = self.mean

        def product(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ directions)

        self.passes += 1
        return summed(self.blocks, product) / self.n


def orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Unit columns that span what ``new`` adds to the orthonormal columns of ``against``."""
    out = []
    for column in new.T:
        norm = np.linalg.norm(column)
        for _ in range(3):
            for old in (against, np.array(out).T if out else against[:, :0]):
                column = column - old @ (old.T @ column)
        left = np.linalg.norm(column)
        if norm > 0 and left > 1e-10 * norm:
            out.append(column / left)
    return np.array(out).T if out else new[:, :0]


def corrections(product: Callable, theta: np.ndarray, residuals: np.ndarray, known: np.ndarray, steps: int, factor: float) -> np.ndarray:
    """MINRES for the correction equations of all columns side by side: each step is one product.  A column rests once its
    residual is ``factor`` of the first."""
    project = lambda y: y - known @ (known.T @ y)
    r = project(-residuals)
    beta = np.linalg.norm(r, axis=0)
    first = beta.copy()
    live = beta > 0
    x, w_old, w_older, v_old = (np.zeros_like(r) for _ in range(4))
    v = r / np.where(live, beta, 1.0)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, off = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        y = project(product(v) - v * theta)
        alpha = (v * y).sum(0)
        y = y - alpha * v - off * v_old
        norm = np.linalg.norm(y, axis=0)
        # The new column of the tridiagonal matrix, turned by the last two rotations and by a new one.
        upper, middle = s_old * off, c_old * off
        second, diagonal = c * middle + s * alpha, c * alpha - s * middle
        size = np.hypot(diagonal, norm)
        size = np.where(size > 0, size, 1.0)
        c_new, s_new = diagonal / size, norm / size
        w = (v - second * w_old - upper * w_older) / size
        x = x + np.where(live, c_new * eta, 0.0) * w
        eta = -s_new * eta
        live &= (np.abs(eta) > factor * first) & (norm > 0)
        w_older, w_old, v_old, v = w_old, w, v, np.where(norm > 0, y / np.where(norm > 0, norm, 1.0), 0.0)
        c_old, c, s_old, s, off = c, c_new, s, s_new, norm
    return project(x)


@dataclass
class Search:
    """Sizes of the search: ``guards`` approximations are kept beside the wanted ones, the space is cut to the approximations
    once it has ``most`` columns, and a correction takes ``inner`` steps at most."""

    guards: int = 12
    most: int = 64
    inner: int = 4
    factor: float = 0.02
    tolerance: float = 32 * EPS
    outer: int = 500


def jacobi_davidson(product: Callable, width: int, wanted: int, seed: int = 0, search: Search = Search()) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix known by its products."""
    wanted = min(wanted, width)
    block = min(width, wanted + search.guards)
    most = max(search.most, 2 * block)
    values, locked = [], np.zeros((width, 0))
    space = orthonormal(np.random.default_rng(seed).standard_normal((width, block)), locked)
    images = product(space)
    scale = 0.0
    for _ in range(search.outer):
        inner = space.T @ images
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        scale = max(scale, float(np.abs(theta).max(initial=0.0)))
        ritz, moved = space @ turn, images @ turn
        residuals = moved - ritz * theta
        residuals = residuals - locked @ (locked.T @ residuals)
        done = np.linalg.norm(residuals, axis=0) <= search.tolerance * scale
        ready = 0
        while ready < len(theta) and len(values) < wanted and done[ready]:
            values.append(float(theta[ready]))
            locked = np.column_stack([locked, ritz[:, ready]])
            ready += 1
        if len(values) == wanted:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        space, images, theta, residuals = ritz[:, ready:], moved[:, ready:], theta[ready:], residuals[:, ready:]
        keep = min(block, space.shape[1])
        if space.shape[1] > most - keep:
            space, images = space[:, :keep], images[:, :keep]
        n = min(keep, wanted - len(values) + search.guards // 2)
        known = np.column_stack([locked, space[:, :keep]])
        new = corrections(product, theta[:n], residuals[:, :n], known, search.inner, search.factor)
        held = np.column_stack([locked, space])
        new = orthonormal(new, held)
        if not new.shape[1]:  # nothing new from the equations: residuals themselves, else any direction
            new = orthonormal(residuals[:, :n], held)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + len(held.T)).standard_normal((width, 1)), held)
        if not new.shape[1]:
            raise ArithmeticError("the space is full and residuals stay above the tolerance")
        space, images = np.column_stack([space, new]), np.column_stack([images, product(new)])
    raise ArithmeticError(f"{len(values)} of {wanted} eigenvectors after {search.outer} steps")


@dataclass
class Whitening:
    """What a fit gives: ``vectors`` has an eigenvector in each column, ``values`` their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fitted(vectors: DataFrame, components: int, seed: int = 0) -> Whitening | None:
    """The whitening of the distinct vectors ``x``; None where there is nothing to whiten."""
    blocks = written(in_blocks(vectors.select("x").distinct()), "whitening-blocks")
    found = summed(blocks, totals)
    if found is None or len(found) == 2:  # vectors without components
        return None
    n, sums, squares = int(found[0]), [int(s) for s in found[1:-1]], int(found[-1])
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    model = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), np.zeros(0), None, 0)
    if not trace:
        return model
    product = Covariance(blocks, model.mean, n)
    values, found = jacobi_davidson(product, len(sums), components, seed)
    real = values > 64 * len(sums) * EPS * values[0]
    found = found * np.sign(found[np.abs(found).argmax(0), np.arange(len(values))])
    model.values, model.vectors, model.explained = values[real], found[:, real], values[real] / trace
    scaled, mean = model.vectors / np.sqrt(model.values), model.mean

    def moments(x: np.ndarray) -> np.ndarray:
        out = (x - mean) @ scaled
        return np.vstack([out.sum(0), out.T @ out])

    sums_ = summed(blocks, moments) / n
    model.identity_error = float(np.abs(sums_[1:] - np.outer(sums_[0], sums_[0]) - np.eye(len(model.values))).max())
    model.passes = product.passes
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact squared lengths of n * x - sums, for each row."""
    most = n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 62:
        return ((n * x.astype(np.int64) - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    return [int(v) for v in ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)]


def whitened(df: DataFrame, components: int = 4, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding",
             seed: int = 0) -> DataFrame:
    """For each row and component: key, component, n, deviation (38 digits), whitened, explained, identity_error."""
    kind = df.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    rows = integer_vectors(df.select(key, vector), vector, scale).select(key, "x")
    model = fitted(rows, components, seed)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    n, sums, mean, scaled, k = model.n, model.sums, model.mean, model.vectors / np.sqrt(model.values), len(model.values)
    explained, error, limit = model.explained, model.identity_error, 10 ** 38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = exact_matrix(batch.column("x"))
            far = [decimal.Decimal(v) if v < limit else None for v in deviations(x, n, sums)]
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(at), n)), pa.array(far, pa.decimal128(38, 0)).take(pa.array(at)),
                 pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return in_arrow(rows, run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits is NULL here."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
