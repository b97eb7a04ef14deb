"""Embedding whitening: the leading components of the covariance by LOBPCG, over vectors once each.

Entries become whole numbers, x = floor(256 c). The fit list, every distinct x vector once, is written in blocks of rows; count and sums come
from one exact pass over it. The method then works on a block of `BLOCK` directions (the components asked for and guards beside them, which
make it converge by the gap behind the last guard):

1. A pass over the fit list multiplies the covariance with an orthonormal basis Q of (iterate, residual, previous direction): a task
   centres its rows and adds up (x - mean)((x - mean)^T Q), and Spark sums what tasks return, one row a dimension. The covariance itself,
   dimensions by dimensions, is never formed.
2. Rayleigh-Ritz on Q gives new iterates, their residuals V y - e y from products that are measured, not carried on from pass to pass, and
   the new direction: what of an iterate came from residuals and directions.
3. It ends when every component asked for has a residual of at most `TOLERANCE` times the first eigenvalue, which bounds the
   error of its eigenvalue; a warning tells if `ROUNDS` passes did not reach that.

The driver holds dimensions by 3 BLOCK numbers and nothing that grows with rows. A component whose eigenvalue is under `FLAT` of the first can't be told
from none in double precision and is left out.

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped; shorter vectors (an empty one too) count as if they
ended in zeros; entries beyond the range of a long are the nearest long, as is a deviation beyond it; repeated rows and rows without an id are rows
like others; fewer than four components, or none, where the vectors span no more; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import task, written

COMPONENTS, BLOCK, SCALE = 4, 16, 256
TOLERANCE, FLAT, ROUNDS = 1e-12, 1e-10, 300
#: Entries of one block of rows.
CELLS = 1 << 17
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """Count and sums of the fit list, its eigenvectors (a column each) with eigenvalues and residuals, and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fits(name: str = "embedding") -> Column:
    """Neither null nor holding null, NaN or infinite entries."""
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(name).isNotNull() & ~bad, F.lit(False))


def whole(width: int, name: str = "embedding") -> Column:
    """floor(256 c) of every entry, and zeros up to `width`."""
    x = F.transform(name, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size(x))))


def _rows(array: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as a matrix of longs."""
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(array), width)


def _packed(width: int):
    """Rows in blocks, in as few bytes a number as hold them."""

    def made(x: np.ndarray) -> pa.RecordBatch:
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
        return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([x.astype(kind).tobytes()], pa.binary())], ["n", "size", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, most = [], 0, max(1, CELLS // width)
        for batch in batches:
            x = _rows(batch["x"], width)
            for a in range(0, len(x), most):
                kept.append(x[a : a + most])
                rows += len(kept[-1])
                if rows >= most:
                    yield made(np.concatenate(kept))
                    kept, rows = [], 0
        if kept:
            yield made(np.concatenate(kept))

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, size, block in zip(*(batch[c].to_pylist() for c in ("n", "size", "block")), strict=True):
            yield np.frombuffer(block, {2: np.int16, 4: np.int32, 8: np.int64}[size], n * width).astype(np.int64).reshape(n, width)


def fit_list(embeddings: DataFrame, width: int) -> DataFrame:
    """n, size, block: every distinct x vector once, in blocks of rows."""
    distinct = embeddings.where(fits()).select(whole(width).alias("x")).distinct()
    return written(distinct.mapInArrow(task(_packed(width)), "n long, size int, block binary"), "whitening-fit")


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, beyond the range of a long too."""
    if np.abs(x.astype(np.float64)).max(initial=0) * len(x) < 2.0**62:
        return [int(v) for v in x.sum(0)]
    return [sum(int(v) for v in column) for column in x.T]


def _totals(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for x in _blocks(batches, width):
            n += len(x)
            sums = [a + b for a, b in zip(sums, exact_sums(x), strict=True)]
        if n:
            columns = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "n", "total"])

    return run


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and sum of each dimension, exactly; a row a dimension comes to the driver."""
    parts = fit.mapInArrow(task(_totals(width)), "dim int, n long, total decimal(38,0)")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    sums = [0] * width
    for r in rows:
        sums[r.dim] = int(r.total)
    return (rows[0].n if rows else 0), sums


def _summed(fit: DataFrame, width: int, columns: int, of) -> np.ndarray:
    """The sum over all blocks of rows of what `of` makes of one, a matrix of `columns` columns."""
    names = [f"c{k}" for k in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, width):
            total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["dim", *names])

    parts = fit.mapInArrow(task(run), "dim int, " + ", ".join(f"{c} double" for c in names))
    rows = sorted(parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).collect())
    return np.array([list(r)[1:] for r in rows]).reshape(len(rows), columns)


def products(fit: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance times the columns of `basis`, in one pass."""

    def of(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ basis)

    return _summed(fit, len(mean), basis.shape[1], of) / n


def orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of all columns; a column that the ones before it span, but for rounding, goes."""
    kept = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        for column in block.T:
            size = np.linalg.norm(column)
            if size == 0:
                continue
            rest = column / size
            for _ in range(2):  # twice is enough for double precision
                rest = rest - kept @ (kept.T @ rest)
            left = np.linalg.norm(rest)
            if left > 1e-8 and kept.shape[1] < len(kept):
                rest = rest / left
                rest = rest - kept @ (kept.T @ rest)
                kept = np.column_stack([kept, rest / np.linalg.norm(rest)])
    return kept


def eigenpairs(multiply, width: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues, eigenvectors, residual norms, passes) of the `wanted` largest, `multiply(Q)` being the matrix times Q."""
    wanted = min(wanted, width)
    size = min(width, max(block, wanted))
    basis, split = orthonormal([np.random.default_rng(11).standard_normal((width, size))]), 0
    for done in range(1, rounds + 1):
        product = multiply(basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        pick = np.argsort(-values, kind="stable")[:size]
        values, turn = values[pick], turn[:, pick]
        iterate = basis @ turn
        residual = product @ turn - iterate * values
        error = np.linalg.norm(residual, axis=0)
        if (error[:wanted] <= tolerance * max(values[0], 0)).all():
            break
        behind = turn.copy()
        behind[:split] = 0  # what came from the iterate before
        moving = error > tolerance * max(values[0], 0) / 100
        split = iterate.shape[1]
        basis = orthonormal([iterate, residual[:, moving], (basis @ behind)[:, moving]])
    else:
        warnings.warn(f"residuals {error[:wanted].tolist()} after {rounds} passes", stacklevel=2)
    return values[:wanted], iterate[:, :wanted], error[:wanted], done


def train(embeddings: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of `embeddings`, and the fit list that it was made from."""
    width = embeddings.where(fits()).agg(F.max(F.size("embedding"))).first()[0] or 0
    fit = fit_list(embeddings, max(width, 1))
    n, sums = totals(fit, max(width, 1))
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, 0), fit
    mean = np.array([s / n for s in sums])
    trace = float(_summed(fit, len(mean), 1, lambda x: ((x - mean) ** 2).sum(0)[:, None]).sum()) / n
    if trace == 0:
        return Whitening(n, tuple(sums), np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0), 0.0, 0), fit
    values, vectors, error, passes = eigenpairs(lambda q: products(fit, n, mean, q), len(mean), components)
    real = values > FLAT * values[0]
    return Whitening(n, tuple(sums), vectors[:, real], values[real], error[real], trace, passes), fit


def identity_error(model: Whitening, fit: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, in a pass of its own."""
    mean, to, k = model.mean, model.vectors / np.sqrt(model.values), len(model.values)

    def of(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ to
        return np.vstack([w.T @ w, w.sum(0)])

    found = _summed(fit, len(mean), k, of) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exactly, or the largest long."""
    total = np.array(sums, object)
    most = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max((abs(float(s)) for s in sums), default=0.0)
    if most * most * max(1, x.shape[1]) < 2.0**62:
        d = n * x - total.astype(np.int64)
        return (d * d).sum(1)
    return np.array([min(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)), _MOST) for row in x], np.int64)


def _whitened(model: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, to, k = model.mean, model.vectors / np.sqrt(model.values), len(model.values)
        for batch in batches:
            x = _rows(batch["x"], len(mean))
            n, at = len(x), np.repeat(np.arange(len(x)), k)
            columns = [
                batch["vec_id"].take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), pa.array(deviations(x, model.n, model.sums)[at]),
                pa.array(((x - mean) @ to).ravel()), pa.array(np.tile(model.values / model.trace, n)), pa.array(np.full(n * k, error)), pa.array(np.tile(model.residuals / model.values, n)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual (over the eigenvalue): a row a vector and component."""
    model, fit = train(embeddings, components)
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = embeddings.where(fits()).select("vec_id", whole(len(model.sums)).alias("x"))
    return rows.mapInArrow(task(_whitened(model, identity_error(model, fit))), schema)
