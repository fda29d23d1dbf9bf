"""Embedding whitening: leading principal components by LOBPCG over rows that stay where they are.

Entries become whole numbers (floor(scale * c) + shift), so counts and sums are exact and centring,
(n * x - S) / n, rounds once. The covariance is never built: one pass over the rows multiplies it with a
block of columns, each task adds up its share of  sum of xc * (xc' B), and Spark sums the shares by
dimension. The driver holds blocks of dimensions x 3m numbers and does the Rayleigh-Ritz step on the basis
of iterate, residual and previous direction, with ``guard`` more columns than components asked for. It ends
when the residuals |V u - e u|, from a product computed afresh, are certified: each component asked for is below ``tolerance``
times the largest eigenvalue (or as near to it as rounding lets it come), or raises.

Defined cases: vectors that are null or hold null or non-finite entries take no part, nor do vectors of another
length than the most frequent one (ties: the shorter), for which no covariance with the others exists; a null id
stays; repeated rows count and are returned one by one; components whose eigenvalue is zero (fewer rows or
dimensions than components, equal vectors) do not exist and have no rows, so an empty table gives an empty one; a deviation beyond a
long is null; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm import blocks
from junctura.llm.scratch import stored

#: Rows of a batch that are worked on at once.
_STEP = 4096


def whole_vectors(vectors: DataFrame, scale: int, shift: int, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part, in whole numbers."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(v, lambda c: F.floor(c * scale) + shift)
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(fine).select("vec_id", x.alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("x").flatten().to_numpy().reshape(rows.num_rows, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            yield batch.slice(at, _STEP)


@dataclass
class Centre:
    """Number of rows and exact sums of each dimension."""

    n: int
    sums: np.ndarray
    most: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where these hold it, else as Python's integers."""
        if self.n * self.most < 2**62:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squared(self, x: np.ndarray) -> list[int | None]:
        """The sum of squared deviations of each row; None beyond a long."""
        d = self.deviations(x)
        if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**62:
            return (d * d).sum(1).tolist()
        return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in d)]


def centre(rows: DataFrame) -> Centre:
    """Counts and sums of `whole_vectors`, over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x = _matrix(part)
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, len(x))), pa.array(x.sum(0)), pa.array(np.abs(x).max(0))], ["at", "n", "s", "most"])

    total = rows.mapInArrow(blocks.released(partial), "at long, n long, s long, most long").groupBy("at")
    sums = total.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("most").alias("most")).orderBy("at").collect()
    exact = np.array([int(r["s"]) for r in sums], object)
    fits = all(abs(int(s)) < 2**62 for s in exact)
    return Centre(sums[0]["n"] if sums else 0, exact.astype(np.int64) if fits else exact, 2 * max((r["most"] for r in sums), default=0))


def _summed(rows: DataFrame, share, width: int) -> np.ndarray:
    """The sum over all rows of the matrices that ``share`` makes of a batch: by task first, then by matrix row."""
    columns = [f"c{k}" for k in range(width)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _slices(batches):
            one = share(_matrix(part))
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(c.copy()) for c in total.T)], ["at", *columns])

    sums = rows.mapInArrow(blocks.released(partial), "at long, " + ", ".join(f"{c} double" for c in columns))
    found = sums.groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("at").toArrow()
    return np.column_stack([found.column(c).to_numpy() for c in columns])


def product(rows: DataFrame, mean: Centre, block: np.ndarray) -> np.ndarray:
    """Covariance times ``block`` in one pass over the centred rows."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, block))

    def share(x: np.ndarray) -> np.ndarray:
        at, b = shared.value
        xc = at.centred(x)
        return xc.T @ (xc @ b)

    return _summed(rows, share, block.shape[1]) / mean.n


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what ``block`` adds to the orthonormal columns ``against``; directions lost to rounding go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        if not block.shape[1]:
            return block
        left, strength, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, strength > 1e-10 * max(1.0, strength[0])] if strength[0] > 1e-12 else left[:, :0]
    return block - against @ (against.T @ block)


@dataclass
class Components:
    """Unit eigenvectors as columns, their eigenvalues (falling), the trace, certified residuals and passes over the rows."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def lobpcg(multiply, d: int, k: int, trace: float, guard: int = 12, tolerance: float = 1e-14, most: int = 200, seed: int = 12) -> Components:
    """The k leading eigenpairs of a symmetric operator given by its products with blocks.

    The basis is kept orthonormal and all of it is multiplied in each pass, so images carry no rounding from pass to
    pass. A pair is certified below ``tolerance`` times the largest eigenvalue; where residuals no longer fall, at a
    thousand times that at most.
    """
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    basis, best, since, keep = x, np.inf, 0, None
    for passes in range(1, most + 1):
        image = multiply(basis)
        small = basis.T @ image
        e, c = np.linalg.eigh((small + small.T) / 2)
        c = c[:, ::-1][:, :m]
        old, x, e = x, basis @ c, e[::-1][:m]
        residual = image @ c - x * e
        size = np.linalg.norm(residual, axis=0)
        worst, scale = size[:k].max(), max(abs(e[0]), np.finfo(float).tiny)
        since = 0 if worst < 0.5 * best else since + 1
        if worst < best:
            best, keep = worst, Components(x[:, :k], e[:k], trace, size[:k], passes)
        if best <= tolerance * scale or (best <= 1000 * tolerance * scale and since >= 2):
            keep.passes = passes
            return keep
        x = np.linalg.qr(x)[0]
        direction = old - x @ (x.T @ old)
        basis = np.hstack([x, _orthonormal(residual, x)])
        basis = np.hstack([basis, _orthonormal(direction, basis)])
    raise ArithmeticError(f"residual {best:.3g} of eigenvalue {scale:.3g} after {most} passes")


def components(rows: DataFrame, mean: Centre, k: int, **options) -> Components:
    """The k leading components of all rows; those whose eigenvalue is zero are left out."""
    d = len(mean.sums)
    squares = _summed(rows, lambda x: np.array([[(mean.centred(x) ** 2).sum()]]), 1)[0, 0] if mean.n else 0.0
    trace = float(squares) / max(mean.n, 1)
    if trace <= 0:
        return Components(np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    found = lobpcg(lambda block: product(rows, mean, block), d, min(k, d), trace, **options)
    real = found.values > 1e-12 * found.values[0]
    u = found.vectors[:, real]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1, 1)
    return Components(u, found.values[real], trace, found.residuals[real], found.passes)


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100_000, column: str = "embedding", **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = stored(whole_vectors(vectors, scale, shift, column), "whole")
    mean = centre(rows)
    found = components(rows, mean, k, **options)
    k = len(found.values)
    turn = found.vectors / np.sqrt(found.values)
    shared = rows.sparkSession.sparkContext.broadcast((mean, turn, found.values / found.trace if k else found.values))

    def moments(x: np.ndarray) -> np.ndarray:
        at, b, _ = shared.value
        w = at.centred(x) @ b
        return np.vstack([w.T @ w, w.sum(0)])

    error = 0.0
    if k:
        sums = _summed(rows, moments, k) / mean.n
        error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, b, explained = shared.value
        for part in _slices(batches):
            x, n = _matrix(part), part.num_rows
            rows_of = pa.array(np.repeat(np.arange(n), k))
            ids, deviation = part.column("vec_id").take(rows_of), pa.array(at.squared(x), pa.int64()).take(rows_of)
            number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n))
            yield pa.RecordBatch.from_arrays(
                [ids, number, pa.array(np.full(n * k, at.n)), deviation, pa.array((at.centred(x) @ b).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(blocks.released(whitened), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
