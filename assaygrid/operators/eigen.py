"""Leading eigenpairs of symmetric item x item matrices that are never formed.

A matrix is known by its product with a block of vectors, which Spark adds up over the data: a task holds the items x
columns numbers of the block and of its own part of the product, and only those travel. A randomised block Krylov
subspace with restarts (Rayleigh-Ritz) finds the pairs at the upper end; the lower end is that of the negative matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Product = Callable[[np.ndarray], np.ndarray]

COLUMN_BYTES = 64 * 1024 * 1024  # of a block of vectors sent at once; at least one column is sent
PART = 4096  # items per row of a partial product
DENSE = 4_000_000  # numbers of a dense slab in a task


@dataclass(frozen=True)
class Eigen:
    """``values`` (largest first), ``vectors`` (items x k), the norms of A v - e v, and how often A was applied."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def leading(product: Product, n: int, k: int, seed: int = 1, oversample: int = 8, depth: int = 4, tol: float = 1e-10, rounds: int = 300) -> Eigen:
    """The ``k`` largest eigenvalues and their vectors; the driver holds items x (k + oversample) x depth x 2 numbers.

    A round grows the subspace by ``depth`` blocks, solves the small problem in it and starts again from the best
    vectors, until all residuals are below ``tol`` of the largest eigenvalue seen or the subspace is the whole space.
    """
    k = min(k, n)
    width = min(n, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    image, used = product(basis), 1
    for _ in range(rounds):
        vs, images = [basis], [image]
        for _ in range(depth - 1):
            grown = _orthogonal(images[-1], vs)
            if not grown.shape[1]:
                break
            vs.append(grown)
            images.append(product(grown))
            used += 1
        v, av = np.hstack(vs), np.hstack(images)
        small = v.T @ av
        theta, u = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(theta)[::-1][:width]
        basis, image, values = v @ u[:, best], av @ u[:, best], theta[best]
        residuals = np.linalg.norm(image[:, :k] - basis[:, :k] * values[:k], axis=0)
        if v.shape[1] == n or (residuals <= tol * max(np.abs(theta).max(), 1e-300)).all():
            break
    return Eigen(values[:k], basis[:, :k], residuals, used)


def _orthogonal(block: np.ndarray, vs: list[np.ndarray]) -> np.ndarray:
    """Orthonormal columns for what ``block`` adds to the span of ``vs``."""
    scale = max(float(np.linalg.norm(block, axis=0).max(initial=0.0)), 1e-300)
    for _ in range(2):
        for v in vs:
            block = block - v @ (v.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-11 * scale][:, : len(block) - sum(v.shape[1] for v in vs)]
    for v in vs:
        u = u - v @ (v.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def _summed(frame: DataFrame, add: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], None]) -> Product:
    """The product whose parts ``add(total, vectors, batch)`` puts together from the rows of ``frame``."""
    context = frame.sparkSession.sparkContext

    def product(q: np.ndarray) -> np.ndarray:
        n, out = len(q), np.zeros_like(q)
        step = max(1, COLUMN_BYTES // (8 * n))
        for at in range(0, q.shape[1], step):
            shared = context.broadcast(np.ascontiguousarray(q[:, at : at + step]))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                vectors = shared.value  # noqa: B023
                total = np.zeros_like(vectors)
                for batch in batches:
                    add(total, vectors, batch)
                for part, low in enumerate(range(0, len(total), PART)):
                    slab = total[low : low + PART]
                    if slab.any():
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([slab.ravel()], pa.list_(pa.float64()))], ["part", "total"])

            parts = frame.mapInArrow(run, "part int, total array<double>")
            sums = parts.groupBy("part").agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
            for row in sums.toLocalIterator():
                slab = np.array(row["total"]).reshape(-1, min(step, q.shape[1] - at))
                out[row["part"] * PART : row["part"] * PART + len(slab), at : at + step] = slab
            shared.unpersist()
        return out

    return product


def gram(rows: DataFrame) -> Product:
    """X'X for ``rows(idx array<int>, x array<double>)``: the places and values of each row of X."""

    def add(total: np.ndarray, q: np.ndarray, batch: pa.RecordBatch) -> None:
        sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        idx, x = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        step = max(1, DENSE // len(q))
        for low in range(0, len(sizes), step):
            high = min(low + step, len(sizes))
            a, b = ends[low], ends[high]
            slab = np.zeros((high - low, len(q)))
            slab[np.repeat(np.arange(high - low), sizes[low:high]), idx[a:b]] = x[a:b]
            total += slab.T @ (slab @ q)

    return _summed(rows.select("idx", "x"), add)


def symmetric(pairs: DataFrame) -> Product:
    """The symmetric matrix with zero diagonal of ``pairs(i int, j int, w double)``, each pair once."""

    def add(total: np.ndarray, q: np.ndarray, batch: pa.RecordBatch) -> None:
        i, j, w = (batch.column(c).to_numpy() for c in range(3))
        for c in range(q.shape[1]):
            total[:, c] += np.bincount(i, w * q[j, c], len(q)) + np.bincount(j, w * q[i, c], len(q))

    return _summed(pairs.select("i", "j", "w"), add)


def centred(product: Product, factor: float = 1.0) -> Product:
    """``factor`` J A J with J the removal of the mean."""

    def inner(q: np.ndarray) -> np.ndarray:
        y = product(q - q.mean(0))
        return factor * (y - y.mean(0))

    return inner
