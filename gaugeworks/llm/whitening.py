"""Whitened embeddings: principal components by spectral divide and conquer, then a broadcast projection.

Entries become integers, floor(64 c) + 1000000, so counts, sums and products are exact. All
tasks' sums and, in a second pass over the centred vectors, their products are added up; the
covariance, of the size of one vector squared, is split into components on the driver, and the
small projection goes to all tasks.

Rows whose vector is NULL or holds NULL or non-finite entries are left out, as are vectors of
another length than most. Integers stop at 2^40 either way. Repeated rows and NULL vec_ids are rows like
others. Components without variance (up to rounding) have no scale to divide by and are not
returned: a table of equal vectors, like an empty one, gives no rows. Equal eigenvalues have no
order: any basis of their space. A deviation that a long cannot hold is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm.batches import bounded
from gaugeworks.llm.qdwh import leading_eigenvectors
from gaugeworks.llm.vector_batches import array_sum, clean_vectors, floored, matrix

FACTOR = 64
OFFSET = 1_000_000
MOST = 1 << 40
COMPONENTS = 32
_LONG = 2.0**63
_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: number and sums of the fit list, and the components' projection."""

    n: int
    sums: np.ndarray  # of the integers without the offset
    shift: np.ndarray  # whole numbers next to the means
    projection: np.ndarray  # a column for each component, divided by its standard deviation
    explained: np.ndarray

    def apply(self, vectors: np.ndarray) -> np.ndarray:
        near = floored(vectors, FACTOR, MOST) - self.shift
        centred = near - (self.sums - self.n * self.shift) / self.n
        # not a matrix product, whose last bits differ with a row's place in its batch
        return np.einsum("nd,dk->nk", centred, self.projection)

    def deviations(self, vectors: np.ndarray) -> list[int | None]:
        """Sums of the squares of n x - S."""
        apart = self.n * (floored(vectors, FACTOR, MOST) - self.shift) - (self.sums - self.n * self.shift)
        about = (apart.astype(float) ** 2).sum(axis=1)
        if about.max(initial=0) < _LONG / 2:
            return (apart * apart).sum(axis=1).tolist()
        exact = (sum(x * x for x in row) for row in apart.tolist())
        return [x if x < _LONG else None for x in exact]


def fit(vectors: DataFrame, length: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``vectors`` (vector); None if there is nothing to whiten."""
    counted = array_sum(
        vectors, length, lambda v: np.append(floored(v, FACTOR, MOST).sum(axis=0), len(v)), "i8"
    )
    if counted is None or not length:
        return None
    sums, n = counted[0, :-1], int(counted[0, -1])
    shift = np.rint(sums / n).astype(np.int64)

    def products(v: np.ndarray) -> np.ndarray:
        near = (floored(v, FACTOR, MOST) - shift).astype(float)
        return near.T @ near

    # whole numbers, hence exact as long as they stay below 2^53
    mean = (sums - n * shift) / n
    covariance = array_sum(vectors, length, products, "f8") / n - np.outer(mean, mean)
    values, found = leading_eigenvectors(covariance, min(components, length))
    kept = values > length * np.finfo(float).eps * max(values.max(initial=0), 0)
    total = np.trace(covariance)
    if not kept.any() or total <= 0:
        return None
    return Whitening(n, sums, shift, found[:, kept] / np.sqrt(values[kept]), values[kept] / total)


def identity_error(vectors: DataFrame, length: int, model: Whitening) -> float:
    """Largest distance between the whitened vectors' covariance, measured over all, and the identity."""

    def moments(v: np.ndarray) -> np.ndarray:
        white = model.apply(v)
        return np.vstack([white.sum(axis=0), white.T @ white])

    found = array_sum(vectors, length, moments, "f8") / model.n
    covariance = found[1:] - np.outer(found[0], found[0])
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every row's value on every component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors, length = clean_vectors(bounded(table), vector, key)
    model = fit(vectors, length, components)
    if model is None:
        return table.sparkSession.createDataFrame([], _SCHEMA)
    error = identity_error(vectors, length, model)
    k = model.projection.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1), length)
            each = np.repeat(np.arange(len(v)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), len(v)), pa.int32()),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(model.deviations(v), pa.int64()).take(pa.array(each)),
                    pa.array(model.apply(v).ravel()),
                    pa.array(np.tile(model.explained, len(v))),
                    pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    ids = vectors.selectExpr(f"CAST(`{key}` AS LONG) AS vec_id", "vector")
    return ids.mapInArrow(run, _SCHEMA)
