"""Vectors of whole numbers: which rows take part, their length, and exact inner products in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one side of a tile, and of one strip of its scores.
TILE_BYTES = 8 << 20


def finite(x: Column) -> Column:
    """Whether a vector is there, not empty, and all its components are finite numbers."""
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def floored(x: Column, scale: int) -> Column:
    """Components as floor(scale * x), held as doubles."""
    return F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))


def of_one_length(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """*rows* whose vector has the length of the one with the smallest id (nulls last), and that length; 0 if there are no rows."""
    first = rows.orderBy(F.col(vec_id).asc_nulls_last(), vector).select(F.size(vector)).first()
    return (rows.filter(F.size(vector) == first[0]), first[0]) if first else (rows, 0)


def rows_of(dim: int, most: int) -> int:
    """Vectors of *dim* components on one side of a tile: TILE_BYTES of them, *most* at most."""
    return max(1, min(most, TILE_BYTES // (8 * max(1, dim))))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix; without rows it has no columns either."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return pa.concat_arrays([c.flatten() for c in chunks]).to_numpy(zero_copy_only=False).reshape(n, -1)


def score_strips(q: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row and exact scores (long) of strips of the queries *q* against all of *v*, TILE_BYTES at a time.

    Sums are worked out in float64 while they are exact in it, in Python integers otherwise; one that does not fit a
    long is an error.
    """
    exact = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, v.shape[1]) < 2.0**53
    step = max(1, TILE_BYTES // (8 * max(1, len(v))))
    other = v.T if exact else v.astype(object).T
    for at in range(0, len(q), step):
        part = q[at : at + step]
        if exact:
            yield at, (part @ other).astype(np.int64)
        else:
            scores = np.array(part.astype(object) @ other)
            if max(scores.max(initial=0), -scores.min(initial=0)) >= 2**63:
                raise OverflowError("an inner product does not fit a long")
            yield at, scores.astype(np.int64)


def best_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's *k* best allowed scores, ties to the smaller id, in that order."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores[~allowed] = -np.iinfo(np.int64).max
    take = scores.shape[1] - min(k, scores.shape[1])
    edge = np.partition(scores, take, axis=1)[:, take : take + 1]  # the k-th best; equal ones stay for the tie rule
    rows, cols = np.nonzero((scores >= edge) & allowed)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]
