"""Columns of vectors: which rows take part, their Arrow form as matrices, and merging what tasks have summed."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a matrix that a task works on at once.
ENTRIES = 1 << 20


def usable(vectors: DataFrame, vec_id: str, embedding: str, *others: str) -> DataFrame:
    """vec_id, embedding (as doubles) and ``others`` of the rows whose vector is neither null nor empty and holds only finite entries."""
    x = F.col("embedding")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"), *(F.col(f"`{c}`").alias(c) for c in others))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(x.isNotNull() & (F.size(x) > 0)).where(F.coalesce(finite, F.lit(False)))


def usual_dimension(rows: DataFrame) -> tuple[int, int]:
    """The dimension of most vectors (of those that tie the largest) and how many have it; (0, 0) without vectors."""
    found = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (found["d"], found["count"]) if found else (0, 0)


def matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with the matrix of their vectors, which all have one dimension, at most ``ENTRIES`` entries or one row at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(batch.num_rows, -1)
        step = max(1, ENTRIES // x.shape[1])
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step), x[k : k + step]


def tree_merge(rows: DataFrame, summarise: Callable[[Iterator[pa.RecordBatch]], object], add: Callable[[object, object], object]) -> object:
    """What ``summarise`` makes of each task's rows, merged over a tree of tasks; None if no task had rows.

    A summary must have a size that doesn't grow with the rows. Each level of the tree merges about the square root of the level below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = summarise(batches)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def both(a: object, b: object) -> object:
        return b if a is None else a if b is None else add(a, b)

    states = rows.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return states.treeAggregate(None, both, both, 2)


def moments_of(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and centred outer products."""
    mean = x.mean(0)
    return x.shape[0], mean, (x - mean).T @ (x - mean)


def add_moments(a: tuple, b: tuple) -> tuple:
    """Rows, mean and centred outer products of both parts together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def covariance_of(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """n, mean and covariance of a column of vectors of one dimension: a matrix a task, merged over a tree of tasks; None without rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        total = None
        for _, x in matrices(batches, 0):
            total = moments_of(x) if total is None else add_moments(total, moments_of(x))
        return total

    found = tree_merge(rows, sums, add_moments)
    return found and (found[0], found[1], found[2] / found[0])
