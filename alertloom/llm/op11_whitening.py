"""Whitening of embeddings: centred on the mean, turned to the principal axes, and scaled to unit variance along each.

Three passes fit it. Entries become integers, whose sums are exact in any order, so the mean is exact. The second pass sums the outer products of the
centred rows, a matrix product a run of rows; the third does the same with what whitening made of the rows, and measures how far its covariance
is from the identity. Tasks' sums are merged over a tree of tasks. LAPACK's symmetric eigensolver gives the axes, and the projection is broadcast: its
size is the dimension times the components, whatever the number of rows.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part, nor do vectors of another dimension than most (of
dimensions that tie, the largest); rows that repeat count each, and rows without vec_id are whitened like any other; an entry beyond 2**53 / 64 counts as
that; along an axis without variance ``whitened`` is null; a deviation beyond a long is null; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import add_moments, matrices, moments_of, tree_merge, usable, usual_dimension

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 53
_LOW = 27


def integers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64) + OFFSET


@dataclass
class Whitening:
    """n vectors with the sums of their integers; ``values`` and ``axes`` (a column each) by falling variance."""

    n: int
    sums: list[int]
    reach: int
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: as longs, or as Python's integers where longs or their squares' sum could overflow."""
        middle = np.array([s // self.n for s in self.sums], object)
        rest = np.array(self.sums, object) - self.n * middle
        most = self.n * (2 * self.reach + 1)
        kind = np.int64 if len(self.sums) * most * most < 1 << 63 else object
        return self.n * (x.astype(kind) - middle.astype(kind)) - rest.astype(kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    @property
    def varies(self) -> np.ndarray:
        """Whether an axis has variance beyond what rounding leaves."""
        return self.values > max(self.values.sum(), 0) * self.values.size * 2.0**-48

    def project(self, centred: np.ndarray, components: int) -> np.ndarray:
        """NaN along axes without variance."""
        e = np.where(self.varies, self.values, np.nan)[:components]
        return centred @ self.axes[:, :components] / np.sqrt(e)


def _sums(batches: Iterator[pa.RecordBatch]) -> tuple | None:
    """Rows, sums and the largest absolute integer; high and low bits are summed apart, so no sum overflows."""
    n, high, low, reach = 0, 0, 0, 0
    for _, x in matrices(batches, 0):
        x = integers(x)
        n, high, low = n + x.shape[0], high + (x >> _LOW).sum(0), low + (x & ((1 << _LOW) - 1)).sum(0)
        reach = max(reach, int(np.abs(x).max()))
    return (n, [(int(h) << _LOW) + int(v) for h, v in zip(high, low, strict=True)], reach) if n else None


def _add_sums(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)], max(a[2], b[2])


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """``rows``: a column of vectors of one dimension. None without rows."""
    found = tree_merge(rows, _sums, _add_sums)
    if found is None:
        return None
    model, context = Whitening(*found), rows.sparkSession.sparkContext
    shared = context.broadcast(model)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, x in matrices(batches, 0):
            c = shared.value.centred(integers(x))
            total = c.T @ c if total is None else total + c.T @ c
        return total

    covariance = tree_merge(rows, products, lambda a, b: a + b) / model.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    axes = axes[:, ::-1]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) < 0, -1, 1)
    model.values, model.axes = values[::-1].copy(), axes
    fitted = context.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        total = None
        for _, x in matrices(batches, 0):
            w = fitted.value.project(fitted.value.centred(integers(x)), components)[:, fitted.value.varies[:components]]
            total = moments_of(w) if total is None else add_moments(total, moments_of(w))
        return total

    n, _, outer = tree_merge(rows, moments, add_moments)
    model.identity_error = float(np.abs(outer / n - np.eye(outer.shape[0])).max(initial=0.0))
    return model


def whiten(vectors: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """vec_id, deviation and whitened (an array of up to ``components`` entries) of each vector that takes part, and what was fitted."""
    rows = usable(vectors, vec_id, embedding)
    d, _ = usual_dimension(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    rows = rows.where(F.size("embedding") == d)
    model = fit(rows.select("embedding"), components) if d else None
    if model is None:
        return rows.sparkSession.createDataFrame([], schema), None
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, 1):
            t = shared.value.deviations(integers(x))
            squares = (t * t).sum(1)
            far = pa.array(squares) if squares.dtype != object else pa.array([v if v < 1 << 63 else None for v in squares], pa.int64())
            w = shared.value.project(t.astype(np.float64) / shared.value.n, components)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), far, lists], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "embedding").mapInArrow(run, schema), model


def whitened_components(vectors: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    rows, model = whiten(vectors, components, vec_id, embedding)
    if model is None:
        return rows.select("vec_id", F.posexplode("whitened").alias("component", "whitened"), "deviation").select("vec_id", "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    trace = model.values.sum()
    shares = F.array(*(F.lit(float(e / trace) if trace > 0 else 0.0) for e in np.maximum(model.values[:components], 0)))
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(model.identity_error).alias("identity_error"))
