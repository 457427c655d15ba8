"""Vectors as short codes: each part of a vector is replaced by the nearest of a few entries of that part's codebook.

All arithmetic that decides is on integers, so results don't depend on how rows are dealt. Entries are filtered before distances are computed. For a
block of s positions with means a, b and residual norms p, q of two vectors, their squared distance there is at least s(a - b)^2 + (p - q)^2. Summed
over one block, two blocks, four blocks and so on, these bounds rise towards the distance; an entry goes as soon as its bound passes the distance of the entry
with the smallest first bound, by more than rounding can explain. What survives gets its exact integer distance.

A round is one pass: tasks sum and count their rows by part and entry, and a tree of tasks adds that up.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do vectors of another dimension than most (of
dimensions that tie, the largest); a dimension that isn't a multiple of the parts is filled up with zeros; integers beyond sqrt(2**62 / dimension) / 2 count as that, so no
distance overflows; rows that repeat count each; codebooks start from rows with a vec_id as long as there are enough, rows with equal vec_id by their
integers, and have fewer entries if there are fewer rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .vectors import matrices, tree_merge, usable, usual_dimension

#: Groups of labels whose sums are broadcast; beyond it only those of the few largest are.
BROADCAST_LABELS = 100_000


class Blocks:
    """Means and residual norms of the rows of a matrix in 1, 2, 4, ... blocks of equal size."""

    def __init__(self, x: np.ndarray):
        self.levels, m, blocks = [], x.shape[1], 1
        while m % blocks == 0 and blocks < m:
            y = x.reshape(x.shape[0], blocks, -1).astype(np.float64)
            mean = y.mean(2)
            self.levels.append((m // blocks, mean, np.sqrt(((y - mean[:, :, None]) ** 2).sum(2))))
            blocks *= 2
        self.squares = (x.astype(np.float64) ** 2).sum(1)

    def bound(self, level: int, rows, other: Blocks, entries) -> np.ndarray:
        """Lower bounds of squared distances, less what rounding may have added."""
        (size, a, p), (_, b, q) = self.levels[level], other.levels[level]
        least = (size * (a[rows] - b[entries]) ** 2 + (p[rows] - q[entries]) ** 2).sum(-1)
        return least - 1e-12 * (self.squares[rows] + other.squares[entries])


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the nearest entry (the first of those that tie), its squared distance, and how many exact distances that took."""
    if x.shape[1] == 1:
        far = (x - book.T) ** 2
        return far.argmin(1), far.min(1), far.size
    rows, entries = Blocks(x), Blocks(book)
    every = np.arange(book.shape[0])
    bounds = rows.bound(0, np.arange(x.shape[0])[:, None], entries, every[None])
    first = bounds.argmin(1)
    best = ((x - book[first]) ** 2).sum(1)
    alive = bounds <= best[:, None]
    alive[np.arange(x.shape[0]), first] = False
    row, entry = np.nonzero(alive)
    for level in range(1, len(rows.levels)):
        stays = rows.bound(level, row, entries, entry) <= best[row]
        row, entry = row[stays], entry[stays]
    far = np.full(bounds.shape, np.iinfo(np.int64).max)
    far[np.arange(x.shape[0]), first] = best
    far[row, entry] = ((x[row] - book[entry]) ** 2).sum(1)
    code = far.argmin(1)
    return code, far[np.arange(x.shape[0]), code], x.shape[0] + row.size


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """rows, parts, positions: 64-bit integers."""
    return x.astype(np.int64).reshape(x.shape[0], parts, -1)


def train(rows: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """``rows``: vec_id, x (integers). Codebooks: part, entry, position."""
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    books = _split(np.array([r["x"] for r in start]), parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> tuple | None:
            sums, counts = np.zeros_like(shared.value), np.zeros(shared.value.shape[:2], np.int64)
            for _, x in matrices(batches, 0):
                y = _split(x, parts)
                for k in range(parts):
                    code, _, _ = nearest_entries(y[:, k], shared.value[k])
                    np.add.at(sums[k], code, y[:, k])
                    counts[k] += np.bincount(code, minlength=counts.shape[1])
            return (sums, counts) if counts.any() else None

        sums, counts = tree_merge(rows.select("x"), count, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        moved = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        if (moved == books).all():
            break  # further rounds would change nothing
        books = moved
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _with_label_sums(coded: DataFrame) -> DataFrame:
    """Adds label_error. Every label's sum is known after one aggregation; rows of labels that are common meet it without a shuffle."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-sums")
    size = sums.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).first()
    of = sums.select(F.col("label").alias("of"), "label_error", "n")
    same = F.col("label").eqNullSafe(F.col("of"))
    if size["labels"] <= BROADCAST_LABELS:
        return coded.join(F.broadcast(of), same).drop("of", "n")
    common = F.col("n") * 1000 > size["rows"]
    hot = coded.join(F.broadcast(of.where(common)), same, "left")
    rest = hot.where(F.col("n").isNull()).drop("of", "label_error", "n").join(of.where(~common), same)
    return hot.where(F.col("n").isNotNull()).drop("of", "n").unionByName(rest.drop("of", "n"))


def encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, code (two hex digits a part), error, label and label_error of each vector that takes part, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = usable(vectors, vec_id, embedding, label)
    d, _ = usual_dimension(rows)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {fields['vec_id']}, label {fields[label]}, code string, error long"
    if not d:
        return rows.sparkSession.createDataFrame([], f"{schema}, label_error long"), np.zeros((parts, 0, 0), np.int64)
    largest = float(isqrt((1 << 62) // d) // 2)
    whole = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(largest)), F.lit(-largest))).cast("int"))
    full = F.concat(whole, F.array_repeat(F.lit(0), -d % parts))
    kept = materialize(rows.where(F.size("embedding") == d).select("vec_id", F.col(label).alias("label"), full.alias("x")), "integers")
    books = train(kept.select("vec_id", "x"), parts, entries, rounds)
    shared = kept.sparkSession.sparkContext.broadcast(books)
    hexes = np.array([f"{k:02x}" for k in range(256)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, 2):
            y, code, error = _split(x, parts), "", 0
            for k in range(parts):
                at, far, _ = nearest_entries(y[:, k], shared.value[k])
                code, error = code + hexes[at], error + far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = materialize(kept.select("vec_id", "label", "x").mapInArrow(run, schema), "codes")
    return _with_label_sums(coded), books


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = encode(vectors, **options)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """All columns of ``codes`` and the integers that its column code stands for, as ``decoded``."""
    parts = [F.array(*(F.array(*(F.lit(int(v)) for v in entry)) for entry in book)) for book in books]
    pick = [F.get(part, F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")) for k, part in enumerate(parts)]
    return codes.withColumn("decoded", F.concat(*pick))
