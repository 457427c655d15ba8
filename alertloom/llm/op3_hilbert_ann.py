"""Approximate nearest neighbours on shifted space-filling curves.

Every vector is projected to a few dimensions, shifted, and placed on a Hilbert curve; several such curves order all vectors. The directions are drawn
at random, but weighed by the covariance of the vectors (summed by task, merged over a tree of tasks), so that they lie where vectors differ; each
is scaled by its own deviation. Vectors with structure so get curves that follow it; without structure, any direction is as good.
The curves are range-partitioned and sorted by Spark, which gives each vector a position on each. The candidates of a query are the vectors
within ``window`` positions of it on any curve; blocks of neighbouring positions are reranked by exact distance and merged.

The window is measured, not guessed: for a bounded sample of queries the exact neighbours are found in blocks, and the window is the
distance on the nearest curve within which ``recall`` of them lie, half as much again. Vectors without structure need wide windows.

Equal vectors count as one, with the k + 1 smallest of their ids, so large groups of copies cost nothing and ties go to smaller ids.

Defined cases: vectors that are null, zero, of another dimension than most, or with null or non-finite components take no part; with fewer
than k others, all are returned; rows without vec_id take no part; a repeated vec_id is a candidate once for each distinct vector; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .vectors import covariance_of

_FOUND = "qid long, cid long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below 2**bits, by undoing rotations and reflections bit by bit."""
    x = cells.astype(np.int64).T.copy()
    n = x.shape[0]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0))


def _nearest(queries: np.ndarray, rows: np.ndarray, wanted: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows among the ``wanted`` nearest (all that tie with the last) and their distances, in double precision."""
    out = []
    for q in queries:
        d = np.sqrt(((rows - q) ** 2).sum(1))
        at = np.arange(d.size) if d.size <= wanted else np.flatnonzero(d <= np.partition(d, wanted - 1)[wanted - 1])
        out.append((at, d[at]))
    return out


def directions(covariance: np.ndarray, curves: int, dimensions: int, random: np.random.Generator) -> list[np.ndarray]:
    """For each curve, orthogonal directions drawn from a normal distribution with that covariance: axes of large variance are drawn more."""
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    weighed = axes * np.sqrt(np.maximum(values, values.max(initial=0) * 1e-6 + 1e-12))
    return [np.linalg.qr(weighed @ random.normal(size=(values.size, dimensions)))[0] for _ in range(curves)]


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, curves: int = 24, dimensions: int = 9, bits: int = 6, recall: float = 0.95, sample_queries: int = 64, block: int = 2048, seed: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. Queries: the ids that ``every`` divides."""
    spark = vectors.sparkSession
    rows = _usable(vectors, vec_id, embedding)
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = usual["d"]
    ids = rows.where(F.size("embedding") == d).distinct()
    own = Window.partitionBy("embedding").orderBy("vec_id")
    # a class of equal vectors: its id is its smallest vec_id, and its k + 1 smallest ids can be results
    first = ids.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= k + 1)
    classes = materialize(first.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = ids.where(F.col("vec_id") % every == 0).join(classes.select("embedding", "cid"), "embedding").select(F.col("vec_id").alias("query_id"), "cid")
    asked = materialize(asked, "asked")
    total = classes.count()
    random = np.random.default_rng(seed)
    _, middle, covariance = covariance_of(classes.select("embedding")) or (0, np.zeros(d), np.eye(d))
    turns = directions(covariance, curves, min(d, dimensions), random)
    scales = [3 * np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, covariance, turn), 1e-24)) for turn in turns]
    shifts = random.uniform(0, 1, (curves, min(d, dimensions)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stack(batch.column(1)) - middle
            for c, (turn, scale, shift) in enumerate(zip(turns, scales, shifts, strict=True)):
                y = x @ turn / scale  # most are between -1 and 1
                cell = np.clip(((y + 1) / 2 + shift) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(hilbert(cell, bits)), batch.column(0)], ["curve", "key", "cid"])

    placed = classes.select("cid", "embedding").mapInArrow(place, "curve int, key long, cid long")
    order = placed.repartitionByRange("curve", "key", "cid").sortWithinPartitions("curve", "key", "cid").withColumn("row", F.monotonically_increasing_id())
    order = materialize(order, "curves")
    part = F.shiftright("row", 33)
    starts = order.groupBy("curve", part.alias("part")).agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = order.withColumn("part", part).join(F.broadcast(starts), ["curve", "part"])
    positions = materialize(joined.select("curve", "cid", (F.col("base") + F.col("row") - F.col("least")).alias("pos")), "positions")
    queries = materialize(asked.select("cid").distinct().join(classes.select("cid", "embedding"), "cid").select(F.col("cid").alias("qid"), "embedding"), "queries")
    window = _window(queries, classes, positions, k, recall, sample_queries)
    size = max(block, window // 2)
    ahead = queries.join(positions.withColumnRenamed("cid", "qid"), "qid")
    reached = F.sequence(F.floor((F.greatest(F.lit(0), F.col("pos") - window)) / size), F.floor((F.col("pos") + window) / size))
    asking = ahead.select("curve", F.explode(reached).alias("block"), F.col("qid").alias("id"), "pos", "embedding", F.lit(True).alias("asks"))
    within = positions.join(classes.select("cid", "embedding"), "cid").select("curve", F.floor(F.col("pos") / size).alias("block"), F.col("cid").alias("id"), "pos", "embedding", F.lit(False).alias("asks"))

    def rerank(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, pos, x = table.column("id").to_numpy(), table.column("pos").to_numpy(), _stack(table.column("embedding").combine_chunks())
        order = np.argsort(pos[~asks])
        rows, at, names = x[~asks][order], pos[~asks][order], ids[~asks][order]
        found = []
        for qid, p, q in zip(ids[asks].tolist(), pos[asks].tolist(), x[asks], strict=True):
            low, high = np.searchsorted(at, [p - window, p + window + 1])
            for hit, far in _nearest(q[None], rows[low:high], k + 1):
                found.append((np.full(hit.size, qid), names[low:high][hit], far))
        if not found:
            return pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table(dict(zip(("qid", "cid", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    candidates = asking.unionByName(within).groupBy("curve", "block").applyInArrow(rerank, _FOUND)
    return _answer(candidates, asked, classes, k, total)


def _answer(candidates: DataFrame, asked: DataFrame, classes: DataFrame, k: int, total: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy("score", "cid")
    few = candidates.dropDuplicates(["qid", "cid"]).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    named = few.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    answers = asked.join(named, F.col("cid") == F.col("qid")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return answers.withColumn("rank", F.row_number().over(rank).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(queries: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """qid, cid, score: the k nearest other classes of a bounded set of queries, held against all rows in blocks."""
    asked = queries.toArrow()
    names, x = asked.column("qid").to_numpy(), _stack(asked.column("embedding").combine_chunks()) if asked.num_rows else np.zeros((0, 1))
    shared = classes.sparkSession.sparkContext.broadcast((names, x))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = shared.value
        for batch in batches:
            if batch.num_rows and names.size:
                ids = batch.column(0).to_numpy()
                for name, (at, far) in zip(names.tolist(), _nearest(x, _stack(batch.column(1)), k + 1), strict=True):
                    other = ids[at] != name
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(other.sum()), name)), pa.array(ids[at][other]), pa.array(far[other])], ["qid", "cid", "score"])

    best = Window.partitionBy("qid").orderBy("score", "cid")
    return classes.select("cid", "embedding").mapInArrow(search, _FOUND).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")


def _window(queries: DataFrame, classes: DataFrame, positions: DataFrame, k: int, recall: float, sample: int) -> int:
    """Positions within which ``recall`` of the exact neighbours of sampled queries lie on their nearest curve, half as much again."""
    drawn = queries.orderBy(F.xxhash64("qid"), "qid").limit(sample)
    near = materialize(exact_neighbours(drawn, classes, k).select("qid", "cid"), "exact")
    few = F.broadcast(near)
    a = positions.join(F.broadcast(near.select(F.col("qid").alias("cid")).distinct()), "cid").select(F.col("cid").alias("qid"), "curve", F.col("pos").alias("p"))
    b = positions.join(few, "cid").select("qid", "cid", "curve", "pos")
    apart = b.join(a, ["qid", "curve"]).groupBy("qid", "cid").agg(F.min(F.abs(F.col("pos") - F.col("p"))).alias("apart"))
    found = apart.agg(F.percentile("apart", F.lit(recall))).first()[0]
    return 64 if found is None else max(64, int(found * 1.5) + 1)
