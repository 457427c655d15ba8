"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (shares of kinds of characters, word lengths, repetition, line shapes) are standardised, mapped to
``features`` cosines that approximate a Gaussian kernel, and fitted by ridge regression: partitions sum their normal equations, the driver
solves one system of fixed size. Scores become probabilities by isotonic regression on labelled rows that the fit didn't see. At most
``max_train_rows`` labelled rows are drawn, by the hash of their text, among those not held out.

Defined cases: null and empty texts have zero statistics and are scored like any others; null labels teach nothing; a document with
several labels counts once for each; if the labels hold one class or none, every score is their mean, or 0.5; rows are never dropped or
merged; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textscan import by_bytes, row_ids, scan_words, text_buffer

#: The statistics, in the order of their columns.
STATISTICS = ("log_bytes", "log_words", "upper", "digit", "exclaim", "pipe", "symbol", "comma_stop", "other_mark", "above_ascii", "blank", "line_feed", "word_mean", "word_sd", "distinct", "repeats_last", "top_word", "capital_words", "log_line", "long_words")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = offsets.size - 1
    out = np.zeros((n, len(STATISTICS)))
    raw = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    size = np.diff(at)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])

    kinds = np.zeros(256, np.uint8)
    for code, text in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "|", "#$%&*@^~<>{}[]=+\\_/", ",."), 1):
        kinds[[ord(c) for c in text]] = code
    kinds[[c for c in range(33, 127) if not kinds[c] and not chr(c).isalnum()]] = 7
    kinds[128:] = 8
    kinds[[32, 9, 11, 12, 13]] = 9
    kinds[10] = 10
    kind = kinds[raw]
    counts = np.stack([share(kind == k) for k in range(1, 11)], 1)
    full = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    out[:, 2:12] = counts / full[:, None]
    starts, lengths, hashes, bounds = scan_words(data, offsets)
    words = np.diff(bounds)
    rows, many = row_ids(bounds), np.maximum(words, 1)
    out[:, 1] = np.log1p(words)
    mean = np.bincount(rows, lengths, n) / many
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(np.bincount(rows, lengths.astype(float) ** 2, n) / many - mean**2, 0))
    if hashes.size:
        order = np.lexsort((hashes, rows))
        r, h = rows[order], hashes[order]
        first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])))
        times = np.diff(np.append(first, r.size))
        out[:, 14] = np.bincount(r[first], minlength=n) / many
        top = np.zeros(n)
        np.maximum.at(top, r[first], times)
        out[:, 16] = top / many
        same = np.append(False, (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]))
        out[:, 15] = np.bincount(rows, same, n) / many
        head = data[starts]
        out[:, 17] = np.bincount(rows, (head >= 65) & (head <= 90), n) / many
        out[:, 19] = np.bincount(rows, lengths > 15, n) / many
    out[:, 18] = np.log1p(size / (counts[:, 9] + 1))
    return out


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id-free part of the work: all columns but the text, and its statistics."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*(F.col(f"`{c}`") for c in others), F.array(F.lit(0.0)).alias("statistics")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            found = statistics(*text_buffer(batch.column(batch.schema.get_field_index(text))))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(found.shape[0] + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), flat], [*others, "statistics"])

    return docs.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """Standardisation, frequencies and phases of the features, ridge weights, and the steps of the calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.frequencies = random.normal(size=(mean.size, features)) / width
        self.phases = random.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + mean.size + 1)
        self.edges, self.values = np.zeros(0), np.full(1, 0.5)

    def design(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.scale, -5, 5)
        return np.hstack([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / self.phases.size), z, np.ones((z.shape[0], 1))])

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.design(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics), self.edges, self.values) if self.edges.size else np.full(statistics.shape[0], self.values[0]), 0, 1)


def isotonic(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing means of neighbouring bins, by pooling adjacent violators."""
    stack: list[list[float]] = []
    for t, w in zip(total.tolist(), weight.tolist(), strict=True):
        stack.append([t, w, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            t, w, k = stack.pop()
            stack[-1] = [stack[-1][0] + t, stack[-1][1] + w, stack[-1][2] + k]
    return np.concatenate([np.full(int(k), t / w) for t, w, k in stack])


def fit(rows: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 7, bins: int = 200) -> Model:
    """``rows``: statistics, label (0 or 1), calibrates (whether the row serves the calibration)."""
    moments = rows.select(F.posexplode("statistics").alias("k", "x"), "label").groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg("label").alias("y")).orderBy("k").collect()
    if not moments:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), features, width, seed)
    model = Model(np.array([r["m"] for r in moments]), np.maximum([r["s"] for r in moments], 1e-6), features, width, seed)
    model.values = np.array([moments[0]["y"]])
    if not 0 < moments[0]["y"] < 1:
        return model
    size = model.weights.size
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = shared.value.design(_matrix(batch.column(0)))
            total += x.T @ np.hstack([x, batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"i": [key[0]], "row": pa.array([np.sum([np.array(r) for r in table.column("row").to_pylist()], 0)], pa.list_(pa.float64()))})

    fitted = rows.where("not calibrates").select("statistics", F.col("label").cast("double"))
    equations = fitted.mapInArrow(sums, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").toArrow().sort_by("i")
    if equations.num_rows:
        total = np.array(equations.column("row").to_pylist())
        model.weights = np.linalg.solve(total[:, :-1] + ridge * max(1.0, np.trace(total[:, :-1]) / size) * np.eye(size), total[:, -1])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.raw(_matrix(batch.column(0)))), batch.column(1)], ["raw", "label"])

    raw = rows.where("calibrates").select("statistics", F.col("label").cast("double")).mapInArrow(scored, "raw double, label double")
    low = raw.agg(F.min("raw").alias("a"), F.max("raw").alias("b")).first()
    if low["a"] is None:
        return model
    step = max((low["b"] - low["a"]) / bins, 1e-9)
    binned = raw.groupBy(F.floor((F.col("raw") - low["a"]) / step).alias("bin")).agg(F.avg("raw").alias("x"), F.sum("label").alias("t"), F.count(F.lit(1)).alias("w")).orderBy("bin").collect()
    # half a row of the mean in every bin keeps the ends inside (0, 1)
    weight = np.array([r["w"] for r in binned], float)
    total = np.array([r["t"] for r in binned], float)
    smooth = isotonic(total + 0.5 * moments[0]["y"], weight + 0.5)
    model.edges = np.array([r["x"] for r in binned])
    # a hair of slope orders scores inside a step
    model.values = smooth * 0.998 + 0.002 * (model.edges - low["a"]) / max(low["b"] - low["a"], 1e-9)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(labelled: DataFrame, most: int) -> DataFrame:
    """Of the rows with distinct ``draw`` (a hash of text and label) the ``most`` with the smallest ones; copies of a text count once.

    What is sorted for that is about twice as many rows, whatever the table: those whose hash lies in the share that twice as many distinct ones need.
    """
    n = labelled.select("draw").distinct().count()
    share = min(1.0, 2 * most / max(n, 1))
    few = labelled.where(F.shiftrightunsigned("draw", 32) <= int(share * (1 << 32)))
    return few.dropDuplicates(["draw"]).orderBy(F.shiftrightunsigned("draw", 32), "draw").limit(most)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_train_rows: int = 40_000, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``. At most ``max_train_rows`` distinct labelled texts serve the fit, a fourth of them its calibration."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("draw"))
    stats = materialize(with_statistics(base), "statistics")
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    labelled = stats.join(known, F.col("doc_id") == F.col("label_id")).where(~held_out()).select("statistics", "label", F.xxhash64("draw", "label").alias("draw"))
    rows = materialize(drawn(labelled, max_train_rows).select("statistics", "label", (F.pmod(F.xxhash64("draw"), F.lit(4)) == 0).alias("calibrates")), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = shared.value.score(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return stats.select("doc_id", held_out().alias("held_out"), "statistics").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
