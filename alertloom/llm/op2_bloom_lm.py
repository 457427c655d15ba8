"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised on a log scale. The filter holds (n-gram, level) for every level up to
its own, pairs seen once included; a worker finds a count by probing one level after the other until a probe fails. The probability of a
word is Bayesian with a Dirichlet prior along the single words,

    P(w|v) = (c(vw) + k P(w)) / (c(v) + k),

with the fixed parameter k = ``prior``; P(w) shares out the mass of words seen once among unseen words. Nothing is fitted on a sample.

N-grams are dealt into shards by the first bits of their hashes, and each shard has its own part of the filter. Map tasks add up runs of
about three million tokens and send a shard its hashes and counts as two packed columns, so a shard is one group of a size that follows from
the text (``SHARD`` bytes of it), whatever the texts are. The filter grows with the counts. Up to ``broadcast_bytes`` (if not given, the
bound that the session has for joins) filter and word counts are broadcast; beyond that they stay a table of shards: blocks of texts send
their distinct n-grams to the shards and get levels and counts back. Scores are the same on either way.

The unigram ``base_score`` has exact counts of words (64-bit hashes). Pairs are told apart by 48 bits and those that choose the shard.

Defined cases: words are lower-cased (A-Z); a null text has the end token only; rows without doc_id are trained on; without training texts
every word is unseen; rows with equal doc_id and text get equal scores, each its own row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textscan import by_bytes, distinct, mix, row_ids, scan_words, text_buffer

_U = np.uint64
_I = np.int64
END = mix(np.array([0xE0D], _U))[0] & ~_U(1)
BEGIN = mix(np.array([0xBE61], _U))[0] & ~_U(1)
PROBES = 4
#: Bytes of text for one shard of the filter and for one block of texts. Beyond ``SHARDS`` of them, shards get up to eight times as much.
SHARD, SHARDS = 16 << 20, 4096
#: Smallest count of each level, from level 1.
STEPS = np.unique(np.ceil(1.5 ** np.arange(0, 100)).astype(np.float64))
#: What a level stands for, from level 0.
VALUES = np.concatenate([[0.0], (STEPS[:-1] + STEPS[1:] - 1) / 2, STEPS[-1:]])
_LOW = _U((1 << 48) - 1)


def level_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, n, "right")


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (words, then the end, of each row; even numbers), the token before each, and the bounds of the rows."""
    _, _, words, bounds = scan_words(data, offsets)
    tokens = np.insert(words & ~_U(1), bounds[1:], END)
    bounds = bounds + np.arange(bounds.size)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = BEGIN
    return tokens, before, bounds


def pairs_of(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Odd numbers."""
    return mix(before * _U(0x9E3779B97F4A7C15) + tokens) | _U(1)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def shard_bits(text_bytes: int) -> int:
    """The shards' number is 2 to this power."""
    n = -(-text_bytes // SHARD)
    return min(40, (n if n <= SHARDS else max(SHARDS, -(-n // 8))).bit_length())


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(_I) if bits else np.zeros(h.size, _I)


def _cuts(h: np.ndarray, bits: int, shards: np.ndarray) -> np.ndarray:
    """Where each of the shards begins among sorted hashes, and where the last one ends."""
    of = _shard(h, bits)
    return np.append(np.searchsorted(of, shards), np.searchsorted(of, shards[-1:], "right")) if shards.size else np.zeros(1, _I)


def _pack_pairs(h: np.ndarray) -> bytes:
    return h.astype(np.uint32).tobytes() + (h >> _U(32)).astype(np.uint16).tobytes()


def _unpack_pairs(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(_U) | (np.frombuffer(data, np.uint16, n, 4 * n).astype(_U) << _U(32))


def _places(key: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of (n-gram, level) in a shard of ``size`` bits."""
    g = mix(key + np.asarray(level).astype(_U) * _U(0xA0761D6478BD642F))
    high, low, size = g >> _U(32), (g & _U(0xFFFFFFFF)) | _U(1), np.asarray(size).astype(_U)
    for k in range(PROBES):
        yield ((((high + _U(k) * low) & _U(0xFFFFFFFF)) * size) >> _U(32)).astype(_I)


def shard_table(texts: DataFrame, bits: int, bits_each: int = 10) -> DataFrame:
    """A row a shard that has n-grams: shard, bits (of the filter), words (sorted hashes) and their counts, and sums. ``texts``: one column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            word, times = np.unique(np.concatenate(words), return_counts=True)
            pair, pair_times = np.unique(np.concatenate(pairs), return_counts=True)
            more = -(-pair_times // 255)  # a count takes one byte; larger ones are several entries
            if (more > 1).any():
                last = np.cumsum(more) - 1
                pair, one = np.repeat(pair, more), np.full(int(more.sum()), 255, _I)
                one[last] = pair_times - 255 * (more - 1)
                pair_times = one
            shards = distinct(np.concatenate([_shard(word, bits), _shard(pair, bits)]))
            a, b = _cuts(word, bits, shards).tolist(), _cuts(pair, bits, shards).tolist()
            times, pair_times = times.astype(np.uint32), pair_times.astype(np.uint8)
            columns = ([word[i:j].tobytes() for i, j in zip(a[:-1], a[1:], strict=True)], [times[i:j].tobytes() for i, j in zip(a[:-1], a[1:], strict=True)], [_pack_pairs(pair[i:j]) for i, j in zip(b[:-1], b[1:], strict=True)], [pair_times[i:j].tobytes() for i, j in zip(b[:-1], b[1:], strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(shards), *(pa.array(c, pa.binary()) for c in columns)], ["shard", "words", "times", "pairs", "pair_times"])

        words, pairs, size = [], [], 0
        for batch in by_bytes(batches, "text", 4 << 20):
            tokens, before, _ = tokens_of(*text_buffer(batch.column(0)))
            words.append(tokens)
            pairs.append(pairs_of(before, tokens))
            size += tokens.size
            if size > 3_000_000:
                yield out()
                words, pairs, size = [], [], 0
        if words:
            yield out()

    def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order].astype(_I)
        first = np.flatnonzero(np.append(h.size > 0, h[1:] != h[:-1]))
        return h[first], np.add.reduceat(n, first) if first.size else n

    def build(key: tuple, table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
        word, times = summed(join("words", _U), join("times", np.uint32))
        pair, pair_times = summed(np.concatenate([_unpack_pairs(x.as_py()) for x in table.column("pairs")]), join("pair_times", np.uint8))
        level = level_of(np.concatenate([times, pair_times]))
        size = max(64, int(level.sum()) * bits_each)
        filter = np.zeros(-(-size // 8) * 8, bool)
        h = np.concatenate([word, pair])
        for lowest in range(1, int(level.max()) + 1):  # the n-grams of each level and above
            live = level >= lowest
            h, level = h[live], level[live]
            for at in _places(h, lowest, filter.size):
                filter[at] = True
        end = times[word == END]
        return pa.table({"shard": [key[0].as_py()], "bits": pa.array([np.packbits(filter, bitorder="little").tobytes()], pa.binary()), "words": pa.array([word.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary()), "v": [word.size], "n": [int(times.sum())], "once": [int((times == 1).sum())], "texts": [int(end.sum())]})

    return texts.mapInArrow(count, "shard long, words binary, times binary, pairs binary, pair_times binary").groupBy("shard").applyInArrow(build, "shard long, bits binary, words binary, times binary, v long, n long, once long, texts long")


def _levels(key: np.ndarray, start: np.ndarray | int, size: np.ndarray | int, filter: np.ndarray) -> np.ndarray:
    """The level of each n-gram, 0 if it isn't stored. ``start``, ``size``: the bits of its shard."""
    out = np.zeros(key.size, np.uint8)
    start, size = np.broadcast_to(start, key.shape), np.broadcast_to(size, key.shape)
    live = np.flatnonzero(size > 0)
    for level in range(1, STEPS.size + 1):
        if not live.size:
            break
        ok = np.ones(live.size, bool)
        for place in _places(key[live], level, size[live]):
            at = start[live] + place
            ok &= (filter[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        live = live[ok]
        out[live] = level
    return out


class Found:
    """Levels of words and pairs and exact counts of words, from the shards at hand: all of them, or those that a block asked for."""

    def __init__(self, bits: int, shards: list, filters: list, words: list, times: list):
        order = np.argsort(np.array(shards, _I))
        self.bits, sizes = bits, np.zeros(1 << bits, _I)
        filters, words, times = ([x[k] for k in order.tolist()] for x in (filters, words, times))
        sizes[np.array(shards, _I)[order]] = [len(x) for x in filters]
        self.start, self.size = (np.cumsum(sizes) - sizes) * 8, sizes * 8
        self.filter = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in filters)])
        self.word = np.concatenate([np.zeros(0, _U), *(np.frombuffer(x, _U) for x in words)])
        self.times = np.concatenate([np.zeros(0, _I), *(np.frombuffer(x, _I) for x in times)])

    def counts(self, word: np.ndarray) -> np.ndarray:
        if not self.word.size:
            return np.zeros(word.size, _I)
        at = np.minimum(np.searchsorted(self.word, word), self.word.size - 1)
        return np.where(self.word[at] == word, self.times[at], 0)

    def levels(self, h: np.ndarray) -> np.ndarray:
        shard = _shard(h, self.bits)
        return _levels(np.where(h & _U(1), h & _LOW, h), self.start[shard], self.size[shard], self.filter)


class Told:
    """What the shards told about the sorted distinct words and pairs of a block."""

    def __init__(self, word: np.ndarray, times: np.ndarray, level: np.ndarray, pair: np.ndarray, pair_level: np.ndarray):
        self.word, self.times, self.of = word, times, {0: (word, level), 1: (pair, pair_level)}

    def counts(self, word: np.ndarray) -> np.ndarray:
        return self.times[np.searchsorted(self.word, word)]

    def levels(self, h: np.ndarray) -> np.ndarray:
        known, level = self.of[int(h[0] & _U(1)) if h.size else 0]
        return level[np.searchsorted(known, h)]


class Model:
    def __init__(self, train_tokens: int, words: int, once: int, texts: int, prior: float):
        self.n, self.v, self.texts, self.prior = train_tokens, words, texts, prior
        self.unseen = min(0.5, max(once, 1) / max(train_tokens, 2))

    def log10(self, found: Found | Told, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: the logarithm of its probability, and its exact count."""
        word, inverse = np.unique(tokens, return_inverse=True)
        value = VALUES[found.levels(word)]
        alone = np.where(value > 0, (1 - self.unseen) * value / max(self.n, 1), self.unseen / (self.v + 1))[inverse]
        pair, of = np.unique(pairs_of(before, tokens), return_inverse=True)
        at = np.minimum(np.searchsorted(word, before), word.size - 1)
        context = np.where(before == BEGIN, float(self.texts), np.where(word[at] == before, value[at], 0.0))
        both = np.minimum(VALUES[found.levels(pair)][of], context)
        return np.log10((both + self.prior * alone) / (context + self.prior)), found.counts(word)[inverse]


def _blobs(parts: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([x if isinstance(x, bytes) else x.tobytes() for x in parts], pa.binary())


def _by_shards(rows: DataFrame, table: DataFrame, bits: int, blocks: int, work, schema: str) -> DataFrame:
    """``work(rows with texts, what the shards tell)`` for all ``rows``. Rows form blocks by a hash of id and text, so that copies spread."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def ngrams(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        words, pairs = [np.zeros(0, _U)], [np.zeros(0, _U)]
        for batch in by_bytes(iter(texts.to_batches()), "text", 4 << 20):
            tokens, before, _ = tokens_of(*text_buffer(batch.column("text")))
            words.append(distinct(tokens))
            pairs.append(distinct(pairs_of(before, tokens)))
        return distinct(np.concatenate(words)), distinct(np.concatenate(pairs))

    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        word, pair = ngrams(texts.select(["text"]))
        shards = distinct(np.concatenate([_shard(word, bits), _shard(pair, bits)]))
        a, b = _cuts(word, bits, shards).tolist(), _cuts(pair, bits, shards).tolist()
        asked = [word[i:j] for i, j in zip(a[:-1], a[1:], strict=True)], [_pack_pairs(pair[i:j]) for i, j in zip(b[:-1], b[1:], strict=True)]
        return pa.table({"shard": shards, "block": np.full(shards.size, key[0].as_py()), "words": _blobs(asked[0]), "pairs": _blobs(asked[1])})

    def answer(asked: pa.Table, built: pa.Table) -> pa.Table:
        columns = {"block": [], "shard": [], "times": [], "level": [], "pair_level": []}
        own = [built.column(c)[0].as_py() for c in ("bits", "words", "times")] if built.num_rows else [b""] * 3
        found = Found(0, [0], *([x] for x in own))
        for block, shard, words, pairs in zip(*(asked.column(c).to_pylist() for c in ("block", "shard", "words", "pairs")), strict=True):
            word = np.frombuffer(words, _U)
            for name, value in (("block", block), ("shard", shard), ("times", found.counts(word).tobytes()), ("level", _levels(word, 0, found.size, found.filter).tobytes()), ("pair_level", _levels(_unpack_pairs(pairs), 0, found.size, found.filter).tobytes())):
                columns[name].append(value)
        return pa.table({c: pa.array(v, pa.int64() if c in ("block", "shard") else pa.binary()) for c, v in columns.items()})

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        texts, told = texts.drop_columns(["block"]), told.sort_by("shard")
        times, level, pair_level = (np.frombuffer(b"".join(told.column(c).to_pylist()), kind) for c, kind in (("times", _I), ("level", np.uint8), ("pair_level", np.uint8)))
        word, pair = ngrams(texts)
        found = Told(word, times, level, pair, pair_level)
        return pa.Table.from_batches([work(batch, found) for batch in by_bytes(iter(texts.to_batches()), "text")])

    asked = rows.groupBy("block").applyInArrow(ask, "shard long, block long, words binary, pairs binary")
    told = asked.groupBy("shard").cogroup(table.select("shard", "bits", "words", "times").groupBy("shard")).applyInArrow(answer, "block long, shard long, times binary, level binary, pair_level binary")
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)


def _bytes(size: str) -> int:
    """A size as sessions give it: 10485760b, 256k, 64MB, -1."""
    number = size.strip().lower().removesuffix("b")
    unit = "kmgtp".find(number[-1]) + 1
    return int(number[:-1] if unit else number) << 10 * unit


def score_texts(docs: DataFrame, prior: float = 40.0, broadcast_bytes: int | None = None, bits_each: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = shard_bits(size)
    table = materialize(shard_table(docs.where("not held_out").select("text"), bits, bits_each), "shards")
    facts = table.agg(F.sum(F.octet_length("bits")).alias("bytes"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once", "texts"))).first()
    n, v = facts["n"], facts["v"]
    model = spark.sparkContext.broadcast(Model(n, v, facts["once"], facts["texts"], prior))
    each = np.log10(n + v + 1)

    def score(batch: pa.RecordBatch, found: Found | Told) -> pa.RecordBatch:
        tokens, before, bounds = tokens_of(*text_buffer(batch.column(1)))
        rows, size = row_ids(bounds), batch.num_rows
        chance, count = model.value.log10(found, tokens, before)
        base = np.bincount(rows, np.log10(count + 1.0), size) - np.diff(bounds) * each
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(bounds)), pa.array(np.bincount(rows, count > 0, size).astype(_I)), pa.array(base), pa.array(np.bincount(rows, chance, size))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    most = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) if broadcast_bytes is None else broadcast_bytes
    if (facts["bytes"] or 0) + 16 * v <= most:
        whole = table.select("shard", "bits", "words", "times").toArrow()
        shared = spark.sparkContext.broadcast(Found(bits, *(whole.column(c).to_pylist() for c in whole.column_names)))
        del whole

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text"):
                yield score(batch, shared.value)

        scored = docs.mapInArrow(run, schema)
    else:
        scored = _by_shards(docs, table, bits, max(1, -(-size // SHARD)), score, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
