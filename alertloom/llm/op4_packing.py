"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

A sequence is filled by the dot-product heuristic: of the waiting pieces that fit, take the one whose demand vector has the largest dot
product with the remaining capacity, both as shares of the limits. If none fits, a piece may be cut to fill the rest; the last segment that a
sequence may have is cut from a piece that fills it, if one waits. A sequence that the other limits end before it is full gives back what is beyond a
power of two, the length at which it needs no padding. Each task packs the documents of its own partition as they stream by, with a pool of
bounded size, so there is no shuffle and no global state; a partition ends with at most ``log2`` sequences of power-of-two lengths. Whole examples
(``pack_examples``) are never cut, so there the limits may leave room.

Defined cases: a null text counts as empty (only the end id); repeated rows and rows without doc_id are packed like any others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import default_path, encoder
from .textscan import by_bytes, text_buffer

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs items (payload, tokens, loss-bearing tokens). ``cut`` splits a payload: cut(payload, k) -> (first k tokens, rest).

    ``limits``: most tokens, segments and loss-bearing tokens of a sequence. ``emit(sequence number, offset, payload, length)`` takes what is placed.
    """

    def __init__(self, limits: tuple[int, int, int], emit, cut=None, loss=None, pool: int = 512):
        self.limits, self.emit, self.cut, self.loss, self.most = np.array(limits, float), emit, cut, loss or (lambda payload, tokens: tokens), pool
        slots = pool + 2  # a sequence cuts one piece as it is filled and one as it is shortened
        self.tokens, self.losses, self.items = np.zeros(slots), np.zeros(slots), [None] * slots
        self.free, self.n, self.number = list(range(slots))[::-1], 0, 0

    def add(self, payload, tokens: int) -> None:
        most = int(self.limits[0])
        while self.cut and tokens >= most and self.loss(payload, most) <= self.limits[2]:
            whole, payload = self.cut(payload, most) if tokens > most else (payload, None)
            self.emit(self.number, 0, whole, most)
            self.number += 1
            tokens -= most
            if not tokens:
                return
        if not self.cut and (tokens > most or self.loss(payload, tokens) > self.limits[2]):
            self.emit(self.number, 0, payload, tokens)  # too large for any sequence: alone
            self.number += 1
            return
        while self.n >= self.most:
            self._fill()
        self._put(payload, tokens)

    def _put(self, payload, tokens: int) -> None:
        k = self.free.pop()
        self.items[k], self.tokens[k], self.losses[k] = payload, tokens, self.loss(payload, tokens)
        self.n += 1

    def _take(self, k: int):
        payload, tokens = self.items[k], int(self.tokens[k])
        self.items[k], self.tokens[k], self.losses[k] = None, 0, 0
        self.free.append(k)
        self.n -= 1
        return payload, tokens

    def _fill(self, ends: bool = False) -> None:
        """Fill one sequence. ``ends``: no more items come, so the last one may be short."""
        left, at, placed = self.limits.copy(), 0, []
        while self.n and left[0] >= 1 and left[1] >= 1 and left[2] >= 0:
            share = left / self.limits
            fits = (self.tokens > 0) & (self.tokens <= left[0]) & (self.losses <= left[2])
            if self.cut and left[1] == 1 and (self.tokens > left[0]).any():
                fits[:] = False  # the last segment: a longer piece is cut to fill it
            score = np.where(fits, share[0] * self.tokens / self.limits[0] + share[1] / self.limits[1] + share[2] * self.losses / self.limits[2], -1)
            k = int(score.argmax())
            if score[k] >= 0:
                payload, tokens = self._take(k)
            elif self.cut and left[2] >= 1:
                longer = np.where(self.tokens >= left[0], self.tokens, np.inf)
                k = int(longer.argmin()) if np.isfinite(longer).any() else int(self.tokens.argmax())
                payload, tokens = self._take(k)
                take = min(int(left[0]), tokens)
                while take > 1 and self.loss(payload, take) > left[2]:
                    take -= 1
                if self.loss(payload, take) > left[2]:
                    self._put(payload, tokens)
                    break
                if take < tokens:
                    payload, rest = self.cut(payload, take)
                    self._put(rest, tokens - take)
                tokens = take
            else:
                break
            placed.append((at, payload, tokens))
            left -= [tokens, 1, self.loss(payload, tokens)]
            at += tokens
        if self.cut and ends and not self.n and at & (at - 1) and at < self.limits[0]:
            return self._powers(placed, at)
        if self.cut and at < self.limits[0] and at & (at - 1):
            placed = self._shorten(placed, 1 << (at.bit_length() - 1))
        for offset, payload, tokens in placed:
            self.emit(self.number, offset, payload, tokens)
        self.number += 1

    def _shorten(self, placed: list, most: int) -> list:
        """What lies before ``most``; the rest waits again."""
        kept = []
        for offset, payload, tokens in placed:
            if offset + tokens <= most:
                kept.append((offset, payload, tokens))
            elif offset >= most:
                self._put(payload, tokens)
            else:
                payload, rest = self.cut(payload, most - offset)
                kept.append((offset, payload, most - offset))
                self._put(rest, offset + tokens - most)
        return kept

    def _powers(self, placed: list, total: int) -> None:
        """The last tokens, in sequences of power-of-two lengths, which need no padding."""
        waiting = [(payload, tokens) for _, payload, tokens in placed][::-1]
        for bit in reversed(range(total.bit_length())):
            room, at = total & (1 << bit), 0
            while at < room:
                payload, tokens = waiting.pop()
                if tokens > room - at:
                    payload, rest = self.cut(payload, room - at)
                    waiting.append((rest, tokens - (room - at)))
                    tokens = room - at
                self.emit(self.number, at, payload, tokens)
                at += tokens
            self.number += bool(room)

    def finish(self) -> None:
        while self.n:
            self._fill(ends=True)


def pack_documents(docs: DataFrame, max_tokens: int = 2048, max_segments: int = 256, max_loss_tokens: int = 2048, tokenizer: str | None = None, end_id: int = 1, pool: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece. Every id after the first of its document bears loss.

    So a limit on loss below that on tokens would force short sequences; by default it equals that. A sequence of 256 segments is shorter than
    ``max_tokens`` only where the texts that wait have 8 tokens on average or fewer.
    """
    if min(max_tokens, max_segments, max_loss_tokens) < 1:
        raise ValueError("limits must be 1 or more")
    tokenizer = tokenizer or default_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def emit(number: int, offset: int, payload: tuple, length: int) -> None:
            doc, start, ids, total = payload
            rows.append((doc, start, length, zlib.crc32(ids[:length].tobytes()), total, first + number, offset, length - (start == 0)))

        def cut(payload: tuple, k: int) -> tuple:
            doc, start, ids, total = payload
            return (doc, start, ids[:k], total), (doc, start + k, ids[k:], total)

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

        packer = Packer((max_tokens, max_segments, max_loss_tokens), emit, cut, lambda payload, tokens: tokens - (payload[1] == 0), pool)
        for batch in by_bytes(batches, "text"):
            found, bounds = encoder(tokenizer).encode(*text_buffer(batch.column(1)))
            full = np.insert(found, bounds[1:], end_id).astype("<u4")
            ends = bounds + np.arange(bounds.size)
            for doc, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                packer.add((doc, 0, full[a:b].copy() if b - a < 64 else full[a:b], b - a), b - a)
            if len(rows) > 20_000:
                yield out()
        packer.finish()
        if rows:
            yield out()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(pack, PIECES)


def pack_examples(examples: DataFrame, max_tokens: int, max_segments: int, max_loss_tokens: int, pool: int = 512, id_column: str = "example_id", tokens_column: str = "n_tokens", loss_column: str = "n_loss") -> DataFrame:
    """Place whole examples (instruction data: they are never cut) by their counts: id, sequence_id, offset, tokens, loss tokens.

    A null count is 0. An example beyond a limit gets a sequence of its own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, rows = TaskContext.get().partitionId() << 36, []
        packer = Packer((max_tokens, max_segments, max_loss_tokens), lambda number, offset, payload, length: rows.append((payload[0], first + number, offset, length, payload[1])), None, lambda payload, tokens: payload[1], pool)
        schema = pa.schema([("example_id", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("n_loss", pa.int64())])
        for batch in batches:
            for key, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tokens <= 0:
                    rows.append((key, first + packer.number, 0, 0, loss))
                    packer.number += 1
                else:
                    packer.add((key, loss), tokens)
        packer.finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    columns = (F.col(id_column).cast("long").alias("example_id"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for c, n in ((tokens_column, "n_tokens"), (loss_column, "n_loss"))))
    return examples.select(*columns).mapInArrow(pack, "example_id long, sequence_id long, offset long, n_tokens long, n_loss long")
