"""Line dedup: an edit-distance join of lines by segment partition.

A line of n characters is cut into tau + 1 segments of nearly equal length; tau edits leave one of them whole. A line therefore shares a
segment, at nearly the same place, with every line within distance tau: it probes, for each length from n - tau to n, the substrings that
can be the i-th segment of a line of that length. Candidates are verified with a bit-parallel edit distance on a band of 2 tau + 1
diagonals. Lines that links connect form a class, and of a class the first occurrence (smallest doc_id, then position) stays.

Two lines link when their edit distance is at most the bound of the shorter one: 0 below ``min_chars`` characters, ``tau`` from there on.

Defined cases: lines without a word character (blank ones) always stay and open no
class; a null text has no lines and stays null; rows with equal doc_id and text are treated alike; rows without doc_id come first in the
order; an empty table gives no rows; extra columns are carried by the filter. Lines are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simlink import DEALT, SIGNATURES, SKETCH, Parts, as_dealt, as_rows, groups_of, linked, shard_bits, sketched
from .storage import discard, materialize
from .textscan import by_bytes, distinct, mix, text_buffer

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
BROADCAST_KEYS = 4_000_000
#: A line is common if more than one line in so many equals it.
COMMON = 1000
#: Bits in the sketch of a line's pairs of neighbouring characters.
SKETCH_BITS = 256


def segments(n: int, tau: int) -> list[tuple[int, int]]:
    """Start and length of the tau + 1 segments of a line of n characters; the longer ones come last."""
    short, longer = n // (tau + 1), n % (tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        size = short + (i > tau - longer)
        out.append((at, size))
        at += size
    return out


def probes(n: int, tau: int) -> list[tuple[int, int, int, int]]:
    """(length of the other line, segment, start here, size): substrings of a line of n characters to look up. Those of its own segments are among them."""
    found = []
    for other in range(max(n - tau, tau + 1), n + 1):
        shift = n - other
        for i, (start, size) in enumerate(segments(other, tau)):
            low = max(start - i, start + shift - (tau - i), 0)
            high = min(start + i, start + shift + (tau - i), n - size)
            found += [(other, i, at, size) for at in range(low, high + 1)]
    return found


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> None:
        if n >= self.up.size:
            size = max(n + 1, 1 << 16)
            inverse = pow(int(_BASE), -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", _U(inverse))):
                full = np.full(size, base, _U)
                full[0] = 1
                setattr(self, name, np.cumprod(full))


_POWERS = _Powers()


def line_signatures(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and signature for all lines; ``points``: code points."""
    _POWERS.upto(points.size + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(points.astype(_U)) * _POWERS.up[: points.size])])
    rows, sigs = [], []
    # as probes(), for all lines at once
    for shift in range(tau + 1):
        other = lengths - shift
        short, longer = other // (tau + 1), other % (tau + 1)
        for i in range(tau + 1):
            start, size = i * short + np.maximum(0, i - (tau + 1 - longer)), short + (i > tau - longer)
            low = np.maximum(np.maximum(start - i, start + shift - (tau - i)), 0)
            high = np.minimum(np.minimum(start + i, start + shift + (tau - i)), lengths - size)
            for step in range(2 * tau + 1):
                at = np.flatnonzero((low + step <= high) & (other > tau))
                if not at.size:
                    break
                a = starts[at] + low[at] + step
                value = (sums[a + size[at]] - sums[a]) * _POWERS.down[a]
                rows.append(at)
                sigs.append(mix(value + ((other[at] * 64 + i) * 2 + 1).astype(_U) * _U(0xD1B54A32D192ED03)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(sigs).view(np.int64)


def _letters(texts: list[np.ndarray]) -> np.ndarray:
    """How often each text has each of 64 classes of characters."""
    rows = np.repeat(np.arange(len(texts)), [t.size for t in texts])
    return np.bincount(rows * 64 + (np.concatenate(texts) & 63), minlength=64 * len(texts)).reshape(-1, 64).astype(np.int32)


def within(pairs: list[tuple[np.ndarray, np.ndarray]], tau: int) -> np.ndarray:
    """Whether the edit distance of each pair of code point arrays is at most tau: a band of 2 tau + 1 diagonals in the bits of one integer a pair, all pairs at once."""
    pairs = [(a, b) if a.size >= b.size else (b, a) for a, b in pairs]
    out = np.zeros(len(pairs), bool)
    if not pairs:
        return out
    long, short = (np.array([p[k].size for p in pairs], np.int64) for k in (0, 1))
    # an edit changes two of the counts of characters by one at most: most pairs end here
    one, two = (_letters([p[k] for p in pairs]) for k in (0, 1))
    order = np.argsort(short, kind="stable")
    order = order[((long - short <= tau) & (np.abs(one - two).sum(1) <= 2 * tau))[order]]
    at = 0
    while at < order.size:
        to = at + 1
        while to < order.size and to - at < 4096 and (to - at + 1) * (int(long[order[to]]) + 2 * tau + 2) < 4_000_000:
            to += 1
        part = order[at:to]
        m, n = long[part], short[part]
        width = int(m.max()) + 2 * tau + 2
        one, two = np.full((part.size, width), -1, np.int64), np.full((part.size, int(n.max()) + 1), -2, np.int64)
        for k, p in enumerate(part.tolist()):
            one[k, tau : tau + pairs[p][0].size] = pairs[p][0]
            two[k, : pairs[p][1].size] = pairs[p][1]
        # bit tau + d of the band is the diagonal d; the row below the band's top leads it
        full = (1 << (2 * tau + 1)) - 1
        plus = np.full(part.size, (full >> tau) << tau, np.int64) & full
        minus = np.zeros(part.size, np.int64)
        score = np.full(part.size, tau, np.int64)
        flat = np.full(part.size, 2 * tau - 1, np.int64)
        for i in range(int(n.max())):
            live = i < n
            match = np.zeros(part.size, np.int64)
            for d in range(2 * tau + 1):
                match |= (one[:, i + d] == two[:, i]).astype(np.int64) << d
            d0 = ((((match & plus) + plus) ^ plus) | match | minus) & full
            hp = (minus | ~(d0 | plus)) & full
            hn = d0 & plus
            slanted = i < m - tau
            step = np.where(slanted, 1 - ((d0 >> (2 * tau)) & 1), np.where(flat >= 0, ((hp >> np.maximum(flat, 0)) & 1) - ((hn >> np.maximum(flat, 0)) & 1), 0))
            score += np.where(live, step, 0)
            flat -= live & ~slanted
            plus = (hn | ~((d0 >> 1) | hp)) & full
            minus = (d0 >> 1) & hp
        out[part] = score <= tau
        at = to
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


def _points(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, and start, length and text of each line."""
    data, offsets = text_buffer(batch.column(column))
    text = data[offsets[0] : offsets[-1]]
    head = (text & 0xC0) != 0x80
    place = np.concatenate([[0], np.cumsum(head)])[offsets - offsets[0]]
    points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    breaks = np.flatnonzero(points == 10)
    begins = distinct(np.concatenate([place[:-1], breaks + 1]))
    begins = begins[begins < points.size] if points.size else begins[:0]
    ends = np.concatenate([begins[1:], [points.size]])[: begins.size]
    stop = np.zeros(points.size + 1, bool)
    stop[breaks + 1] = True
    lengths = ends - begins - stop[ends]
    return points, begins, lengths, place


def line_sketches(batch: pa.RecordBatch, tau: int) -> pa.RecordBatch:
    """key, size, band and sketch for lines given as key, payload."""
    lines = [_code_points(t).astype(_U) for t in batch.column(1).to_pylist()]
    sizes = np.array([x.size for x in lines], np.int64)
    points, rows = np.concatenate(lines), np.repeat(np.arange(sizes.size), sizes)
    inside = rows[1:] == rows[:-1]
    found = mix(points[:-1] * _BASE + points[1:])[inside]
    sketch = sketched(rows[1:][inside], found, np.full(sizes.size, SKETCH_BITS))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sizes // (tau + 1)), sketch], ["key", "size", "band", "sketch"])


def duplicate_lines(docs: DataFrame, tau: int = 2, min_chars: int = 24, sample_docs: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, lines: for each text, its lines in order as (at, keep, near): whether the line stays, and whether it goes for a line that isn't equal."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_key"))
    lines = docs.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("doc_id", "text_key", "at", F.when(F.col("line").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.xxhash64("line")).alias("key"))
    lines = materialize(lines, "lines")
    place = F.struct("doc_id", "text_key", "at")
    distinct = materialize(lines.where("key is not null").groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-lines")

    def sign(often: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Parts:
            seen = np.zeros(0, np.int64)  # sorted
            for batch in by_bytes(batches, "text", 1 << 20):
                points, starts, lengths, _ = _points(batch, 0)
                names = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                if names.size != starts.size:
                    raise ValueError("lines and their keys differ in number")
                at = np.flatnonzero(lengths >= max(min_chars, tau + 1))
                keys, first = np.unique(names[at], return_index=True)
                new = seen[np.minimum(np.searchsorted(seen, keys), seen.size - 1)] != keys if seen.size else np.ones(keys.size, bool)
                at = at[first[new]]
                # lines that come again later are merged with the groups
                seen = keys[new] if seen.size > 1_000_000 else np.sort(np.concatenate([seen, keys[new]]), kind="stable")
                row, sig = line_signatures(points, starts[at], lengths[at], tau)
                key = names[at][row]
                yield sig, key, np.isin(sig, often) if often is not None and often.size else np.zeros(sig.size, bool)

        return run

    # the lines that are not empty, as _points finds them, by their hash in the same order
    hashed = F.transform(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1), lambda x: F.xxhash64(x))
    texts = docs.where("text <> ''").select("text", hashed.alias("keys"))
    facts = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = max(1, -(-facts["n"] // sample_docs))
    often = _common(texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0), sign(None))
    # a line gives up to 21 signatures
    bits, signed = shard_bits((facts["bytes"] or 0) // 32), sign(often)
    groups = groups_of(texts.mapInArrow(lambda batches: as_dealt(signed(batches), bits), DEALT))
    wanted = materialize(groups.select("key").distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    held = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("key", F.xxhash64("line")).join(few, "key").dropDuplicates(["key"])
    held = materialize(held.select("key", F.col("line").alias("payload"), F.length("line").cast("long").alias("weight")), "wanted-lines")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload"):
            yield line_sketches(batch, tau)

    sketches = materialize(held.select("key", "payload").mapInArrow(sketch, SKETCH), "sketches")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "x", 8 << 20):
            texts = [[_code_points(t) for t in batch.column(c).to_pylist()] for c in (2, 3)]
            kept = pa.array(np.flatnonzero(within(list(zip(*texts, strict=True)), tau)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(kept) for c in (0, 1)], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(held.select(F.col("key").alias("a"), F.col("payload").alias("x")), "a").join(held.select(F.col("key").alias("b"), F.col("payload").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(near, "a long, b long")

    def between(one: pa.Table, two: pa.Table) -> list[tuple[int, int]]:
        xs, ys = ([_code_points(t) for t in table.column("payload").to_pylist()] for table in (one, two))
        labels, sizes = two.column("label").to_numpy(), np.array([y.size for y in ys])
        # an edit changes two of the counts of characters by one at most
        counts = np.array([np.bincount(y & 31, minlength=32) for y in ys], np.int32)
        tests: list[tuple[int, int]] = []
        for k, (x, label) in enumerate(zip(xs, one.column("label").to_pylist(), strict=True)):
            far = np.abs(counts - np.bincount(x & 31, minlength=32)).sum(1)
            tests += [(k, j) for j in np.flatnonzero((labels != label) & (np.abs(sizes - x.size) <= tau) & (far <= 2 * tau)).tolist()]
        near = within([(xs[k], ys[j]) for k, j in tests], tau) if tests else []
        links, done = [], set()
        for (k, j), holds in zip(tests, near, strict=True):
            if holds and (k, labels[j]) not in done:
                done.add((k, labels[j]))
                links.append((one.column("key")[k].as_py(), two.column("key")[j].as_py()))
        return links

    # an edit takes two pairs of neighbours away and brings two at most
    labels = linked(groups, held, verify, between, sketches=sketches, limit=lambda a, b: np.where(np.abs(a - b) <= tau, 4 * tau, -1))
    discard(groups, wanted, held, sketches)
    # only lines that occur again, or are linked, can go
    repeated = distinct.join(labels.withColumnRenamed("node", "key"), "key", "left").where("n > 1 or label is not null").select("key", F.coalesce("label", "key").alias("label"), "first", "n")
    leaders = repeated.groupBy("label").agg(F.min("first").alias("leader"), F.min_by("key", "first").alias("leading"))
    repeated = materialize(repeated.join(leaders, "label").select("key", "leader", "leading", "n"), "repeated-lines")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    discard(distinct, labels)
    # keys with more than one in COMMON of the lines (fewer keys than that) are broadcast; their lines, and those without a word, are spread for the other join
    common = F.col("n") * COMMON > total
    hot = repeated.where(common).select("key", F.col("leader").alias("hot_leader"), F.col("leading").alias("hot_leading"))
    met = lines.join(F.broadcast(hot), "key", "left").withColumn("rare", F.when(F.col("hot_leader").isNull(), F.col("key")))
    met = met.withColumn("spread", F.when(F.col("rare").isNull(), F.pmod(F.xxhash64(place), F.lit(1024))).otherwise(0))
    rest = repeated.where(~common).select(F.col("key").alias("rare"), F.lit(0).cast("long").alias("spread"), "leader", "leading")
    flagged = met.join(rest, ["rare", "spread"], "left").withColumns({"leader": F.coalesce("hot_leader", "leader"), "leading": F.coalesce("hot_leading", "leading")})
    keep = F.col("leader").isNull() | F.col("leader").eqNullSafe(place)
    flagged = flagged.select("doc_id", "text_key", F.struct("at", keep.alias("keep"), (~keep & (F.col("key") != F.col("leading"))).alias("near")).alias("line"))
    return flagged.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _common(texts: DataFrame, sign, least: int = 4, most: int = 1_000_000) -> np.ndarray:
    """Signatures that ``least`` or more lines of sampled texts hold. They are only dealt out in another way."""
    counts = texts.mapInArrow(lambda batches: as_rows(sign(batches)), SIGNATURES).select("sig", "key").distinct().groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return np.sort(counts.orderBy(F.desc("n"), "sig").limit(most).select("sig").toArrow().column("sig").to_numpy())


def _deduped(docs: DataFrame, doc_id: str, text: str, drop_emptied: bool, **options) -> DataFrame:
    """__row (a struct of all columns), __text (without the lines that go), __n_lines, __n_removed, __n_near."""
    flags = duplicate_lines(docs, doc_id=doc_id, text=text, **options).withColumnsRenamed({"doc_id": "__id", "text_key": "__key", "lines": "__lines"})
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    column = F.col(f"__row.`{text}`")
    joined = rows.join(flags, F.col(f"__row.`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(column) == F.col("__key")), "left")
    removed = F.size(F.filter("__lines", lambda x: ~x["keep"])).cast("long")
    kept = F.array_join(F.filter(F.split(column, "\n", -1), lambda x, i: F.get(F.col("__lines"), i)["keep"]), "\n")
    counts = {"__n_lines": F.size("__lines").cast("long"), "__n_removed": removed, "__n_near": F.size(F.filter("__lines", lambda x: x["near"])).cast("long")}
    out = joined.select("__row", F.when(column.isNotNull() & (removed > 0), kept).otherwise(column).alias("__text"), *(F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(n).alias(name) for name, n in counts.items()))
    if drop_emptied:
        out = out.where((F.col("__n_removed") == 0) | F.col("__text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_emptied: bool = False, **options) -> DataFrame:
    """The documents with all their columns, their text without the lines that go, and n_lines, n_removed, n_near after them.

    A column of ``docs`` that has one of these three names gives way to the count. ``drop_emptied``: leave out documents that lost lines and
    have none with a word left.
    """
    counts = ("n_lines", "n_removed", "n_near")
    found = _deduped(docs, doc_id, text, drop_emptied, **options)
    return found.select(*(F.col("__text").alias(c) if c == text else F.col(f"__row.`{c}`") for c in docs.columns if c not in counts), *(F.col(f"__{c}").alias(c) for c in counts))


def remove_duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The documents with exactly their columns, without the lines that go; documents of which nothing stays go. ``n_chars``, if there is one, follows a text that changed."""
    found = _deduped(docs, doc_id, text, True, **options)

    def column(c: str):
        own = F.col(f"__row.`{c}`")
        if c == text:
            return F.col("__text").alias(c)
        return F.when(F.col("__n_removed") > 0, F.length("__text").cast(docs.schema[c].dataType)).otherwise(own).alias(c) if c == n_chars else own

    return found.select(*map(column, docs.columns))
