"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the distinct hashes of its 5-word shingles. Two sets of sizes a <= b with Jaccard similarity t or more have
b <= a/t and differ in at most k = (1-t)/t * a elements. For each band of sizes (an octave) the domain is cut into first-level parts, each
of three second-level parts. At most k/2 first-level parts hold two differences or more, so among any k/2 + 1 of them one holds at most
one, and there two of the three second-level parts agree: all subsets of two are enumerated as signatures. A set signs first-level parts in
a fixed order until k/2 + 1 of them had no empty subset, so that two similar sets always share a signature that isn't empty. Sets with too
few such parts (small ones) also sign their first k + 1 elements alone. Elements that a sample shows to be common come last in the order,
which keeps passages that many documents share out of the signatures; it never changes the result. Sketches of the sets, which come with
their keys, rule out most candidates; all others are verified exactly, and the elements are read again only of sets in such pairs.

Defined cases: a text with fewer than five words has its whole word sequence as one shingle; a null text or one without words has an empty
set and no links; repeated rows fall in one class; rows without doc_id take part, and a class of only such rows has a null component; an
empty table gives no rows; extra columns are ignored by the digest and carried by the filter, whatever their names. Hashes have 64 bits: n distinct shingles or sets collide at all with
probability n*n/2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simlink import DEALT, Parts, as_dealt, groups_of, linked, near_pairs, shard_bits, sketched
from .storage import discard, materialize
from .textscan import by_bytes, distinct, mix, scan_words, text_buffer

_U = np.uint64
_STEPS = mix(np.arange(1, 65, dtype=_U)) | _U(1)
#: Elements in a first-level part on average, at the lower end of a band.
PART = 3.3
BROADCAST_KEYS = 4_000_000


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    _, _, words, bounds = scan_words(data, offsets)
    count = max(0, words.size - n + 1)
    grams = np.zeros(count, _U)
    for k in range(n):
        grams += words[k : k + count] * _STEPS[k]
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(distinct(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _STEPS[: b - a]).sum() + _U(b - a)], _U)))
        else:
            out.append(grams[:0])
    return out


def set_key(found: np.ndarray) -> int:
    return int(mix(np.array([mix(found ^ _U(0x5851F42D4C957F2D)).sum() + _U(found.size)], _U)).view(np.int64)[0])


def set_sketches(sets: list[np.ndarray]) -> pa.Array:
    """A sketch of each set with a bit for each element at least, none for an empty one."""
    sizes = np.array([x.size for x in sets], np.int64)
    bits = np.where(sizes > 0, np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)), 0)
    return sketched(np.repeat(np.arange(sizes.size), sizes), np.concatenate([np.zeros(0, _U), *sets]), bits)


def _bottom(size: np.ndarray) -> np.ndarray:
    """Lower end of the band of each size."""
    return (1 << np.floor(np.log2(size)).astype(np.int64)).astype(np.int64)


def signatures(sets: list[np.ndarray], percent: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and whether it may be very common, for the sets of a batch. ``common``: sorted common elements and their class (1 and up)."""
    sizes = np.array([x.size for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    if not row.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    element = np.concatenate(sets)
    kind = np.zeros(element.size, np.int64)
    if common[0].size:
        at = np.minimum(np.searchsorted(common[0], element), common[0].size - 1)
        kind = np.where(common[0][at] == element, common[1][at], 0).astype(np.int64)
    k = sizes * (100 - percent) // percent
    need = k // 2 + 1
    own = np.where(sizes > 0, _bottom(np.maximum(sizes, 1)), 1)
    rows, sigs, often = [], [], []
    short = np.zeros(len(sets), bool)
    scatter = mix(element ^ _U(0x2545F4914F6CDD1D))
    for step in (0, 1):
        bottom = own << step
        # a set is signed for the next band too if a partner of that band can be near enough
        inside = (sizes > 0) if step == 0 else (sizes > 0) & (sizes * 100 >= bottom * percent)
        use = inside[row]
        if not use.any():
            continue
        r, x, c = row[use], scatter[use], kind[use]
        parts = np.maximum(1, (bottom / PART).astype(np.int64))
        part = ((x >> _U(32)) * parts[r].astype(_U)) >> _U(32)
        sub = (x & _U(0xFFFF)) % _U(3)
        place = (r.astype(_U) << _U(40)) | (c.astype(_U) << _U(34)) | part
        order = np.argsort(place * _U(4) + sub, kind="stable")
        cell = (place * _U(4) + sub)[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sums = np.add.reduceat(mix(x[order]), first)
        cell = cell[first]
        group = cell >> _U(2)
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        of = np.repeat(np.arange(heads.size), np.diff(np.append(heads, cell.size)))
        table, filled = np.zeros((heads.size, 3), _U), np.zeros((heads.size, 3), bool)
        table[of, (cell & _U(3)).astype(np.int64)] = sums
        filled[of, (cell & _U(3)).astype(np.int64)] = True
        group = group[heads]
        r = (group >> _U(40)).astype(np.int64)
        valid = filled.sum(1) >= 2
        ran = np.cumsum(valid) - valid
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        ran = ran - np.repeat(ran[begin], np.diff(np.append(begin, r.size)))
        have = np.bincount(r, valid, len(sets))
        short |= inside & (have < need)
        taken = ran < need[r]
        label = mix((group & _U((1 << 40) - 1)) + (bottom[r].astype(_U) << _U(40)))
        for one, other in ((0, 1), (0, 2), (1, 2)):
            ok = np.flatnonzero(taken & (filled[:, one] | filled[:, other]))
            rows.append(r[ok])
            sigs.append(mix(table[ok, one] * _STEPS[20 + one] + table[ok, other] * _STEPS[30 + other] + label[ok] + _U(one * 3 + other)))
            often.append((group[ok] >> _U(34)) & _U(63))
    alone = short[row]
    if alone.any():
        r, x, c = row[alone], scatter[alone], kind[alone]
        order = np.lexsort((x, c, r))
        r, x, c = r[order], x[order], c[order]
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        rank = np.arange(r.size) - np.repeat(begin, np.diff(np.append(begin, r.size)))
        taken = rank <= k[r]
        rows.append(r[taken])
        sigs.append(mix(x[taken] + _U(0x1234567)))
        often.append(c[taken].astype(_U))
    return np.concatenate(rows), np.concatenate(sigs).view(np.int64), np.concatenate(often) > 0


def _common_elements(docs: DataFrame, total: int, sample_docs: int, least: int = 4, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Elements that ``least`` or more sampled documents hold, and the class of each by how many. Only the order of elements depends on it."""
    share = max(1, -(-total // sample_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            element, n = np.unique(np.concatenate(shingles(*text_buffer(batch.column(0)))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(element.view(np.int64)), pa.array(n)], ["element", "n"])

    sampled = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).dropDuplicates(["text"]).select("text")
    counts = sampled.mapInArrow(count, "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "element").limit(most).toArrow()
    element, n = top.column("element").to_numpy().view(_U), top.column("n").to_numpy()
    order = np.argsort(element)
    return element[order], np.minimum(1 + np.log2(np.maximum(n[order], 1) / least), 60).astype(np.int64)


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, sample_docs: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), key (of its set; null if empty), n_shingles, class (a key; null if empty), component_id: one row for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_key"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingles(*text_buffer(batch.column(1)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([set_key(x) if x.size else None for x in sets], pa.int64()), pa.array([x.size for x in sets], pa.int64()), set_sketches(sets)], ["doc_id", "text_key", "key", "n_shingles", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = materialize(docs.mapInArrow(keys, f"doc_id {kind}, text_key long, key long, n_shingles long, sketch binary"), "sets")
    facts = table.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("elements")).first()
    common = spark.sparkContext.broadcast(_common_elements(docs, facts["n"], sample_docs))
    bits = shard_bits(facts["elements"] or 0)

    def sign(batches: Iterator[pa.RecordBatch]) -> Parts:
        seen: set[int] = set()
        for batch in by_bytes(batches, "text"):
            sets = [x for x in shingles(*text_buffer(batch.column(0)), n) if x.size]
            names = [set_key(x) for x in sets]
            new = {}
            for k, name in enumerate(names):
                if name not in seen:
                    new.setdefault(name, k)
            seen.update(new)
            if len(seen) > 1_000_000:  # copies that pass are removed later
                seen.clear()
            row, sig, often = signatures([sets[k] for k in new.values()], percent, common.value)
            yield sig, np.array(list(new), np.int64)[row], often

    groups = groups_of(docs.select("text").mapInArrow(lambda batches: as_dealt(sign(batches), bits), DEALT))
    wanted = groups.select("key").distinct()
    holders = table.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    # of two linked sets the larger one is in the same band or the next
    band = F.floor(F.log("size") / F.log(F.lit(max(1.05, 1.0001 * 100 / percent)))).cast("long")
    holders = materialize(holders.join(wanted, "key").select("doc_id", "key", "size", band.alias("band"), "sketch"), "holders")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets, names = shingles(*text_buffer(batch.column(0)), n), batch.column(1).to_pylist()
            kept = [k for k, x in enumerate(sets) if x.size and set_key(x) == names[k]]
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in kept], pa.int64()), pa.array([sets[k].view(np.int64) for k in kept], pa.list_(pa.int64()))], ["key", "payload"])

    written: list[DataFrame] = []

    def held(keys: DataFrame) -> DataFrame:
        """key, payload, weight for distinct keys; what was read before goes."""
        discard(*written)
        asked = materialize(holders.join(keys, "key").select(F.col("doc_id").alias("holder"), "key"), "asked")
        few = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
        found = docs.join(few, F.col("doc_id").eqNullSafe(F.col("holder"))).select("text", "key")
        found = materialize(found.mapInArrow(members, "key long, payload array<long>").dropDuplicates(["key"]).withColumn("weight", F.size("payload").cast("long")), "elements")
        written[:] = [asked, found]
        return found

    def limit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Elements that one of two linked sets has and the other lacks, at most."""
        return (a + b) * (100 - percent) // (100 + percent)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in (2, 3)]
            most = limit(*sizes)
            near = np.abs(sizes[0] - sizes[1]) <= most
            kept = pa.array(np.flatnonzero(near & near_pairs(batch.column(4), batch.column(5), most)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(kept) for c in (0, 1)], ["a", "b"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, xo), (ys, yo) = (_lists(batch.column(c)) for c in (2, 3))
            kept = []
            for k in range(batch.num_rows):
                x, y = xs[xo[k] : xo[k + 1]], ys[yo[k] : yo[k + 1]]
                if min(x.size, y.size) * 100 >= percent * max(x.size, y.size):
                    both = np.intersect1d(x, y, assume_unique=True).size
                    if 100 * both >= percent * (x.size + y.size - both):
                        kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(holders.select(F.col("key").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
        close = materialize(pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(may, "a long, b long"), "close")
        elements = held(close.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        written.append(close)
        with_a = close.join(elements.select(F.col("key").alias("a"), F.col("payload").alias("xs")), "a")
        return with_a.join(elements.select(F.col("key").alias("b"), F.col("payload").alias("ys")), "b").select("a", "b", "xs", "ys").mapInArrow(near, "a long, b long")

    def between(one: pa.Table, two: pa.Table) -> list[tuple[int, int]]:
        (xs, xo), (ys, yo) = (_lists(t.column("payload").combine_chunks()) for t in (one, two))
        sizes = np.diff(yo)
        order = np.argsort(ys, kind="stable")
        owners, ys = np.repeat(np.arange(sizes.size), sizes)[order], ys[order]
        keys, labels = (two.column(c).to_numpy() for c in ("key", "label"))
        links = []
        for k, (key, label) in enumerate(zip(one.column("key").to_pylist(), one.column("label").to_pylist(), strict=True)):
            x = xs[xo[k] : xo[k + 1]]
            begin, end = np.searchsorted(ys, x, "left"), np.searchsorted(ys, x, "right")
            n = end - begin
            both = np.bincount(owners[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=sizes.size)
            near = np.flatnonzero((labels != label) & (100 * both >= percent * (x.size + sizes - both)))
            _, first = np.unique(labels[near], return_index=True)
            links += [(key, y) for y in keys[near[first]].tolist()]
        return links

    labels = linked(groups, held, verify, between, sketches=holders.drop("doc_id"), limit=limit)
    discard(groups, holders, *written)
    # only keys change hands here, no document meets another
    least = table.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = least.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("label", "key").alias("label"), "least")
    classes = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(classes, "label").select("key", F.col("label").alias("class"), "component_id")
    joined = table.where("key is not null").join(of, "key").select("doc_id", "text_key", "key", "n_shingles", "class", "component_id")
    return joined.unionByName(table.where("key is null").select("doc_id", "text_key", "key", "n_shingles", F.col("key").alias("class"), F.col("doc_id").alias("component_id")))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with all its columns: that with the smallest doc_id, or the smallest hash of its text among equal doc_ids.

    Rows without doc_id come last. Of rows that repeat both the doc_id and the text one stays, any of them. Documents without words all stay.
    """
    found = materialize(jaccard_classes(docs, doc_id=doc_id, text=text, **options).select("doc_id", "text_key", "class"), "classes")
    rows = found.groupBy("class", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("doc_id", "text_key", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    chosen = rows.where("class is not null").groupBy("class").agg(best.alias("x")).select("x.*", (F.col("x.n") > 1).alias("repeated"))
    kept = chosen.drop("n").unionByName(rows.where("class is null").select("doc_id", "text_key", F.lit(False).alias("repeated")))
    kept = materialize(kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "repeated"), "kept")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    both = whole.join(kept, F.col(f"__row.`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"__row.`{text}`")) == F.col("__key")))
    single = both.where(~F.col("repeated")).unionByName(both.where("repeated").dropDuplicates(["__id", "__key"]))
    return single.select(*(F.col(f"__row.`{c}`") for c in docs.columns))
