"""Shared steps of the similarity joins: from signatures to verified links to connected components.

Keys that share a signature are candidates. Only links decide the components, so pairs whose keys are already connected are not tested.
Groups of the same members are taken as one. Round one tests each key against the most central member of its groups. What is still apart
in large groups is then tested against further members of the group's largest component, a few times; these turns carry large groups alone. The last round tests all pairs that are still apart: in small groups pair by pair;
large groups that overlap are taken together, and what is outside their largest component is held against all of it in blocks of bounded
size, by short sketches first: keys of sizes too far apart don't meet, and payloads are read only of keys whose sketches are near enough.
A sketch has a bit for each of a power of two of buckets: whether it holds an odd number of the key's elements. Each element that one of
two keys has and the other lacks changes one bit at most, so sketches that differ in more bits than a link allows rule it out. Signatures are dealt into shards by their first bits, as packed columns; the shards' number follows from how many are expected, so a
task holds a bounded part of them. Signatures that may be very common are spread over shards by key, counted with partial sums and joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import arrow_rows, discard, materialize
from .textscan import give_back, mix

_U = np.uint64
#: Pairs that a task tests at once; each carries two payloads.
PAIRS = 128
SIGNATURES = "sig long, key long, common boolean"
DEALT = "shard long, common boolean, sigs binary, keys binary"
#: Signatures expected in a shard; beyond ``SHARDS`` shards they get up to eight times as many.
SHARD, SHARDS = 1_000_000, 4096
#: Rows of keys and labels that a task holds at least, where a table has as many: small tables aren't cut into one file for each of the session's partitions.
TASK_ROWS = 50_000
#: A side of a block has so many times as many sketches as it may have payloads.
WIDER = 10
SKETCH = "key long, size long, band long, sketch binary"
Parts = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def sketched(rows: np.ndarray, elements: np.ndarray, bits: np.ndarray) -> pa.Array:
    """The sketch of each row; ``rows``: the row of each element, ``bits``: the length of each row's sketch, a power of two and 64 at least, or 0."""
    ends = np.cumsum(bits)
    place = (ends - bits)[rows] + (elements & (bits[rows] - 1).astype(_U)).astype(np.int64)
    odd = np.zeros(int(ends[-1]) if ends.size else 0, np.uint8)
    np.bitwise_xor.at(odd, place, np.uint8(1))
    offsets = np.concatenate([[0], ends // 8]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), bits.size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.packbits(odd, bitorder="little").tobytes())]).cast(pa.binary())


def _words(sketch: np.ndarray, to: int) -> np.ndarray:
    """Sketches of one length, cut to ``to`` words by adding their halves."""
    while sketch.shape[-1] > to:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _by_length(column: pa.Array | pa.ChunkedArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, rows, sketches as a matrix of words) for each length of sketches in a column."""
    sketches = column.to_pylist()
    words = np.array([len(x) // 8 for x in sketches], np.int64)
    found = [(w, np.flatnonzero(words == w)) for w in np.unique(words).tolist()]
    return [(w, at, np.frombuffer(b"".join(sketches[k] for k in at.tolist()), _U).reshape(at.size, w)) for w, at in found]


def near_pairs(a: pa.Array, b: pa.Array, limits: np.ndarray) -> np.ndarray:
    """Whether the sketches of each pair differ in at most so many bits."""
    near = np.zeros(limits.size, bool)
    for w, at, x in _by_length(a):
        for v, to, y in _by_length(b.take(pa.array(at))):
            w_least = min(w, v)
            far = np.bitwise_count(_words(x[to], w_least) ^ _words(y, w_least)).sum(1, dtype=np.int64)
            near[at[to]] = far <= limits[at[to]]
    return near


def near_matrix(one: list, two: list, limits: np.ndarray) -> np.ndarray:
    """The same for all of one side against all of the other, given as ``_by_length`` has them."""
    near = np.zeros(limits.shape, bool)
    for w, at, x in one:
        for v, to, y in two:
            cell = np.ix_(at, to)
            most, w_least = limits[cell], min(w, v)
            xs, ys = _words(x, w_least), _words(y, w_least)
            far = np.zeros(most.shape, np.int64)
            for k in range(w_least):
                if not (far <= most).any():
                    break
                far += np.bitwise_count(xs[:, k, None] ^ ys[None, :, k])
            near[cell] = far <= most
    return near


def shard_bits(signatures: int) -> int:
    """The shards' number is 2 to this power."""
    n = -(-signatures // SHARD)
    return min(30, (n if n <= SHARDS else max(SHARDS, -(-n // 8))).bit_length())


def as_rows(parts: Parts) -> Iterator[pa.RecordBatch]:
    """Signatures, keys and whether a signature is common, one row each."""
    for columns in parts:
        for k in range(0, columns[0].size, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in columns], ["sig", "key", "common"])


def as_dealt(parts: Parts, bits: int) -> Iterator[pa.RecordBatch]:
    """The same, a row for each shard and run of about a million signatures."""

    def out() -> Iterator[pa.RecordBatch]:
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        for flag in (False, True):
            sig, key = (x[whole[2] == flag] for x in whole[:2])
            if not sig.size:
                continue
            place = mix(sig.view(_U) + (key.view(_U) % _U(64)) * _U(0x9E3779B97F4A7C15)) if flag else sig.view(_U)
            shard = (place >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(sig.size, np.int64)
            order = np.argsort(shard, kind="stable")
            sig, key, shard = sig[order], key[order], shard[order]
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            ends = [*first[1:].tolist(), sig.size]
            blobs = [pa.array([x[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()) for x in (sig, key)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(np.full(first.size, flag)), *blobs], ["shard", "common", "sigs", "keys"])

    held, size = [], 0
    for columns in parts:
        held.append(columns)
        size += columns[0].size
        if size > 1_000_000:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def groups_of(dealt: DataFrame) -> DataFrame:
    """sig, key, n: distinct members of the signatures that n keys share, two or more."""

    def group(table: pa.Table) -> pa.Table:
        parts = []
        for flag in (False, True):
            rows = table.filter(pc.equal(table.column("common"), flag))
            sig, key = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in rows.column(c))]) for c in ("sigs", "keys"))
            if not flag:  # most signatures are alone: they go before the sort of the others
                order = np.argsort(sig)
                sig, key = sig[order], key[order]
                same = np.append(sig[1:] == sig[:-1], False)
                same[1:] |= same[:-1]
                sig, key = sig[same], key[same]
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            new = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])) if sig.size else np.zeros(0, bool)
            sig, key = sig[new], key[new]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if sig.size else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, sig.size))
            n = np.repeat(sizes, sizes)
            at = np.flatnonzero((n > 1) | flag)
            parts.append(pa.table({"sig": sig[at], "key": key[at], "n": n[at], "common": np.full(at.size, flag)}))
        give_back()
        return pa.concat_tables(parts)

    found = materialize(dealt.groupBy("shard").applyInArrow(group, "sig long, key long, n long, common boolean"), "groups")
    common = found.where("common")
    sizes = common.groupBy("sig").agg(F.sum(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(found.where("not common").select("sig", "key", "n").unionByName(common.select("sig", "key").join(sizes, "sig").select("sig", "key", "n")), "candidates")
    discard(found)
    return groups


def _tasks(rows: DataFrame, most: int) -> DataFrame:
    """The same rows, of which there are ``most`` at most, in no more tasks than they need."""
    return rows.coalesce(max(1, -(-most // TASK_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component), for all nodes of the edges (a, b).

    Each round moves every node to its least neighbour, and on to that one's, and contracts the edges; few are left after the first. What
    a round no longer needs is deleted.
    """
    ordered = lambda x: x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, labels = materialize(ordered(edges), "edges"), None
    n = left.count()
    while True:
        ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        near = materialize(_tasks(step, 2 * n), "steps")
        onward = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = materialize(_tasks(near.join(onward, "to").select("node", "far"), 2 * n), "moves")
        before, edges = labels, left
        if labels is None:
            labels = materialize(step.select("node", F.col("far").alias("label")), "labels")
        else:
            moved = labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
            labels = materialize(moved, "labels")
        for end in ("a", "b"):
            left = left.join(step.withColumnsRenamed({"node": end, "far": "moved"}), end).drop(end).withColumnRenamed("moved", end)
        left = materialize(_tasks(ordered(left), n), "edges")
        discard(near, step, edges, *([] if before is None else [before]))
        n = left.count()
        if not n:
            discard(left)
            return labels


def _apart(members: DataFrame) -> DataFrame:
    """The members of groups that hold more than one component."""
    several = members.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
    return materialize(members.join(several, "sig"), "apart")


def _most_shared(pairs: DataFrame) -> DataFrame:
    """Of each key, the pivot with which it shares most groups, as a pair (a, b)."""
    shared = pairs.select("key", "pivot", "times").repartition("key").groupBy("key", "pivot").agg(F.sum("times").alias("n"))
    return materialize(shared.groupBy("key").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("a")).select("a", F.col("key").alias("b")), "pairs")


def linked(groups: DataFrame, held: DataFrame | Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], between: Callable[[pa.Table, pa.Table], list[tuple[int, int]]], small: int = 16, turns: int = 3, block_rows: int = 400, block_weight: int = 500_000, sketches: DataFrame | None = None, limit: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(node, label) of all linked keys. ``groups``: a table that ``groups_of`` has written, as it is read more than once.

    ``held``: key, payload, weight, or what gives these for a table of distinct keys. ``verify`` takes pairs (a, b) and returns those that hold. ``between`` takes two tables (key, label,
    payload) and returns, for each row of the first and each other label of the second, one link that holds, if there is any.
    ``turns``: how often keys outside the largest component of a large group try another member of it. ``block_rows``, ``block_weight``:
    rows and weight of the payloads in one side of a task's block, about.
    ``sketches``: key, size, band, sketch; keys of which the bands differ by more than one have no link, and none of which sizes or the bits of
    sketches differ by more than ``limit``, of two arrays of sizes. Without them ``held`` is a table.
    """
    # the member that shares most with the others comes first in its groups: most of a dense group links to it
    scored = groups.withColumn("score", F.sum("n").over(Window.partitionBy("key")))
    whole = scored.groupBy("sig", "n").agg(F.max_by("key", F.struct("score", "key")).alias("pivot"), F.min("key").alias("least"), F.bit_xor(F.xxhash64("key")).alias("mark"))
    # groups of the same members ask the same: one of them stays, and counts for all
    once = whole.groupBy("n", "pivot", "least", "mark").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("times"))
    members = materialize(groups.join(once.select("sig", "pivot", "times"), "sig"), "members")
    first = _most_shared(members.where("key <> pivot"))
    tested = lambda pairs: _tested(pairs, verify)
    links, more = tested(first), False
    labels, spent = components(links), [links, first]
    of = materialize(members.join(labels.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", "n", "pivot", "times", F.coalesce("label", "key").alias("label")), "labelled")
    discard(members)
    spent.append(of)
    few, many = of.where(F.col("n") <= small), of.where(F.col("n") > small)
    # the turns carry large groups alone, and move keys; small groups follow once, after the last turn
    name, later, moved = many.select("key", "label").distinct(), None, None
    for turn in range(turns):
        main = many.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("m"), F.max_by("key", F.xxhash64("key", F.lit(turn))).alias("other")).groupBy("sig").agg(F.max_by(F.struct("label", "other"), F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
        # groups of one component stay where they are: they meet nothing here
        again = _most_shared(many.join(main.where("labels > 1").select("sig", "main"), "sig").where("label <> main.label").select("key", F.col("main.other").alias("pivot"), "times"))
        spent.append(again)
        # few that are outside make no more than one row of blocks
        found = tested(again) if again.count() > block_rows else None
        if found is not None:
            spent.append(found)
        if found is None or not found.limit(1).count():
            break
        later = found if later is None else later.unionByName(found)
        if moved is None:
            name = materialize(name, "names")
            spent.append(name)
        edges = later.join(name.select(F.col("key").alias("a"), F.col("label").alias("x")), "a").join(name.select(F.col("key").alias("b"), F.col("label").alias("y")), "b")
        ends = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
        moved = ends.select(F.col("node").alias("label"), F.col("label").alias("to"))
        at = name.join(moved, "label", "left").select("key", F.coalesce("to", "label").alias("label"))
        many = materialize(many.drop("label").join(at, "key").select("sig", "key", "n", "pivot", "times", "label"), "apart")
        spent += [ends, many]
    if moved is not None:
        links, more = links.unionByName(later), True
        few = materialize(few.join(moved, "label", "left").select("sig", "key", F.coalesce("to", "label").alias("label")), "few")
        spent.append(few)
    left, right = few.select("sig", F.col("key").alias("a"), F.col("label").alias("x")), few.select("sig", F.col("key").alias("b"), F.col("label").alias("y"))
    rest = left.join(right, "sig").where("a < b and x <> y").select("a", "b").distinct()
    rest = materialize(rest.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    many = _apart(many)
    spent += [rest, many]
    for found in (tested(rest) if rest.limit(1).count() else None, _dense(many, held, between, block_rows, block_weight, sketches, limit) if many.limit(1).count() else None):
        if found is not None:
            spent.append(found)
            links, more = links.unionByName(found), True
    if more:
        spent.append(labels)
        labels = components(links)
    discard(*spent)
    return labels


def _tested(pairs: DataFrame, verify) -> DataFrame:
    with arrow_rows(pairs.sparkSession, PAIRS):
        return materialize(verify(pairs), "links")


def _cuts(weights: np.ndarray, rows: int, weight: int) -> list[tuple[int, int]]:
    """Runs of at most so many rows and, beyond one row, so much weight."""
    ends, out, at = np.cumsum(weights), [], 0
    while at < weights.size:
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + weight, "right"))))
        out.append((at, min(to, weights.size)))
        at = out[-1][1]
    return out


def _dense(members: DataFrame, held, between, block_rows: int, block_weight: int, sketches: DataFrame | None, limit) -> DataFrame:
    """Links between the components of large groups, in blocks: what is outside the largest component of a cluster of such groups against all of the cluster in its band and the next ones."""
    clusters = components(members.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")))
    rows = members.select("key", "label").distinct().join(clusters.select(F.col("node").alias("key"), F.col("label").alias("cluster")), "key")
    facts = held.select("key", F.col("weight").alias("size"), F.lit(0).cast("long").alias("band"), F.lit(b"").alias("sketch")) if sketches is None else sketches
    rows = table = materialize(rows.join(facts, "key").select("cluster", "key", "label", "size", "band", "sketch"), "clusters")
    mains = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    rows = rows.join(mains.where("labels > 1").select("cluster", "main"), "cluster").withColumn("outside", F.col("label") != F.col("main")).drop("main")
    meets = rows.withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(WIDER * block_rows)), F.ceil(F.sum("size") / F.lit(WIDER * block_weight))).cast("int")
    shape = rows.where("outside").groupBy("cluster", "band").agg(blocks.alias("n_out")).join(meets.groupBy("cluster", "band").agg(blocks.alias("n_all")), ["cluster", "band"])
    part = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    out = rows.where("outside").join(shape, ["cluster", "band"]).withColumn("o", part(F.col("n_out"))).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
    everyone = meets.join(shape, ["cluster", "band"]).withColumn("m", part(F.col("n_all"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)))

    def screen(block: pa.Table) -> pa.Table:
        sides, found = [], []
        for side in (block.filter(block.column("outside")), block.filter(pc.invert(block.column("outside")))):
            side = side.sort_by([("size", "ascending"), ("key", "ascending")]).combine_chunks()
            size, label = (side.column(c).to_numpy() for c in ("size", "label"))
            sides.append((side.column("key").to_numpy(), [(slice(*cut), size[slice(*cut)], label[slice(*cut)], _by_length(side.column("sketch").slice(cut[0], cut[1] - cut[0]))) for cut in _cuts(size, block_rows, block_weight)]))
        (one, ones), (two, twos) = sides
        for i, (a, size_a, label_a, x) in enumerate(ones):
            for j, (b, size_b, label_b, y) in enumerate(twos):
                near = label_a[:, None] != label_b[None, :]
                if limit is not None:
                    most = limit(size_a[:, None], size_b[None, :])
                    near &= np.abs(size_a[:, None] - size_b[None, :]) <= most
                    if near.any():
                        near &= near_matrix(x, y, np.where(near, most, -1))
                if near.any():
                    found += [(i, j, True, one[a][near.any(1)], label_a[near.any(1)]), (i, j, False, two[b][near.any(0)], label_b[near.any(0)])]
        first = lambda c, kind: pa.array([block.column(c)[0].as_py()] * n, kind)
        n = sum(x[3].size for x in found)
        column = lambda k, kind: pa.array(np.repeat([x[k] for x in found], [x[3].size for x in found]), kind)
        named = {c: first(c, kind) for c, kind in (("cluster", pa.int64()), ("band", pa.int64()), ("m", pa.int32()), ("o", pa.int32()))}
        named |= {"i": column(0, pa.int32()), "j": column(1, pa.int32()), "outside": column(2, pa.bool_())} if found else {"i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "outside": pa.array([], pa.bool_())}
        return pa.table(named | {c: pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]), pa.int64()) for c, k in (("key", 3), ("label", 4))})

    def pairs(block: pa.Table) -> pa.Table:
        outside = block.column("outside")
        one, two = block.filter(outside), block.filter(pc.invert(outside))
        links = between(one, two) if one.num_rows and two.num_rows else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    place = ["cluster", "band", "m", "o"]
    both = reduce(DataFrame.unionByName, (x.select(*place, "key", "label", "size", "sketch", F.lit(side).alias("outside")) for x, side in ((out, True), (everyone, False))))
    with arrow_rows(members.sparkSession, PAIRS):
        # without this a cluster's blocks would stay together where its rows were joined
        near = both.repartition(*place).groupBy(*place).applyInArrow(screen, "cluster long, band long, m int, o int, i int, j int, outside boolean, key long, label long")
        near = materialize(near, "near")
        wanted = near.select("key").distinct()
        payloads = held(wanted) if callable(held) else held
        place += ["i", "j"]
        links = near.join(payloads.select("key", "payload"), "key").repartition(*place).groupBy(*place).applyInArrow(pairs, "a long, b long")
        links = materialize(links, "links")
    discard(clusters, table, near)
    return links
