"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import functools
import hashlib
import io
import os
import random
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertloom.llm import encode, op1_warc_zip, op2_bloom_lm, op3_hilbert_ann, op4_packing, op5_decontaminate, op6_quality, op7_line_dedup, op8_language_id, op9_token_files, op10_jaccard, simlink, storage, textscan

BLANKS = "[ \t-\r]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split(BLANKS, low(text)) if w]


def make_texts(seed=1, n=120):
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 6))) for _ in range(150)]
    texts = []
    for _ in range(n):
        if texts and random.random() < 0.5:
            tokens = random.choice(texts).split(" ")
            for _ in range(random.randint(0, 6)):
                k = random.randrange(len(tokens))
                tokens[k] = random.choice(vocabulary) if random.random() < 0.6 else tokens[k] + "\n" + random.choice(vocabulary)
            texts.append(" ".join(tokens))
        else:
            texts.append(" ".join(random.choice(vocabulary) + random.choice(["", "", ".", ",", "\n"]) for _ in range(random.randint(1, 90))))
    return texts + [None, "", "  \n\n", "one two", "one two", "ONE two", "x" * 5000, " ".join(vocabulary * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 5) for i, t in enumerate(make_texts())]
    rows += [(None, "a b c d e f g", "en", "s", 0, 6), (3, rows[3][1], "en", "s", 0, 7), (3, rows[3][1], "en", "s", 0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -1")


def test_words_and_hashes_follow_the_text():
    texts = make_texts(4)
    *_, hashes, bounds = textscan.scan_words(*textscan.text_buffer(pa.array(texts)), chunk=64)
    by_word = {}
    for k, t in enumerate(texts):
        assert bounds[k + 1] - bounds[k] == len(words(t))
        for w, h in zip(words(t), hashes[bounds[k] : bounds[k + 1]].tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_encoder_equals_the_library():
    random.seed(3)
    letters = [*"abcXYZ éÉàÀßüÜñ'’.,!?|-<>09\t\n日ªº×÷Ÿÿ&;#", "́", "İ", "ſ", "K", "\u0085", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'ll"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    e = encode.WordEncoder(encode.default_path(), remember=500)
    for k in range(0, len(texts), 300):
        ids, bounds = e.encode(*textscan.text_buffer(pa.array(texts[k : k + 300])))
        for i, t in enumerate(texts[k : k + 300]):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == e.full.encode(t, add_special_tokens=False).ids


def test_op1(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a/\r\nX: y", "same"), (5, "http://b", "same"), (5, None, "same"), (2, "u", None), (3, "u", ""), (None, "u", "same"), (None, "u", "alone"), (7, "u", "é" * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = op1_warc_zip.write_archives(pages, f"{tmp_path}/w", archive_bytes=300, zip64_from=200)
    found = op1_warc_zip.read_archives(op1_warc_zip.archives_in(spark, f"{tmp_path}/w"), range_bytes=100).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter()
    for page, _, html in rows:
        keeper = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        same = keeper is None or keeper == page
        want[(page, len((html or "").encode()), digest(html), "response" if same else "revisit", None if same else keeper)] += 1
    assert got == want
    assert {bytes(r["payload"]).decode() for r in found if r["page_id"] == 7} == {"é" * 100000}
    with open(manifest.first()["path"].removeprefix("file:"), "rb") as f:
        assert zipfile.ZipFile(io.BytesIO(f.read())).testzip() is None
    usual = sorted(map(str, found))
    monkeypatch.setattr(op1_warc_zip, "BROADCAST_ROWS", 1)
    shuffled = op1_warc_zip.read_archives(op1_warc_zip.write_archives(pages, archive_bytes=300, zip64_from=200))
    assert sorted(map(str, shuffled.collect())) == usual
    empty = op1_warc_zip.write_archives(pages.where("page_id = 99"))
    assert op1_warc_zip.read_archives(empty).count() == 0


@pytest.mark.parametrize(("most", "shard"), [(None, 16 << 20), (1000, 1000)])
def test_op2(docs, none, most, shard, monkeypatch):
    """By broadcast with two shards, and by a table with many shards and blocks; the filter has room enough for exact levels."""
    monkeypatch.setattr(op2_bloom_lm, "SHARD", shard)
    got = op2_bloom_lm.score_texts(docs, broadcast_bytes=most, bits_each=400, prior=10.0).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    outside = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    begin, end = ("begin",), ("end",)
    train = [[begin, *words(t), end] for i, t in rows if not outside(i)]
    counts, pairs = Counter(w for t in train for w in t[1:]), Counter(x for t in train for x in zip(t[:-1], t[1:], strict=True))
    n, v = sum(counts.values()), len(counts)
    steps = sorted({int(np.ceil(1.5**k)) for k in range(60)})

    def rough(c):
        low = max((x for x in steps if x <= c), default=0)
        return low and (low + next(x for x in steps if x > c) - 1) / 2

    unseen = min(0.5, max(1, sum(c == 1 for c in counts.values())) / n)

    def chance(a, b):
        alone = (1 - unseen) * rough(counts[b]) / n if counts[b] else unseen / (v + 1)
        context = len(train) if a == begin else rough(counts[a])
        return (min(rough(pairs[a, b]), context) + 10 * alone) / (context + 10)

    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    want = Counter()
    for i, t in rows:
        whole = [begin, *words(t), end]
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in whole[1:])
        want[i, outside(i), len(whole) - 1, sum(counts[w] > 0 for w in whole[1:]), round(base, 6), round(sum(np.log10(chance(*x)) for x in zip(whole[:-1], whole[1:], strict=True)), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert op2_bloom_lm.score_texts(none, broadcast_bytes=most).count() == 0
    assert {r["n_known"] for r in op2_bloom_lm.score_texts(docs.where(op2_bloom_lm.held_out()), broadcast_bytes=most).collect()} == {0}


def test_op2_scores_do_not_depend_on_the_bound_of_the_broadcast(docs, none, monkeypatch):
    rows = docs.count()
    monkeypatch.setattr(op2_bloom_lm, "SHARD", 2000)
    whole, stored = ([tuple(r) for r in op2_bloom_lm.score_texts(docs, broadcast_bytes=most).collect()] for most in (1 << 30, 0))
    assert len(stored) == rows and sorted(stored, key=str) == sorted(whole, key=str)
    assert op2_bloom_lm.score_texts(none, broadcast_bytes=0).count() == 0


def test_filter_levels_are_never_low():
    h = textscan.mix(np.arange(3000, dtype=np.uint64))
    level = op2_bloom_lm.level_of(np.random.default_rng(1).integers(1, 500, 3000))
    assert (np.diff(op2_bloom_lm.VALUES) > 0).all() and (op2_bloom_lm.level_of(op2_bloom_lm.STEPS) == np.arange(1, op2_bloom_lm.STEPS.size + 1)).all()
    bits = np.zeros(10 * int(level.sum()) // 8 * 8, bool)
    for q in range(1, int(level.max()) + 1):
        for at in op2_bloom_lm._places(h[level >= q], q, bits.size):
            bits[at] = True
    found = op2_bloom_lm._levels(h, 0, bits.size, np.packbits(bits, bitorder="little"))
    assert (found >= level).all() and (found == level).mean() > 0.97
    pairs = h | np.uint64(1)
    assert (op2_bloom_lm._unpack_pairs(op2_bloom_lm._pack_pairs(pairs)) == pairs & np.uint64((1 << 48) - 1)).all()


def test_op3(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(900, 12)).astype(np.float32)
    x[100:400] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [float("nan")] * 12, 1), (1003, [None] + [1.0] * 11, 1), (1100, [1.0] * 5, 1), (None, [1.0] * 12, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")
    got = {}
    for r in op3_hilbert_ann.nearest_neighbours(table, block=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit, x = 0, x.astype(float)
    assert sorted(got) == list(range(0, 900, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        hit += len(set(best) & {v for v, _ in found.values()})
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda p: (p[1], p[0])) and len(found) == 10
        assert all(s == pytest.approx(d[v]) for v, s in found.values())
        if d[best[-1]] == 0:
            assert [v for v, _ in sorted(found.values())] == best
    assert hit >= 0.9 * 90
    few = op3_hilbert_ann.nearest_neighbours(table.where("vec_id < 4")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2), (0, 3)]
    assert op3_hilbert_ann.nearest_neighbours(table.where("vec_id < 0")).count() == 0


def test_op4_and_op9(docs, none):
    full = encode.encoder(encode.default_path()).full
    ids = {r["doc_id"]: np.array([*full.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    pieces = op4_packing.pack_documents(docs, max_tokens=256).toPandas()
    assert pieces.length.sum() == sum(ids[r["doc_id"]].size for r in docs.select("doc_id").collect())
    for p in pieces.itertuples():
        of = ids[None if np.isnan(p.doc_id) else int(p.doc_id)]
        assert zlib.crc32(of[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == of.size and p.length > 0
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length == s.offset).all() and (s.length.sum() == 256 or s.length.sum() & (s.length.sum() - 1) == 0)
    table = op9_token_files.token_table(docs).toPandas().sort_values("start")
    assert (table.n_tokens.cumsum() - table.n_tokens == table.start).all() and len(table) == docs.count()
    known = table.doc_id.dropna()
    assert known.is_monotonic_increasing and np.isnan(table.doc_id.iloc[0])
    assert all(zlib.crc32(ids[None if np.isnan(r.doc_id) else int(r.doc_id)].tobytes()) == r.ids_crc32 for r in table.itertuples())
    assert op4_packing.pack_documents(none).count() == op9_token_files.token_table(none).count() == 0


@pytest.mark.parametrize(("tokens", "segments", "loss"), [(256, 256, 256), (256, 3, 256), (256, 40, 100), (128, 1, 1), (64, 5, 7)])
def test_op4_needs_no_padding_under_any_limits(spark, tokens, segments, loss):
    random.seed(tokens + segments)
    lines = [(i, " ".join(random.choice(["and", "this", "unfathomable"]) for _ in range(random.choice([0, 1, 3, 8, 90])))) for i in range(900)] + [(None, "long " * 3000)]
    pieces = op4_packing.pack_documents(spark.createDataFrame(lines, "doc_id long, text string").repartition(3), tokens, segments, loss, pool=64).toPandas()
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        n = s.length.sum()
        assert n <= tokens and len(s) <= segments and s.loss_tokens.sum() <= loss and (s.length.cumsum() - s.length == s.offset).all() and (n == tokens or n & (n - 1) == 0)
    for _, d in pieces.sort_values("start").groupby("doc_id", dropna=False):
        assert d.length.sum() == d.doc_tokens.iloc[0] and (d.length.cumsum() - d.length == d.start).all()
    assert pieces.doc_id.nunique(dropna=False) == 901


def test_whole_examples_keep_every_limit(spark):
    random.seed(5)
    rows = [(i, random.randint(1, 90), random.randint(0, 30)) for i in range(400)] + [(400, None, None), (401, 500, 10)]
    placed = op4_packing.pack_examples(spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long"), 128, 4, 40).toPandas()
    assert sorted(placed.example_id) == list(range(402))
    for _, s in placed.groupby("sequence_id"):
        assert len(s) == 1 or (s.n_tokens.sum() <= 128 and len(s) <= 4 and s.n_loss.sum() <= 40)


def test_op5(spark, docs, none, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [(1, texts[0]), (2, texts[5]), (10, "one two"), (3, None), (4, "..."), (None, texts[7]), (5, texts[5])]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for item, t in bench:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    got = op5_decontaminate.contamination(docs, benchmark).collect()
    assert len(got) == docs.count()
    for r in got:
        w, hit, items = split(texts[r["doc_id"]]), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    items |= windows[tuple(w[k : k + size])]
        names = sorted(str(i) for i in items if i is not None)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["hit"]) == (len(w), len(hit), len(names), sorted(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest() and r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    with monkeypatch.context() as tight:
        tight.setattr(op5_decontaminate, "BROADCAST_BYTES", 0)
        assert Counter(map(str, op5_decontaminate.contamination(docs, benchmark).collect())) == Counter(map(str, got))
    bad = {r["doc_id"] for r in got if r["contaminated"]}
    kept = op5_decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad)
    clean = {r["doc_id"]: r["text"] for r in op5_decontaminate.remove_contaminated(docs, benchmark, spans=True).collect()}
    assert not split(clean[0]) and clean[None] == texts[None]
    assert op5_decontaminate.contamination(docs, benchmark.where("item_id < 0")).where("n_hit > 0").count() == 0
    assert op5_decontaminate.contamination(none, benchmark).count() == 0


def test_op6(spark, none):
    random.seed(6)
    good = [" ".join(random.choice(["the", "of", "garden", "river", "stone", "walks"]) for _ in range(40)) + "." for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + [t.upper().replace(" ", "!! ") for t in good[:80]])] + [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(230)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = op6_quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 230]
    assert held and sum(r["predicted"] == int(r["doc_id"] < 150) for r in held) >= 0.95 * len(held)
    assert {r["score"] for r in op6_quality.quality_scores(docs, labels.where("quality > 5")).collect()} == {0.5}
    assert op6_quality.quality_scores(none.select("doc_id", "text"), labels).count() == 0


def test_op6_draws_at_most_so_many_distinct_texts(spark):
    rows = spark.range(9000).selectExpr("array(1D) AS statistics", "CAST(id % 2 AS INT) AS label", "CASE WHEN id % 3 = 0 THEN 7L WHEN id % 3 = 1 THEN xxhash64(id) ELSE xxhash64(id % 900) END AS draw")
    draws = sorted({r["draw"] for r in rows.collect()}, key=lambda v: (v % (1 << 64) >> 32, v))
    for most in (5, 1000, 50_000):
        assert sorted(r["draw"] for r in op6_quality.drawn(rows, most).collect()) == sorted(draws[:most])


def test_op6_statistics_equal_plain_python():
    random.seed(66)
    texts = ["", "One two TWO two\nthree,", "a1!? |#x <b> é日 _(;", "x" * 20 + " Abc.\t\x0b abc", " \n ", *("".join(random.choice("aAbB zé .,!\n1|#(") for _ in range(random.randint(1, 60))) for _ in range(60))]
    got = op6_quality.statistics(*textscan.text_buffer(pa.array([*texts, None])))
    for text, row in zip([*texts, ""], got, strict=True):
        raw, w = text.encode(), words(text)
        sizes, share = [len(x.encode()) for x in w], lambda chars, raw=raw: sum(chr(b) in chars for b in raw if b < 128) / max(len(raw), 1)
        symbols, mean = "#$%&*@^~<>{}[]=+\\_/", sum(sizes) / max(len(sizes), 1)
        other = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in symbols + "!?|,.")
        many, found = max(len(w), 1), re.findall(f"[^{BLANKS[1:-2]}]+", text)
        want = [np.log1p(len(raw)), np.log1p(len(w)), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("!?"), share("|"), share(symbols), share(",."), share(other), sum(b > 127 for b in raw) / max(len(raw), 1), share(" \t\x0b\x0c\r"), share("\n")]
        want += [mean, np.sqrt(sum((v - mean) ** 2 for v in sizes) / many), len(set(w)) / many, sum(a == b for a, b in zip(w, w[1:], strict=False)) / many, max(Counter(w).values(), default=0) / many, sum("A" <= x[0] <= "Z" for x in found) / many, np.log1p(len(raw) / (text.count("\n") + 1)), sum(v > 15 for v in sizes) / many]
        assert row == pytest.approx(want, abs=1e-7), text


def test_op6_equals_numpy(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(400, len(op6_quality.STATISTICS))) * np.arange(1, 21) + 5
    y = (x[:, 0] + random.normal(size=400) > 5).astype(int)
    calibrates = np.arange(400) % 4 == 0
    rows = spark.createDataFrame([(v.tolist(), int(label), bool(c)) for v, label, c in zip(x, y, calibrates, strict=True)], "statistics array<double>, label int, calibrates boolean").repartition(3)
    model = op6_quality.fit(rows, features=64, bins=20)
    z = np.clip((x - x.mean(0)) / x.std(0), -5, 5)
    design = np.hstack([np.cos(z @ model.frequencies + model.phases) * np.sqrt(2 / 64), z, np.ones((400, 1))])
    fitted = design[~calibrates]
    normal = fitted.T @ fitted
    weights = np.linalg.solve(normal + 1e-3 * max(1, np.trace(normal) / len(normal)) * np.eye(len(normal)), fitted.T @ y[~calibrates])
    assert model.weights == pytest.approx(weights, rel=1e-6, abs=1e-9)
    raw, label = design[calibrates] @ weights, y[calibrates]
    step = (raw.max() - raw.min()) / 20
    bins = np.floor((raw - raw.min()) / step)
    total, weight = (np.array([f(bins == b) for b in np.unique(bins)]) for f in (lambda m: label[m].sum() + 0.5 * y.mean(), lambda m: m.sum() + 0.5))
    n = total.size
    smooth = [max(min(total[a : b + 1].sum() / weight[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert op6_quality.isotonic(total, weight) == pytest.approx(smooth)
    assert model.values == pytest.approx(np.array(smooth) * 0.998 + 0.002 * (model.edges - raw.min()) / (raw.max() - raw.min()))
    assert model.score(x) == pytest.approx(np.clip(np.interp(design @ weights, model.edges, model.values), 0, 1))
    wide = op6_quality.Model(np.zeros(20), np.ones(20), 20_000, 4.0, 7)
    u, v = random.normal(size=(2, 20))
    cosines = np.stack([np.cos(t @ wide.frequencies + wide.phases) * np.sqrt(2 / 20_000) for t in (u, v)])
    assert cosines[0] @ cosines[1] == pytest.approx(np.exp(-((u - v) ** 2).sum() / 2 / 4.0**2), abs=0.03)


def test_op6_long_repeated_and_clashing(spark):
    texts = ["the river walks. " * 20000, "the river walks", "the river walks", "X!! Y!!", None]
    docs = spark.createDataFrame([(1, texts[0], 9, "a"), (2, texts[1], 9, "a"), (2, texts[2], 9, "a"), (3, texts[3], 9, "b"), (4, None, 9, "b")], "doc_id long, text string, score long, statistics string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    got = op6_quality.quality_scores(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 2, 3: 1, 4: 1} and len({r["score"] for r in got if r["doc_id"] == 2}) == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_edit_distance_and_signatures(tau):
    random.seed(tau)
    pairs = []
    for _ in range(600):
        a = "".join(random.choice("abé") for _ in range(random.randint(0, 14)))
        b = list(a)
        for _ in range(random.randint(0, 4)):
            k = random.randint(0, len(b))
            b[k : k + random.randint(0, 1)] = random.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    found = op7_line_dedup.within([(op7_line_dedup._code_points(a), op7_line_dedup._code_points(b)) for a, b in pairs], tau)
    assert found.tolist() == [distance(a, b) <= tau for a, b in pairs]
    for a, b in pairs:
        if min(len(a), len(b)) > tau and distance(a, b) <= tau:
            one, two = (set(op7_line_dedup.line_signatures(op7_line_dedup._code_points(x).astype("<u4"), np.array([0]), np.array([len(x)]), tau)[1].tolist()) for x in (a, b))
            assert one & two


@pytest.mark.parametrize("common", [1, 1000])
def test_op7(docs, none, common, monkeypatch):
    monkeypatch.setattr(op7_line_dedup, "COMMON", common)
    rows = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"] is not None})
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    lines = sorted({x for *_, t in rows for x in t.split("\n") if word.search(x)})
    parent = {x: x for x in lines}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                parent[top(a)] = top(b)
    seen, want = set(), {}
    for known, i, t in rows:
        kept = []
        for x in t.split("\n"):
            if not word.search(x) or top(x) not in seen:
                kept.append(x)
                seen |= {top(x)} if word.search(x) else set()
        want[(i if known else None)] = "\n".join(kept)
    got = op7_line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "n_near"] and got.count() == docs.count()
    for r in got.collect():
        assert r["text"] == want.get(r["doc_id"])
    assert op7_line_dedup.dedup_lines(none).count() == 0
    clash = docs.withColumns({"n_removed": docs.n_chars, "__lines": docs.lang})
    assert sorted(op7_line_dedup.dedup_lines(clash).columns) == sorted([*docs.columns, "__lines", "n_lines", "n_removed", "n_near"])
    stage = op7_line_dedup.remove_duplicate_lines(clash)
    assert stage.columns == clash.columns and {r["n_removed"] for r in stage.collect()} == {0}
    assert all(r["n_chars"] in (0, len(r["text"] or "")) and (r["text"] or "") == (want.get(r["doc_id"]) or "") for r in stage.collect())


def test_op8(spark, none):
    random.seed(8)
    stems = {"en": ["the", "and", "ing", "with"], "de": ["der", "und", "ung", "für"], "fr": ["les", "et", "tion", "été"]}
    rows = [(i, " ".join("".join(random.choices(stems[lang], k=random.randint(1, 3))) for _ in range(30)), lang) for i, lang in enumerate(random.choices(sorted(stems), k=300))]
    rows += [(900, None, "en"), (901, "123 ...", "de"), (902, "", None), (None, "und der für", None), (903, "x" * 3000, None), (904, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, table = op8_language_id.learn(docs.where(~op8_language_id.held_out()))
    got = op8_language_id.identify(docs, languages, table).collect()
    assert languages == ["de", "en", "fr"] and len(got) == len(rows) and all(0 <= r["lang_score"] <= 1 for r in got)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    assert [r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)] == ["und"] * 3
    assert "und" not in [r["lang_pred"] for r in got if r["doc_id"] in (903, 904)]
    kept = op8_language_id.keep_identified(docs.withColumn("lang_pred", docs.lang))
    # without a letter, or in no learned language
    assert kept.columns[-1] == "lang_pred" and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows if i not in (900, 901, 902, 903, 904))
    empty = op8_language_id.learn(docs.where("lang is null"))
    assert {r["lang_pred"] for r in op8_language_id.identify(docs, *empty).collect()} == {"und"}
    assert op8_language_id.keep_identified(none).count() == 0


def test_op8_rejects_languages_that_were_not_learned(spark):
    random.seed(88)
    pools = {"en": "the of and river stone walks garden evening".split(), "de": "der und über fluss straße geht garten abend".split()}
    rows = [(i, " ".join(random.choice(pools[lang]) for _ in range(random.randint(3, 60))), lang) for i, lang in enumerate(["en", "de"] * 150)]
    foreign = [(900, "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", None), (901, "Все счастливые семьи похожи друг на друга", None), (902, None, None), (903, "12 !!", None), (904, rows[0][1], None)]
    docs = spark.createDataFrame(rows + foreign, "doc_id long, text string, lang string").withColumn("lang_fit", F.lit("x"))
    kept = op8_language_id.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(300), 904]


def test_op8_learns_copies_of_a_text_once(spark):
    rows = [(i, "the river and the stone", "en") for i in range(50)] + [(99, "der fluss und der stein", "de"), (100, "the evening walks", "en")]
    once = [rows[0], *rows[-2:]]
    learn = lambda r: op8_language_id.learn(spark.createDataFrame(r, "doc_id long, text string, lang string"))
    assert learn(rows)[1] == pytest.approx(learn(once)[1], rel=1e-12)


def test_forward_sums_all_segmentations():
    pieces = op8_language_id._pieces(op8_language_id.default_vocabulary())
    random.seed(2)
    table = np.random.default_rng(3).random((len(pieces.texts), 2)) / 50
    number = {t: k for k, t in enumerate(pieces.texts)}

    def brute(t):
        return np.ones(2) if not t else sum((table[number[t[:k]]] * brute(t[k:]) for k in range(1, len(t) + 1) if t[:k] in number), np.zeros(2))

    for text in (b"\x01the", b"\x01ation", b"\x01" + "été".encode()):
        assert op8_language_id.forward(np.frombuffer(text, np.uint8)[None], pieces, table)[-1][0] == pytest.approx(brute(text))


def test_long_words_are_summed_over_all_segmentations(monkeypatch):
    pieces = op8_language_id._pieces(op8_language_id.default_vocabulary())
    table = np.random.default_rng(3).random((len(pieces.texts), 2)) / 3
    number = {t: k for k, t in enumerate(pieces.texts)}
    monkeypatch.setattr(op8_language_id, "BLOCK", 48)
    for text in (b"\x01" + b"theinternationalizationofwords" * 20, b"\x01" + "Становништво日本été".encode() * 11):
        logs = [np.zeros(2)]
        for end in range(1, len(text) + 1):
            parts = [logs[end - k] + np.log(table[number[text[end - k : end]]]) for k in range(1, min(end, pieces.longest) + 1) if text[end - k : end] in number]
            logs.append(np.logaddexp.reduce(parts))
        assert op8_language_id.long_word(np.frombuffer(text, np.uint8), pieces, table) == pytest.approx(logs[-1], rel=1e-12)
        word, weight, got = np.frombuffer(text[:130], np.uint8), np.array([2.0, 3.0]), np.zeros_like(table)
        op8_language_id.long_word(word, pieces, table, weight, got)
        assert got == pytest.approx(op8_language_id.expected(word[None], weight[None], pieces, table), abs=1e-9)
    groups, long, inverse, rows, n = op8_language_id.distinct_words(*textscan.text_buffer(pa.array(["ab " + "é" * 40 + " ab", None, "é" * 40])))
    assert n == 2 and rows.tolist() == [0, 0, 0, 2] and len(groups) == 1 and long[0][1].tobytes() == b"\x01" + "é".encode() * 40


@pytest.mark.parametrize("options", [{}, {"small": 2, "block_rows": 5, "turns": 1}])
def test_op10(docs, none, options, monkeypatch):
    monkeypatch.setattr(op10_jaccard, "linked", functools.partial(op10_jaccard.linked, **options))
    rows = docs.collect()
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[top(k)] = min(least.get(top(k), r["doc_id"]), r["doc_id"])
    got = op10_jaccard.jaccard_classes(docs).collect()
    want = Counter((r["doc_id"], len(sets[k]), least.get(top(k)) if sets[k] else r["doc_id"]) for k, r in enumerate(rows))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = op10_jaccard.keep_one_of_each(docs)
    first = {}
    for k, r in enumerate(rows):
        if sets[k]:
            order = (r["doc_id"] is None, r["doc_id"] or 0)
            first[top(k)] = min(first.get(top(k), order), order)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([i for missing, i in first.values() if not missing]) + Counter([None for missing, _ in first.values() if missing]) + Counter(r["doc_id"] for k, r in enumerate(rows) if not sets[k])
    assert op10_jaccard.jaccard_classes(none).count() == 0


def test_one_of_each_with_repeated_and_missing_ids(spark):
    text, other = "a b c d e f g h", "q w e r t z u i"
    rows = [(None, text, 1), (None, text, 2), (None, other, 3), (5, other, 4), (5, other, 5), (5, text + " x y", 6), (7, None, 7), (7, None, 8), (None, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class long")
    kept = op10_jaccard.keep_one_of_each(docs)
    found = sorted((r["class"] for r in kept.collect()))
    assert kept.columns == docs.columns and len(found) == 6
    assert found[0] in (1, 2) and found[1] in (4, 5) and found[2:] == [6, 7, 8, 9]


def test_op8_learns_from_every_labelled_text(spark):
    docs = spark.range(7000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the river "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    languages, texts = op8_language_id.training_texts(docs)
    assert languages == ["en"] and texts.count() == 7000
    counts = {bytes(r["word"]).decode(): r["n0"] for r in op8_language_id.word_counts(texts, 1).collect()}
    assert counts["the"] == counts["river"] == 7000 and counts["6999"] == 1 and len(counts) == 7002


def test_equal_groups_are_taken_once_and_turns_carry_large_groups_alone(spark, monkeypatch):
    rows = [(sig, key, 60) for sig in range(21) for key in range(60)] + [(100 + k, key, 2) for k in range(200) for key in (1000 + 2 * k, 1001 + 2 * k)]
    groups = spark.createDataFrame(rows, "sig long, key long, n long")
    held = groups.select("key").distinct().select("key", F.lit("").alias("payload"), F.lit(1).cast("long").alias("weight"))
    verify = lambda pairs: pairs.where("a < 1000 and abs(a - b) <= 30")
    between = lambda one, two: [(a, b) for a in one.column("key").to_pylist() for b in two.column("key").to_pylist() if a != b and abs(a - b) <= 30]
    written, write = [], simlink.materialize
    monkeypatch.setattr(simlink, "materialize", lambda df, name: (out := write(df, name), written.append((name, out.count())))[0])
    labels = simlink.linked(groups, held, verify, between, block_rows=5)
    assert {(r["node"], r["label"]) for r in labels.collect()} == {(k, 0) for k in range(60)}
    sizes = lambda name: [n for what, n in written if what == name]
    assert sizes("members")[-1] == 60 + 400 and sizes("apart")[0] <= 460 and len(sizes("apart")) > 1 and max(sizes("apart")[1:]) <= 60


def test_turns_join_groups_once_in_few_tasks_and_leave_only_labels(spark, monkeypatch):
    groups = spark.createDataFrame([(sig, key, 60) for sig in range(3) for key in range(sig, 60)], "sig long, key long, n long")
    held = groups.select("key").distinct().select("key", F.lit("").alias("payload"), F.lit(1).cast("long").alias("weight"))
    verify = lambda pairs: pairs.where("abs(a - b) <= 20")
    between = lambda one, two: [(a, b) for a in one.column("key").to_pylist() for b in two.column("key").to_pylist() if a != b and abs(a - b) <= 20]
    files, joins, write, apart = [], [], simlink.materialize, simlink._apart
    monkeypatch.setattr(simlink, "materialize", lambda df, name: (out := write(df, name), files.append((name, len(out.inputFiles()))))[0])
    monkeypatch.setattr(simlink, "_apart", lambda members: (joins.append(1), apart(members))[1])
    folder = f"{storage.work_dir(spark)}/alertloom"
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        labels = simlink.linked(groups, held, verify, between, block_rows=5)
        assert {(r["node"], r["label"]) for r in labels.collect()} == {(k, 0) for k in range(60)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert any(name == "names" for name, _ in files), "no turn moved a key"
    assert len(joins) == 1
    assert max(n for name, n in files if name in ("steps", "moves")) == 1
    assert {x.rpartition("-")[0] for x in set(os.listdir(folder)) - there} == {"labels"}


def test_sketches_never_rule_out_a_link():
    random.seed(12)
    sets = [np.unique(np.random.default_rng(k).integers(0, 1 << 63, n).astype(np.uint64)) for k, n in enumerate((1, 3, 60, 64, 65, 130, 500, 700))]
    sets += [np.concatenate([x[: x.size - x.size // 9], np.arange(k, k + 5, dtype=np.uint64) * np.uint64(977)]) for k, x in enumerate(sets)]
    sketches = op10_jaccard.set_sketches(sets)
    assert [len(x) * 8 >= max(64, s.size) for x, s in zip(sketches.to_pylist(), sets, strict=True)] == [True] * len(sets)
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(sets)) for j in range(len(sets))], strict=True))
    apart = np.array([np.setxor1d(sets[i], sets[j]).size for i, j in zip(a, b, strict=True)])
    assert simlink.near_pairs(sketches.take(pa.array(a)), sketches.take(pa.array(b)), apart).all()
    assert not simlink.near_pairs(sketches.take(pa.array([6, 7])), sketches.take(pa.array([7, 6])), np.array([133, 133])).any()
    whole = simlink._by_length(sketches)
    assert np.array_equal(simlink.near_matrix(whole, whole, apart.reshape(len(sets), -1)), np.ones((len(sets), len(sets)), bool))
    lines, edited = ["a river walks by the old garden gate", "ab", "", "straße über den fluss und zurück"], []
    for line in lines:
        for _ in range(40):
            x = list(line)
            for _ in range(2):
                k = random.randint(0, len(x))
                x[k : k + random.randint(0, 1)] = random.choice(["", "q", "e"])
            edited.append((line, "".join(x)))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(edited))), pa.array([e[k] for e in edited])], ["key", "payload"]) for k in (0, 1)]
    one, two = (op7_line_dedup.line_sketches(x, 2) for x in batches)
    held = np.array([abs(len(x) - len(y)) <= 2 for x, y in edited])
    assert (simlink.near_pairs(one.column(3), two.column(3), np.full(len(edited), 8)) & (abs(one.column(2).to_numpy() - two.column(2).to_numpy()) <= 1))[held].all()


def test_blocks_ask_for_payloads_of_near_keys_alone(spark):
    draw = np.random.default_rng(5)
    sets = [draw.integers(0, 1 << 63, 40 + 3 * k).astype(np.uint64) for k in range(60)]
    sets[31] = np.append(sets[30][:-2], np.uint64(7))
    bands = [int(np.log(x.size) / np.log(1.26)) for x in sets]
    sketches = spark.createDataFrame([(k, x.size, band, s) for k, (x, band, s) in enumerate(zip(sets, bands, op10_jaccard.set_sketches(sets).to_pylist(), strict=True))], simlink.SKETCH)
    groups = spark.createDataFrame([(1, key, 60) for key in range(60)], "sig long, key long, n long")
    asked = []

    def held(keys):
        asked.append(sorted(r["key"] for r in keys.collect()))
        return keys.select("key", F.lit("").alias("payload"), F.lit(1).cast("long").alias("weight"))

    links = lambda x, y: {x, y} == {30, 31}
    between = lambda one, two: [(a, b) for a in one.column("key").to_pylist() for b in two.column("key").to_pylist() if links(a, b)]
    labels = simlink.linked(groups, held, lambda pairs: pairs.where("false"), between, block_rows=5, sketches=sketches, limit=lambda a, b: (a + b) // 9)
    assert asked == [[30, 31]] and sorted(map(tuple, labels.collect())) == [(30, 30), (31, 30)]


def test_tables_free_the_shuffle_files_they_took(spark):
    there = lambda: {x.getName() for x in map(lambda k: files.apply(k), range(files.size()))} if (files := spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) else set()
    before = there()
    table = storage.materialize(spark.range(5000).withColumn("k", F.col("id") % 100).groupBy("k").count(), "counts")
    end = time.time() + 20
    while (left := [x for x in there() - before if x.startswith("shuffle_") and x.endswith(".data")]) and time.time() < end:
        time.sleep(0.2)
    assert not left and table.count() == 100


def test_lines_and_classes_leave_no_tables_of_the_linking_behind(spark):
    line = "a river walks through the quiet garden of stone number "
    docs = spark.createDataFrame([(i, "\n".join(f"{line}{(i + j) % 9}" for j in range(4))) for i in range(30)], "doc_id long, text string")
    folder = f"{storage.work_dir(spark)}/alertloom"
    for run, kept in ((op7_line_dedup.duplicate_lines, {"lines", "repeated-lines"}), (op10_jaccard.jaccard_classes, {"sets", "labels"})):
        there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        assert run(docs).count() == 30
        assert {x.rpartition("-")[0] for x in set(os.listdir(folder)) - there} == kept


def test_words_of_all_lengths_are_summed_at_once():
    pieces = op8_language_id._pieces(op8_language_id.default_vocabulary())
    table = np.random.default_rng(4).random((len(pieces.texts), 2)) / 3
    found = [w.encode() for w in ("garden", "a", "Straße", "internationalization", "the", "日本", "x" * 64, "gardens")]
    data, sizes = np.frombuffer(b"".join(found), np.uint8), np.array([len(w) for w in found])
    graph = op8_language_id.Lattice(data, np.cumsum(sizes) - sizes, sizes, pieces)
    for k in range(2):
        got = np.log(graph.ahead(table[graph.piece, k])[graph.last()])
        assert got == pytest.approx([op8_language_id.long_word(np.frombuffer(b"\x01" + w, np.uint8), pieces, table)[k] for w in found], rel=1e-12)


def test_op8_remembers_words_between_batches_and_identifies_texts_once(spark, monkeypatch):
    rows = [(i, " ".join(f"{'river' if i % 2 else 'fluss'}{j % 7} stone" for j in range(i, i + 5)), "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    learned, calls, identify = op8_language_id.learn(docs), [], op8_language_id.identify
    scores = lambda: {r["doc_id"]: (r["lang_pred"], r["lang_score"], r["lang_fit"]) for r in identify(docs, *learned).collect()}
    whole = scores()
    with storage.arrow_rows(spark, 1):
        single = scores()
    assert {k: v[0] for k, v in whole.items()} == {k: v[0] for k, v in single.items()}
    assert all(single[k][1:] == pytest.approx(v[1:], rel=1e-12) for k, v in whole.items())
    monkeypatch.setattr(op8_language_id, "identify", lambda *a, **k: (calls.append(1), identify(*a, **k))[1])
    assert op8_language_id.keep_identified(docs).count() and len(calls) == 1
