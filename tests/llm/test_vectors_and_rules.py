"""Whitening, vector codes and quality rules against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alertloom.llm import op11_whitening, op12_vector_codes, op13_quality_rules, queries

DATA = "/root/testdata/sf0.001"
ODD = [(None, [1.0] * 8), (3, None), (4, []), (5, [1.0] * 7 + [None]), (6, [math.nan] * 8), (7, [math.inf] + [0.0] * 7), (8, [1.0, 2.0])]


def make_vectors(spark, n=60, seed=2, large=1.0):
    draw = np.random.default_rng(seed)
    rows = [(int(i), [float(v) for v in draw.normal(size=8) * np.arange(1, 9) * large]) for i in draw.permutation(n) + 20]
    rows += [rows[3], rows[3], (rows[5][0], rows[4][1])] + ODD
    kept = [(i, x) for i, x in rows if x and len(x) == 8 and all(v is not None and math.isfinite(v) for v in x)]
    labelled = [(i, x, [None, 1, 2][k % 3], "n", 0.5) for k, (i, x) in enumerate(rows)]
    labels = [label for (i, x, label, _, _) in labelled if (i, x) in kept]
    df = spark.createDataFrame(labelled, "vec_id long, embedding array<double>, label int, n string, whitened double").repartition(5)
    return df, kept, labels


@pytest.mark.parametrize("large", [1.0, 1e7])
def test_op11_equals_exact_sums_and_numpy(spark, large):
    df, kept, _ = make_vectors(spark, large=large)
    got = op11_whitening.whitened_components(df, 5).collect()
    x = [[math.floor(64 * v) + 1_000_000 for v in vector] for _, vector in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in x])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    white = centred @ axes / np.sqrt(e)
    rows = defaultdict(list)
    for r in got:
        assert r["n"] == n and math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9
        rows[r["component"]].append((r["vec_id"], r["deviation"], r["whitened"]))
    assert sorted(rows) == [1, 2, 3, 4, 5]
    for k, found in rows.items():
        far = [d if d < 1 << 63 else None for d in deviation]
        fits = [sorted(((i, d, round(sign * w, 7)) for (i, _), d, w in zip(kept, far, white[:, k - 1], strict=True)), key=repr) for sign in (1, -1)]
        assert sorted(((i, d, round(w, 7)) for i, d, w in found), key=repr) in [[(i, d, w + 0.0) for i, d, w in f] for f in fits]


def test_op11_without_variance_or_rows(spark):
    same = spark.createDataFrame([(k, [1.0, float(k % 2), 5.0]) for k in range(6)], "vec_id long, embedding array<double>")
    got = op11_whitening.whitened_components(same).collect()
    assert Counter((r["component"], r["whitened"] is None) for r in got) == {(1, False): 6, (2, True): 6, (3, True): 6}
    assert {abs(round(r["whitened"], 9)) for r in got if r["component"] == 1} == {1.0} and {r["identity_error"] for r in got if r["component"] == 1}.pop() < 1e-9
    still = op11_whitening.whitened_components(same.selectExpr("vec_id", "array(1D, 2D) AS embedding")).collect()
    assert len(still) == 12 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in still)
    none = op11_whitening.whitened_components(same.where("vec_id < 0"))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute_codes(kept, labels, parts, entries, rounds=6):
    x = [[max(-(2**29), min(2**29, math.floor(4096 * v))) for v in vector] for _, vector in kept]
    m = len(x[0]) // parts
    cut = lambda row, p: row[p * m : p * m + m]
    first = sorted((i is None, i or 0, row) for (i, _), row in zip(kept, x, strict=True))[:entries]
    books = [[cut(row, p) for *_, row in first] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for row in x:
                members[near(cut(row, p), books[p])[1]].append(cut(row, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else old for k, old in enumerate(books[p])]
    found = [[near(cut(row, p), books[p]) for p in range(parts)] for row in x]
    errors, total = [sum(d for d, _ in f) for f in found], Counter()
    for label, error in zip(labels, errors, strict=True):
        total[label] += error
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, total[label], sha) for (i, _), f, e, label in zip(kept, found, errors, labels, strict=True))


@pytest.mark.parametrize(("parts", "entries", "large", "broadcast"), [(2, 16, 1.0, 100_000), (1, 5, 40.0, 0), (8, 16, 0.001, 0)])
def test_op12_equals_brute_force(spark, monkeypatch, parts, entries, large, broadcast):
    monkeypatch.setattr(op12_vector_codes, "BROADCAST_LABELS", broadcast)
    df, kept, labels = make_vectors(spark, seed=parts, large=large)
    got = op12_vector_codes.vector_codes(df, parts=parts, entries=entries).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == brute_codes(kept, labels, parts, entries)


def test_op12_rare_labels_take_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(op12_vector_codes, "BROADCAST_LABELS", 10)
    coded = spark.sql("SELECT id AS vec_id, CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS label, id AS error FROM range(6000)")
    got = op12_vector_codes._with_label_sums(coded)
    rows = got.collect()
    total = Counter()
    for r in rows:
        total[r["label"]] += r["error"]
    assert len(rows) == 6000 and got.columns == ["vec_id", "label", "error", "label_error"] and all(r["label_error"] == total[r["label"]] for r in rows)


def test_bounds_keep_the_nearest_entry_and_filter():
    draw = np.random.default_rng(3)
    for m in (1, 2, 6, 8):
        book = draw.integers(-5000, 5000, (16, m))
        book[7] = book[2]
        x = np.vstack([book[draw.integers(0, 16, 400)] + draw.integers(-600, 600, (400, m)), book, draw.integers(-3, 3, (50, m)), draw.integers(-(1 << 27), 1 << 27, (50, m))])
        code, far, exact = op12_vector_codes.nearest_entries(x, book)
        want = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == want.argmin(1)).all() and (far == want.min(1)).all()
        assert m == 1 or exact < 0.5 * want.size
        _, _, least = op12_vector_codes.nearest_entries(np.repeat(book[:1], 3, 0), np.repeat(book[:1], 4, 0))
        assert least == 12  # ties survive


def test_op12_decodes_and_takes_few_or_no_rows(spark):
    few = spark.createDataFrame([(2, [0.5, -0.25, 1.0], "b"), (1, [1.0, 0.0, 0.0], "a")], "vec_id long, embedding array<float>, label string")
    codes, books = op12_vector_codes.encode(few, parts=2)
    assert {(r["vec_id"], r["code"], r["error"]) for r in codes.collect()} == {(1, "0000", 0), (2, "0101", 0)}
    assert {r["vec_id"]: r["decoded"] for r in op12_vector_codes.decode(codes, books).collect()} == {1: [4096, 0, 0, 0], 2: [2048, -1024, 4096, 0]}
    none = op12_vector_codes.vector_codes(few.where("vec_id < 0"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_op12_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.ORACLE_SQL['op12_segment_bound_codes']})").fetchall()
    got = [tuple(r) for r in queries.op12_segment_bound_codes(spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(w):
    return xxhash.xxh64(w.encode(), seed=42).intdigest()


def both(a, b):
    first = xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()
    return xxhash.xxh64(b.to_bytes(8, "little"), seed=first).intdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rules(text):
    w = words_of(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def make_texts(seed=9):
    random.seed(seed)
    good, junk = [f"wört{k}" for k in range(60)], [f"zz{k}&&&" for k in range(40)]
    texts = []
    for k in range(150):
        pool = junk if k % 5 == 0 else good
        texts.append(" ".join(random.choice(pool) + random.choice(["", "", ",", "\n", "\t", "\x0b"]) for _ in range(random.randint(5, 80))))
    return texts + [None, "", " \n\r\n ", "one two", "a b c d e " * 4, "a a a a a a a a a a a a", "line one here\nline one here\n \nother\nline one here", "x" * 70_000, "| <b> #* $% é", " ".join(good * 40)]


def labelled(spark, texts):
    rows = [(i, t, "score", i * 10) for i, t in enumerate(texts)] + [(None, texts[1], "x", 1), (2, texts[2], "x", 1), (2, texts[2], "x", 1), (2, texts[3], "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int").repartition(6)
    marks = [(i, int(i % 5 != 0), int(i % 30 == 1)) for i in range(0, 120)] + [(7, 1, None), (7, 1, 0), (None, 1, 0), (9, None, 0), (999, 1, 0)]
    return rows, docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


@pytest.mark.parametrize("most", [20_000, 40])
def test_op13_equals_brute_force(spark, most):
    rows, docs, labels, marks = labelled(spark, make_texts())
    bits, loss, unit = 10, 0.1, 1 << 20
    got = op13_quality_rules.quality_rules(docs, labels, bits=bits, max_target_docs=most, target_loss=loss).collect()

    def draw(i):
        first = xxhash.xxh64(i.to_bytes(8, "little"), seed=42).intdigest()
        return signed(xxhash.xxh64((13).to_bytes(4, "little"), seed=first).intdigest())

    def buckets(text):
        h = [word_hash(w) for w in words_of(text)]
        return [x >> (64 - bits) for x in h + [both(a, b) for a, b in zip(h, h[1:], strict=False)]]

    ids = sorted({i for i, q, t in marks if i is not None and q == 1 and t != 1}, key=lambda i: (draw(i), i))[:most]
    counted, apart = {i for i in ids if draw(i) % 5}, {i for i in ids if draw(i) % 5 == 0}
    raw, target = Counter(), Counter()
    for i, text, *_ in rows:
        raw.update(buckets(text))
        if i in counted:
            target.update(buckets(text))
    share = sum(target.values()) / sum(raw.values())
    weight = {b: int(math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)) for b, n in raw.items() for v in [math.log((target[b] + 1) / (n * share + 1)) * unit]}
    mean = lambda text: (lambda b: sum(weight[x] for x in b) // len(b) if b else 0)(buckets(text))
    failed = lambda r: r[0] < 10 or 100 * r[4] > 20 * r[0]
    held = sorted(mean(t) for i, t, *_ in rows if i in apart and not failed(rules(t)))
    least = held[max(0, math.ceil(loss * len(held)) - 1)]
    want = Counter((i, *rules(t), failed(rules(t)), not failed(rules(t)) and mean(t) >= least, mean(t) / unit, least / unit) for i, t, *_ in rows)
    assert Counter(tuple(r) for r in got) == want
    assert len({k for *_, k, _, _ in want}) == 2


def test_op13_filters_and_takes_no_rows_and_no_labels(spark):
    rows, docs, labels, _ = labelled(spark, make_texts())
    kept = op13_quality_rules.keep_good(docs, labels, bits=12)
    verdicts = Counter(r["doc_id"] for r in op13_quality_rules.quality_rules(docs, labels, bits=12).where("kept").collect())
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == verdicts and verdicts
    alone = op13_quality_rules.quality_rules(docs, labels.where("doc_id < 0")).collect()
    assert len(alone) == len(rows) and all(r["kept"] != r["base_failed"] and r["score"] == 0 and r["threshold"] is None for r in alone)
    assert op13_quality_rules.quality_rules(docs.where("doc_id < 0"), labels).count() == 0


def test_op13_keeps_good_texts_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = op13_quality_rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed")
    kept = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg({"kept": "count", "quality": "first"}).withColumnRenamed("count(kept)", "kept").collect()}
    share = {r["quality"]: r["share"] for r in found.selectExpr("quality", "cast(kept as int) as k").groupBy("quality").avg("k").withColumnRenamed("avg(k)", "share").collect()}
    assert kept[1] > 100 and share[1] > 0.9 and share[0] < 0.2


def test_op13_takes_all_of_the_target(spark):
    labels = spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert op13_quality_rules.target_ids(labels).count() == 25_000
    for n, share in ((1, 0.01), (100, 0.01), (777, 0.1), (5000, 0.013)):
        means = spark.range(n).select(((F.col("id") * 7919) % 4001 * 97 - 200_000).alias("mean"))
        want = means.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY mean)")).first()[0]
        assert op13_quality_rules.least_mean(means, share) == want
    assert op13_quality_rules.least_mean(spark.range(0).select(F.col("id").alias("mean")), 0.1) is None


def test_op13_beyond_the_broadcast_bound(spark, monkeypatch):
    _, docs, labels, _ = labelled(spark, make_texts())
    found = sorted(map(str, op13_quality_rules.quality_rules(docs, labels, bits=10).collect()))
    monkeypatch.setattr(op13_quality_rules, "BROADCAST_IDS", 0)
    assert sorted(map(str, op13_quality_rules.quality_rules(docs, labels, bits=10).collect())) == found
