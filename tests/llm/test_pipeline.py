"""Each stage of the pipeline against brute force on its own input, with planted copies, lines, passages, junk and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import distance, words

import corpus_pipeline
from alertloom.llm import encode, op8_language_id, textscan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed long, class string"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    random.seed(11)
    stems = {"en": ["the", "and", "ing", "with", "er"], "de": ["der", "und", "ung", "ein", "sch"]}

    def word(lang):
        return "".join(random.choices(stems[lang], k=random.randint(1, 3)))

    def prose(lang, n):
        return " ".join(word(lang) + random.choice(["", "", "", ".", ","]) for _ in range(n))

    langs = random.choices(["en", "de"], k=40)
    texts = ["\n".join(prose(lang, random.randint(8, 20)) for _ in range(4)) for lang in langs]
    items = [prose("en", 30) for _ in range(3)]
    more = [texts[0], texts[0], texts[1].replace(texts[1].split(" ")[5], "zzz", 1), texts[2] + " und", items[0], prose("de", 30) + " " + items[1] + " " + prose("de", 20), prose("de", 900) + " " + items[2], "12 34 !!", "", None]
    line = texts[3].split("\n")[1]
    more += [texts[4] + "\n" + line[:-1] + "x", "\n\n" + line + "\n\n", "x" * 4000, texts[5] * 30]
    rows = [(i, t, lang, "s", None if t is None else len(t), 5, "c") for i, (t, lang) in enumerate(zip(texts + more, langs + [None] * len(more), strict=True))]
    rows += [rows[7], rows[7], (None, texts[8], "en", "s", 1, 5, "c"), (None, None, None, None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def language_id(docs, spark, rows, items):
    """Posteriors from the learned table by a plain forward algorithm over each word."""
    languages, table = op8_language_id.learn(docs.where(~op8_language_id.held_out()))
    pieces = op8_language_id._pieces(op8_language_id.default_vocabulary())
    number = {t: k for k, t in enumerate(pieces.texts)}

    def logs_of(text):
        logs, found = np.zeros(len(languages)), re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        for w in found:
            w, sums = b"\x01" + w, [np.zeros(len(languages))]
            for end in range(1, len(w) + 1):
                sums.append(np.logaddexp.reduce([sums[end - k] + np.log(table[number[w[end - k : end]]]) for k in range(1, min(end, pieces.longest) + 1) if w[end - k : end] in number]))
            logs += sums[-1]
        chars = sum(len(w.decode()) + 1 for w in found)
        fit = (logs.max() - sum(len(w) + 1 for w in found) * np.log(op8_language_id.SCALE)) / max(chars, 1)
        return logs, fit

    fits = {}
    for text in {(r["text"], r["lang"]) for r in docs.where(~op8_language_id.held_out()).where("text is not null and lang is not null").collect()}:
        logs, fit = logs_of(text[0])
        if any(c.isalpha() for c in text[0]):
            fits.setdefault(int(logs.argmax()), []).append(fit)
    least = {k: 2 * np.quantile(x, 0.01) - np.median(x) for k, x in fits.items()}
    out = []
    for r in rows:
        logs, fit = logs_of(r["text"])
        if any(c.isalpha() for c in r["text"] or "") and 1 / np.exp(logs - logs.max()).sum() >= 0.5 and fit >= least.get(int(logs.argmax()), -np.inf):
            out.append(tuple(r))
    return out


def line_dedup(docs, spark, rows, items):
    has_word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    order = sorted(range(len(rows)), key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0))
    lines = sorted({x for r in rows for x in (r["text"] or "").split("\n") if has_word.search(x)})
    top = {x: x for x in lines}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if min(len(x), len(y)) >= 24 and abs(len(x) - len(y)) <= 2 and find(x) != find(y) and distance(x, y) <= 2:
                top[find(x)] = find(y)
    seen, done, out = set(), {}, []
    for k in order:
        r = rows[k]
        same = (r["doc_id"], r["text"])
        if r["text"] is not None and same not in done:
            kept = []
            for x in r["text"].split("\n"):
                if not has_word.search(x) or find(x) not in seen:
                    kept.append(x)
                if has_word.search(x):
                    seen.add(find(x))
            done[same] = "\n".join(kept)
        text = done.get(same)
        if text == r["text"]:
            out.append(tuple(r))
        elif has_word.search(text):
            out.append((r["doc_id"], text, r["lang"], r["source"], len(text), *tuple(r)[5:]))
    return out


def jaccard_join(docs, spark, rows, items):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (words(r["text"]) for r in rows)]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k) if sets[k] else ("alone", k)].append(r)
    return [tuple(min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))) for g in groups.values()]


def decontamination(docs, spark, rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 13]) for w in map(split, items) for k in range(len(w) - 12)}
    out = []
    for r in rows:
        w = split(r["text"])
        hit = {k + i for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for i in range(13)}
        if not hit or 20 * len(hit) < len(w):
            out.append(tuple(r))
    return out


def test_stages_and_run(spark, planted):
    folder, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (language_id, line_dedup, jaccard_join, decontamination), strict=False):
        rows = docs.collect()
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        found = got.collect()
        assert Counter(map(tuple, found)) == Counter(brute(docs, spark, rows, items)), name
        docs = spark.createDataFrame(found, SCHEMA).repartition(3)
        sizes.append(len(found))
    assert all(a > b for a, b in zip(sizes[:-1], sizes[1:], strict=True))
    pieces = corpus_pipeline.run(spark, folder).collect()
    ids, bounds = encode.encoder(encode.default_path()).encode(*textscan.text_buffer(pa.array([r["text"] for r in docs.collect()])))
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert sum(p["length"] for p in pieces) == ids.size + docs.count()
    for offsets in [sorted((p["offset"], p["length"]) for p in pieces if p["sequence_id"] == s) for s in {p["sequence_id"] for p in pieces}]:
        assert all(a + n == b for (a, n), (b, _) in zip(offsets[:-1], offsets[1:], strict=True)) and offsets[0][0] == 0 and sum(offsets[-1]) <= 2048


def test_stages_on_empty_tables(spark, planted):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    assert [stage(spark, docs, folder).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
