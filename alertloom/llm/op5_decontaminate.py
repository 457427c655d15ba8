"""Benchmark decontamination with DataFrame functions only.

Words are normalised (A-Z lower-cased; runs of digits, letters a-z and characters from U+0080 on). A window is 13 consecutive words of an
item, or the whole item if it has fewer. The set of distinct windows is hashed and joined with every window of the training texts; each
hit is verified word by word. The set is broadcast behind a check of its size, and shuffled beyond it.

Defined cases: a null or empty text has no words and no hits; an item without words is no window; hits on items without item_id count as
hits, but name no item; rows with equal doc_id and text get equal results, each its own row; an empty benchmark hits nothing; extra columns
are carried by the filters and ignored by the digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BROADCAST_BYTES = 64 << 20


def folded(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(folded(text), BETWEEN), ""), F.array().cast("array<string>"))


def _windows(benchmark: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """item_id, size, window: each window of each item once, its words joined by blanks."""
    words = F.col("words")
    many = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    return items.select("item_id", F.least(F.size(words), F.lit(n)).alias("size"), F.explode(F.when(F.size(words) >= n, many).otherwise(F.array(F.array_join(words, " ")))).alias("window")).distinct()


def _hash(words: Column, size: int, at: Column | int = 0) -> Column:
    return F.xxhash64(*(F.get(words, at + k if isinstance(at, int) else at + F.lit(k)) for k in range(size)))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), words_of(F.col(text)).alias("words"))


def find_hits(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, at, size, window: each place of a document where a window occurs."""
    sizes = windows.agg(F.collect_set("size").alias("sizes"), F.sum(F.length("window") + 24).alias("bytes")).first()
    rows, parts = _identified(docs, doc_id, text), []
    for size in sorted(sizes["sizes"]):
        distinct = windows.where(F.col("size") == size).select("window").distinct()
        keyed = distinct.select("window", _hash(F.split("window", " "), size).alias("key"))
        places = rows.where(F.size("words") >= size).select("doc_id", "text_key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
        places = places.withColumn("key", _hash(F.col("words"), size, F.col("at")))
        if sizes["bytes"] <= BROADCAST_BYTES:
            hits = places.join(F.broadcast(keyed), "key")
        else:
            # places travel without words; a document's hits come back to its words together, once for rows that are repeated
            found = places.select("doc_id", "text_key", "at", "key").join(keyed, "key").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "window")).alias("found"))
            found = found.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
            back = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")))
            hits = back.select("doc_id", "text_key", "words", F.explode("found").alias("hit")).select("doc_id", "text_key", "words", "hit.*")
        hits = hits.where(F.array_join(F.slice("words", F.col("at") + 1, size), " ") == F.col("window"))
        parts.append(hits.select("doc_id", "text_key", "at", F.lit(size).alias("size"), "window"))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text_key long, at int, size int, window string")
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, hit (sorted positions of hit words), for each document."""
    windows = _windows(benchmark, n, item_id, item_text)
    hits = materialize(find_hits(docs, windows, doc_id, text), "hits")
    places = hits.select("doc_id", "text_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at")).distinct()
    places = places.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"), F.sort_array(F.collect_list("at")).alias("hit"))
    items = hits.select("doc_id", "text_key", "window").distinct().join(windows.where(F.col("item_id").isNotNull()), "window").select("doc_id", "text_key", "item_id").distinct()
    items = items.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
    base = _identified(docs, doc_id, text).select("doc_id", "text_key", F.size("words").cast("long").alias("n_words")).alias("d")
    for name, found in (("p", places), ("i", items)):
        base = base.join(found.withColumnsRenamed({"doc_id": f"{name}_id", "text_key": f"{name}_key"}), F.col("d.doc_id").eqNullSafe(F.col(f"{name}_id")) & (F.col("d.text_key") == F.col(f"{name}_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return base.select(F.col("d.doc_id").alias("doc_id"), F.col("d.text_key").alias("text_key"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("hit", F.array().cast("array<int>")).alias("hit"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, spans: bool = False, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns; with ``spans``, all documents, without the hit words of contaminated ones."""
    found = contamination(docs, benchmark, doc_id=doc_id, text=text, **options).where("contaminated")
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("hit").alias("__hit")).dropDuplicates(["__id", "__key"])
    same = F.col(f"__row.`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"__row.`{text}`")) == F.col("__key"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    if not spans:
        return rows.join(found, same, "left_anti").select("__row.*")
    column = F.col(f"__row.`{text}`")
    word = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    parts = F.regexp_extract_all(column, F.lit(f"{OTHER}*{word}"), F.lit(0))
    left = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.array_contains(F.col("__hit"), x["i"]))
    clean = F.concat(F.array_join(F.transform(left, lambda x: x["p"]), ""), F.regexp_extract(column, f"({OTHER}*)$", 1))
    return rows.join(found, same, "left").select(*(F.when(F.col("__hit").isNull(), column).otherwise(clean).alias(c) if c == text else F.col(f"__row.`{c}`") for c in docs.columns))
