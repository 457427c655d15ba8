"""Rules for the quality of texts, with DataFrame functions only: counts of each text, and a likelihood ratio against a trusted target.

Words are what ASCII blanks part. Single words and pairs of neighbours are hashed to buckets. Two multinomials over the buckets are counted, one over
the whole table and one over a trusted target; a text's score is the mean over its n-grams of the log of the ratio of the two. Counts of the table are scaled to
the target's size before one is added to every bucket of both, so a bucket that neither knows says nothing. Logs are rounded to multiples of 2**-20
and summed as integers: scores don't depend on the order of sums, and a text gets the same verdict wherever it is.

The target are all documents labelled good and not toxic (with ``max_target_docs``: those with the smallest hashes of their ids). A fifth of
them (by the hash of the id) isn't counted; it sets the threshold: the score that all but ``target_loss`` of them reach. Every document is scored
and held against it. Ids of the target are broadcast up to ``BROADCAST_IDS``, and joined by shuffle beyond. Counting is one aggregation by bucket; for scoring the table of weights is broadcast (at most 2**bits rows, whatever
the corpus), and n-grams are summed where they are, so that only sums are shuffled.

Defined cases: a null text has no words; a text without words scores 0; texts that fail a base rule aren't kept, whatever they score; without a target
all weights are 0 and the base rules alone decide; repeated rows count and are judged each, those of labels count once; rows without doc_id are judged but in no
target; an empty table gives no rows; other columns are ignored by ``quality_rules`` and carried by ``keep_good``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UNIT = 1 << 20
#: Scores are first counted in ranges of so many units.
RANGE = 1 << 12
BROADCAST_IDS = 4_000_000
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _pairs(x: Column, y: Column, apart: int) -> Column:
    """Hashes of x[i] and y[i + apart], for every i with both."""
    n = F.greatest(F.size(y) - apart, F.lit(0))
    return F.zip_with(F.slice(x, 1, n), F.slice(y, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def with_hashes(rows: DataFrame) -> DataFrame:
    """Adds words, h1 and h2 (hashes of each word and of each two neighbours). Each is made once, as each is used more than once."""
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("h2", _pairs(F.col("h1"), F.col("h1"), 1))


def _buckets(bits: int) -> Column:
    return F.transform(F.concat("h1", "h2"), lambda h: F.shiftrightunsigned(h, 64 - bits).cast("int"))


def base_rules(rows: DataFrame) -> DataFrame:
    """``rows`` as ``with_hashes`` makes them, with the columns of RULES as longs."""
    text, words = F.coalesce("text", F.lit("")), F.col("words")
    plain = text
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    rows = rows.withColumn("h4", _pairs(F.col("h2"), F.col("h2"), 2)).withColumn("h5", _pairs(F.col("h4"), F.col("h1"), 4)).withColumn("lines", lines)
    # windows that occur again, found as neighbours in the order of hashes; of two that overlap, the earlier covers words up to the later
    rows = rows.withColumn("order", F.when(F.size(F.array_distinct("h5")) < F.size("h5"), F.array_sort(F.transform("h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    h = lambda k: F.get("order", k)["h"]
    again = F.transform("order", lambda x, k: F.when((h(k - 1) == x["h"]) | (h(k + 1) == x["h"]), x["i"]))
    rows = rows.withColumn("starts", F.array_sort(F.array_compact(again)))
    covered = F.aggregate(F.transform("starts", lambda s, k: F.least(F.coalesce(F.get("starts", k + 1) - s, F.lit(5)), F.lit(5)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    counts = (F.size(words), F.length(F.array_join(words, "")), F.length(text) - F.length(plain), F.size("lines") - F.size(F.array_distinct("lines")), F.coalesce(covered, F.lit(0)))
    return rows.withColumns({name: c.cast("long") for name, c in zip(RULES, counts, strict=True)})


def target_ids(labels: DataFrame, max_target_docs: int | None = None, doc_id: str = "doc_id") -> DataFrame:
    """target_id and counted: labelled 1 for quality and not toxic; a fifth isn't counted. With ``max_target_docs``, the smallest hashes first."""
    good = labels.where((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)) & F.col(doc_id).isNotNull())
    drawn = good.select(F.col(doc_id).alias("target_id")).distinct().withColumn("draw", F.xxhash64("target_id", F.lit(13)))
    if max_target_docs is not None:
        drawn = drawn.orderBy("draw", "target_id").limit(max_target_docs)
    return drawn.select("target_id", (F.pmod("draw", F.lit(5)) != 0).alias("counted"))


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def least_mean(means: DataFrame, share: float) -> int | None:
    """The smallest ``mean`` that at least ``share`` of the rows don't exceed: found in counts of ranges, then in the counts of one range, so that no task or driver holds the rows' values."""
    ranges = means.groupBy(F.floor(F.col("mean") / RANGE).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # logs of ratios: a few thousand ranges
    left = max(1, math.ceil(share * sum(r["n"] for r in ranges)))
    for r in ranges:
        if left <= r["n"]:
            break
        left -= r["n"]
    else:
        return None
    for v in means.where(F.floor(F.col("mean") / RANGE) == r["range"]).groupBy("mean").agg(F.count(F.lit(1)).alias("n")).orderBy("mean").collect():  # up to RANGE values
        if left <= v["n"]:
            return v["mean"]
        left -= v["n"]


def weights(docs: DataFrame, target: DataFrame, bits: int) -> DataFrame:
    """bucket and w, the log of the ratio in units of 2**-20, of every bucket that occurs: at most 2**bits rows."""
    rows = docs.join(_few(target.where("counted")), F.col("doc_id") == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().cast("long").alias("t"))
    grams = with_hashes(rows).select("t", F.explode(_buckets(bits)).alias("bucket"))
    counts = materialize(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")), "buckets")
    total = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    share = (total["t"] or 0) / (total["n"] or 1)
    ratio = F.when(F.lit(share > 0), F.log((F.col("t") + 1) / (F.col("n") * share + 1))).otherwise(0.0)
    return counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("w"))


def quality_rules(docs: DataFrame, labels: DataFrame, bits: int = 18, max_target_docs: int | None = None, target_loss: float = 0.01, min_words: int = 10, most_repeated: int = 20, with_key: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the columns of RULES, base_failed, kept, score (mean log ratio) and threshold: a row for each document; ``with_key`` adds text_key, a hash of the text."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    target = materialize(target_ids(labels, max_target_docs), "target")
    table = materialize(weights(base, target, bits), "weights")
    # a group is one row of the table, or equal rows of one partition: what a task has read of it is one row when it leaves the task
    key = [F.spark_partition_id().alias("part"), "doc_id", F.xxhash64("text").alias("text_key"), *RULES]
    grams = base_rules(with_hashes(base)).select(*key, _buckets(bits).alias("buckets")).select("part", "doc_id", "text_key", *RULES, F.posexplode_outer("buckets").alias("at", "bucket"))
    sums = grams.join(F.broadcast(table), "bucket", "left").groupBy("part", "doc_id", "text_key", *RULES)
    found = sums.agg(F.sum("w").alias("total"), F.count("bucket").alias("grams"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("copies"))
    mean = F.when(F.col("grams") > 0, F.floor(F.col("total") / F.col("grams"))).otherwise(0).cast("long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = materialize(found.select("doc_id", "text_key", *RULES, failed.alias("base_failed"), mean.alias("mean")), "judged")
    kept_out = judged.where("not base_failed").join(_few(target.where("not counted")), F.col("doc_id") == F.col("target_id"), "left_semi")
    least = least_mean(kept_out, target_loss)
    verdict = F.lit(True) if least is None else F.col("mean") >= int(least)
    threshold = F.lit(None if least is None else least / UNIT).cast("double")
    return judged.select("doc_id", *["text_key"] * with_key, *RULES, "base_failed", (~F.col("base_failed") & verdict).alias("kept"), (F.col("mean") / UNIT).alias("score"), threshold.alias("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are kept, with all their columns; rows with equal doc_id and text share their verdict."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    good = quality_rules(base, labels, with_key=True, **options).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    same = F.col(f"__row.`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"__row.`{text}`")) == F.col("__key"))
    return rows.join(good, same, "left_semi").select("__row.*")
