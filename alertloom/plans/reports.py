"""Reports over results: periods, families of features, ablation, differences of tables, strict codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rate_band
from ..operators.prepare import ratio


def recode(column: str, codes: dict[str, int]) -> Column:
    """The code of a text; null stays null, a text without a code is an error."""
    known = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    code = known[F.col(column)]
    return F.when(F.col(column).isNull() | code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit(f"no code in {column} for "), F.col(column))).cast("int"))


def matching_columns(df: DataFrame, include: str = ".", exclude: str | None = None) -> list[str]:
    import re

    return [c for c in df.columns if re.search(include, c) and not (exclude and re.search(exclude, c))]


def period_rate(df: DataFrame, ts: str, label: str, period: str = "month") -> DataFrame:
    """Rate and count of a 0/1 label by calendar week (from Monday), month or quarter, with a band of 1.96 standard errors."""
    return rate_band(df.withColumn("period", F.date_trunc(period, F.col(ts)).cast("date")), "period", label)


def importance_rollup(importance: DataFrame, feature: str, gain: str, families: dict[str, str]) -> DataFrame:
    """family, built, used (gain above 0), share of all gain. The first pattern that a name matches is its family, else ``other``; null gain is 0."""
    family = F.coalesce(*(F.when(F.col(feature).rlike(pattern), F.lit(name)) for name, pattern in families.items()), F.lit("other"))
    rows = importance.select(family.alias("family"), F.coalesce(F.col(gain).cast("double"), F.lit(0.0)).alias("gain"))
    out = rows.groupBy("family").agg(F.count(F.lit(1)).alias("built"), F.count_if(F.col("gain") > 0).alias("used"), F.sum("gain").alias("gain"))
    return out.select("family", "built", "used", ratio(F.col("gain"), F.sum("gain").over(Window.partitionBy(F.lit(1)))).alias("share"))  # a row a family


def top_share(importance: DataFrame, feature: str, gain: str, tops: tuple[int, ...] = (20, 100)) -> DataFrame:
    """top, share: what part of all gain the largest ones have; ties by name."""
    whole = importance.agg(F.sum(F.col(gain).cast("double")).alias("whole"))
    parts = [importance.orderBy(F.desc_nulls_last(gain), feature).limit(n).agg(F.lit(n).alias("top"), F.sum(F.col(gain).cast("double")).alias("part")) for n in tops]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.crossJoin(whole).select("top", ratio(F.col("part"), F.col("whole")).alias("share"))  # one row each


def ablation(ledger: DataFrame, base: str, name: str = "name", value: str = "auc", order: str = "ts") -> DataFrame:
    """name, value, delta: each name's last value against the last of ``base``."""
    last = ledger.groupBy(F.col(name).alias("name")).agg(F.max_by(value, order).alias("value"))
    return last.crossJoin(last.where(F.col("name") == base).select(F.col("value").alias("base"))).select("name", "value", (F.col("value") - F.col("base")).alias("delta"))


def largest_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, difference (largest absolute, over keys of both), one_null (rows where one side is null), unmatched keys."""
    left = a.select(F.col(key).alias("_k"), F.lit(1).alias("_l"), *(F.col(c).cast("double").alias(f"l_{i}") for i, c in enumerate(columns)))
    right = b.select(F.col(key).alias("_k"), F.lit(1).alias("_r"), *(F.col(c).cast("double").alias(f"r_{i}") for i, c in enumerate(columns)))
    both = left.join(right, "_k", "full")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    facts = both.agg(F.count_if(lone).alias("unmatched"), *(x for i, _ in enumerate(columns) for x in (F.max(F.abs(F.col(f"l_{i}") - F.col(f"r_{i}"))).alias(f"d_{i}"), F.count_if(~lone & (F.col(f"l_{i}").isNull() != F.col(f"r_{i}").isNull())).alias(f"n_{i}"))))
    return facts.select("unmatched", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"d_{i}").alias("difference"), F.col(f"n_{i}").alias("one_null")) for i, c in enumerate(columns)))).alias("c")).select("c.*", "unmatched")


def unseen_categories(train: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: values of ``other`` that ``train`` doesn't have, and their rows."""
    def pairs(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*").where("value is not null")

    return pairs(other).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).join(pairs(train).distinct(), ["column", "value"], "left_anti")


def top_n(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The rows with the largest values, ties by the smaller key."""
    return df.orderBy(F.desc_nulls_last(by), key).limit(n)


def oof_mean(oof: DataFrame, key: str, label: str = "label") -> DataFrame:
    """key, label, oof: the mean over repeats."""
    return oof.groupBy(key).agg(F.max(label).alias(label), F.avg("oof").alias("oof"))
