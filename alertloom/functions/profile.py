"""A profile of every column of a table in one scan, and seeded samples of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kept import kept
from .stats import beside, quantiles


def _number(df: DataFrame, c: str) -> Column:
    """Numbers as they are, booleans as 0 and 1, dates and times as seconds since 1970; null for all else."""
    kind, x = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return x.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp")) / 1e6
    return F.lit(None).cast("double")


def profile(df: DataFrame, qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A row a column: n, nulls, distinct, the most frequent value (top_text or top_number, with top_n; of those that tie the smallest), min, quantiles, max.

    The table is scanned once: every row becomes one typed row a column, and those are counted by column and value before they are shuffled. All else
    comes from the counts, which are kept. Nested values are compared as JSON; quantiles and extremes are of numbers and times.
    """
    def text(c: str) -> Column:
        kind, x = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.when(x.isNotNull(), F.to_json(F.struct(x.alias("v"))))
        return x.cast("string") if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(None).cast("string")

    cells = F.array(*(F.struct(F.lit(c).alias("column"), text(c).alias("text"), _number(df, c).alias("number")) for c in df.columns))
    counts = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column", "text", "number").agg(F.count(F.lit(1)).alias("t"))
    counts = kept(counts)
    known = F.col("text").isNotNull() | F.col("number").isNotNull()
    most = F.min_by(F.struct("text", "number", "t"), F.when(known, F.struct(-F.col("t"), "text", "number")))
    found = counts.groupBy("column").agg(F.sum("t").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("t"))), F.lit(0)).alias("nulls"), F.count_if(known).alias("distinct"), most.alias("m"), F.min("number").alias("min"), F.max("number").alias("max"))
    # a value for each count, so that quantiles weigh it
    weighed = _weighted_quantiles(counts.where("number is not null"), qs)
    out = beside(found, weighed, ["column"], "left")
    return out.select("column", "n", "nulls", "distinct", F.col("m.text").alias("top_text"), F.col("m.number").alias("top_number"), F.col("m.t").alias("top_n"), "min", *(F.get("q", k).alias(f"q{round(q * 100):02d}") for k, q in enumerate(qs)), "max")


def _weighted_quantiles(counts: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    return quantiles(counts, ["column"], "number", list(qs), weight="t").drop("n")


def bottom_k(df: DataFrame, k: int, key: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` rows (of each group of ``by``) with the smallest hashes of key and seed: the same rows whatever the partitioning.

    Each task keeps its own ``k`` smallest before anything is shuffled. Rows with equal keys are ordered by their columns; null keys count as empty.
    """
    h = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))
    rows = df.withColumn("_h", h)
    order = ["_h", F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))]
    if not by:
        return rows.orderBy(*order).limit(k).drop("_h")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_h", "_k")
