"""Statistics fitted on one split and reused unchanged on others: amount thresholds, bin edges, weekly baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantiles


def global_thresholds(history: DataFrame) -> DataFrame:
    found = quantiles(history, [], "amount", [0.1, 0.9, 0.99])
    return found.select(F.get("q", 0).alias("p10"), F.get("q", 1).alias("p90"), F.get("q", 2).alias("p99"))


def type_edges(history: DataFrame) -> DataFrame:
    """tx_type, edges: its seven octiles."""
    return quantiles(history, ["tx_type"], "amount", [i / 8 for i in range(1, 8)], "edges").drop("n")


def weekly_baseline(prepared: DataFrame) -> DataFrame:
    """wk, tx_type, base: median amount. It takes prepared rows, so nothing after an alert is fitted."""
    rows = prepared.select(F.date_trunc("WEEK", "tx_ts").alias("wk"), "tx_type", "amount")
    return quantiles(rows, ["wk", "tx_type"], "amount", [0.5]).select("wk", "tx_type", F.get("q", 0).alias("base"))
