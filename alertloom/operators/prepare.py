"""Transactions of each alert's past, with the columns that the feature families share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig

#: A total order of the transactions of an alert.
ORDER = ("tx_ts", "direction", "tx_type", "amount")


def prepare(tx: DataFrame, alerts: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Only transactions a whole second or more before the alert. With a ``baseline`` (wk, tx_type, base), amounts are net of it."""
    seconds = F.expr("timestampdiff(SECOND, tx_ts, alert_date)")
    rows = tx.join(alerts.select("alert_id", "alert_date"), "alert_id").where(F.col("tx_ts") < F.col("alert_date")).withColumn("seconds", seconds).where("seconds > 0")
    if baseline is not None:
        rows = rows.withColumn("wk", F.date_trunc("WEEK", "tx_ts")).join(baseline, ["wk", "tx_type"], "left").withColumn("amount", F.col("amount") - F.coalesce("base", F.lit(0.0))).drop("wk", "base")
    return derived(rows)


def derived(rows: DataFrame) -> DataFrame:
    """The columns that follow from seconds, direction, amount and tx_ts."""
    is_in = (F.col("direction") == "in").cast("int")
    return rows.withColumns({"age": F.col("seconds") / F.lit(86400.0), "e": F.exp("amount"), "is_in": is_in, "hour": F.hour("tx_ts"), "wday": F.weekday("tx_ts")}).withColumns({"day": F.floor("age").cast("int"), "flow": F.col("e") * (2 * F.col("is_in") - 1)})


def split_burst(prepared: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(history, burst): what lies before the last ``burst_seconds``, and what in them."""
    inside = F.col("seconds") <= config.burst_seconds
    return prepared.where(~inside), prepared.where(inside)


def per_alert(descending: bool = False) -> Window:
    first = F.desc("tx_ts") if descending else F.asc("tx_ts")
    return Window.partitionBy("alert_id").orderBy(first, *ORDER[1:])


def order_key() -> Column:
    return F.struct(*ORDER)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_sql(a: str, b: str) -> str:
    return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def sum_where(cond: Column, x: Column | str) -> Column:
    """0 where nothing is summed."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))


def share_where(cond: Column) -> Column:
    """Mean of a condition; unknown ones don't count."""
    return F.avg(cond.cast("double"))


def amount_block(prefix: str, cond: Column) -> dict[str, Column]:
    x = F.when(cond, F.col("amount"))
    return {f"{prefix}_n": count_where(cond), f"{prefix}_sum": sum_where(cond, "amount"), f"{prefix}_mean": F.avg(x), f"{prefix}_std": F.stddev_samp(x), f"{prefix}_max": F.max(x), f"{prefix}_min": F.min(x), f"{prefix}_med": F.median(x)}


def grouped(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.groupBy("alert_id").agg(*(c.alias(n) for n, c in columns.items()))


def is_count(name: str) -> bool:
    """Counts are 0 where nothing was counted."""
    return name.endswith("_n") or name in ("n_tx", "active_days")


def zero_fill(features: DataFrame) -> DataFrame:
    return features.fillna(0, [c for c in features.columns if is_count(c)])
