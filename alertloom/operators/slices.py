"""The families that look along an alert's timeline, for alerts whose rows no single task should hold.

A timeline is cut into slices of about ``size`` points, between whole units of time: points are counted by alert and unit, and the running count tells the
slice of each unit. A window then runs within a slice, and what a slice needs from earlier ones is a carry: its last row, its last incoming row, its
number of rows. Carries are one row a slice, and a window over the slices of an alert hands them on. No task orders more than a slice, that is
``size`` points and those of one unit of time.

Rolling counts need no overlap of slices: the transactions in (t - p, t] are those up to t less those up to t - p. For each period every transaction also
stands as a probe at t - p, probes are dealt to slices as transactions are, and both get their place in the one running count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.kept import kept
from ..functions.stats import ranks
from .families import gaps_of, passthrough_of, transitions_of
from .prepare import ORDER

UNIT = 60_000_000
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', tx_ts)"


def with_slices(points: DataFrame, size: int, unit: int = UNIT, us: str = "us") -> DataFrame:
    """Adds slice: from 0, later for later points of an alert. Points in one unit of time are in one slice."""
    at = F.floor(F.col(us) / unit).cast("long")
    points = points.withColumn("_unit", at)
    # units are counted a day (1440 units) at a time first, so that no window holds all units of a long timeline
    units = kept(points.groupBy("alert_id", "_unit").agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", F.floor(F.col("_unit") / 1440)))
    days = units.groupBy("alert_id", "_day").agg(F.sum("_n").alias("_d"))
    before = Window.partitionBy("alert_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("alert_id", "_day", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("alert_id", "_day").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.join(days, ["alert_id", "_day"]).select("alert_id", "_unit", F.floor((F.col("_start") + F.coalesce(F.sum("_n").over(within), F.lit(0))) / size).cast("long").alias("slice"))
    return points.join(units, ["alert_id", "_unit"]).drop("_unit")


def _along(order: list) -> Window:
    return Window.partitionBy("alert_id", "slice").orderBy(*order)


def with_latest(rows: DataFrame, order: list, what: Column, name: str, inclusive: bool) -> DataFrame:
    """Adds ``name``: the last value of ``what`` that isn't null up to each row of its alert (``inclusive``), or before it."""
    w = _along(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    key = F.struct(*order)
    ends = rows.withColumn("_what", what).where("_what is not null").groupBy("alert_id", "slice").agg(F.max_by("_what", key).alias("_end"))
    every = rows.select("alert_id", "slice").distinct().join(ends, ["alert_id", "slice"], "left")
    carry = every.select("alert_id", "slice", F.last("_end", ignorenulls=True).over(Window.partitionBy("alert_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return rows.withColumn(name, F.last(what, ignorenulls=True).over(w)).join(carry, ["alert_id", "slice"], "left").withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def late_places(rows: DataFrame) -> DataFrame:
    """Adds late: the place of each row from the end of its alert, where the last time comes first and ties are as in ORDER."""
    sums = rows.groupBy("alert_id", "slice").agg(F.count(F.lit(1)).alias("_c"))
    after = F.sum("_c").over(Window.partitionBy("alert_id").orderBy("slice").rowsBetween(1, Window.unboundedFollowing))
    own = F.row_number().over(_along([F.desc("tx_ts"), *ORDER[1:]]))
    return rows.withColumn("_own", own).join(sums.select("alert_id", "slice", F.coalesce(after, F.lit(0)).alias("_after")), ["alert_id", "slice"]).withColumn("late", F.col("_own") + F.col("_after")).drop("_own", "_after")


def gaps(history: DataFrame, size: int) -> DataFrame:
    rows = kept(with_slices(history.select("alert_id", *ORDER, F.expr(MICROS).alias("us")), size))
    return gaps_of(with_latest(rows, list(ORDER), F.col("us"), "before", False))


def passthrough(history: DataFrame, config: EngineConfig, size: int) -> DataFrame:
    """Outgoing transactions against the latest incoming one at or before them: both stand in one timeline, incoming ones first where times are equal."""
    rows = history.where("direction in ('in', 'out')").select("alert_id", "tx_ts", "amount", "tx_type", "e", (F.col("direction") == "out").cast("int").alias("late"), F.expr(MICROS).alias("us"))
    rows = kept(with_slices(rows, size))
    came = F.when(F.col("late") == 0, F.struct("tx_ts", "amount", "tx_type"))
    found = with_latest(rows, ["tx_ts", "late", "amount", "tx_type"], came, "_in", True).where("late = 1")
    return passthrough_of(found.select("alert_id", "tx_ts", "amount", "e", "tx_type", *(F.col(f"_in.{c}").alias(f"in_{c}") for c in ("tx_ts", "amount", "tx_type"))), config)


def velocities(rows: DataFrame, config: EngineConfig, size: int) -> DataFrame:
    """alert_id, us and v_<period>: for each time of an alert the number of its transactions in the period up to it."""
    times = kept(rows.groupBy("alert_id", "us").agg(F.count(F.lit(1)).alias("n")))
    shifts = F.array(F.lit(0), *(F.lit(seconds * 1_000_000) for _, seconds in config.velocities))
    points = times.select("alert_id", "us", "n", F.posexplode(shifts).alias("kind", "shift")).select("alert_id", (F.col("us") - F.col("shift")).alias("at"), "us", "kind", F.when(F.col("kind") == 0, F.col("n")).otherwise(0).alias("n"))
    points = kept(with_slices(points, size, us="at"))
    sums = points.groupBy("alert_id", "slice").agg(F.sum("n").alias("_c"))
    sums = sums.select("alert_id", "slice", F.coalesce(F.sum("_c").over(Window.partitionBy("alert_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    # transactions before probes where times are equal, as the frame is open at its start
    upto = F.sum("n").over(_along(["at", "kind", "us"]).rowsBetween(Window.unboundedPreceding, 0))
    placed = points.withColumn("upto", upto).join(sums, ["alert_id", "slice"]).withColumn("upto", F.col("upto") + F.col("_start"))
    own = F.max(F.when(F.col("kind") == 0, F.col("upto")))
    return placed.groupBy("alert_id", "us").agg(*((own - F.max(F.when(F.col("kind") == k, F.col("upto")))).alias(f"v_{name}") for k, (name, _) in enumerate(config.velocities, 1)))


def transitions(history: DataFrame, config: EngineConfig, size: int) -> DataFrame:
    rows = kept(with_slices(history.select("alert_id", *ORDER, "is_in", F.expr(MICROS).alias("us")), size))
    both = with_latest(late_places(rows), list(ORDER), F.struct("is_in", "tx_type", "amount"), "_p", False)
    both = both.withColumns({"p_in": F.col("_p.is_in"), "p_type": F.col("_p.tx_type"), "delta": F.col("amount") - F.col("_p.amount")})
    ranked = ranks(both, ["alert_id"], "amount", "avg_rank", "_whole")
    return transitions_of(ranked.join(velocities(rows, config, size), ["alert_id", "us"]), config)
