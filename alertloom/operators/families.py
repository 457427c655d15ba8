"""Feature families: DataFrames with one row an alert, from its history or its burst."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise, permutations
from math import log
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from .prepare import ORDER, amount_block, count_where, grouped, order_key, per_alert, ratio, ratio_sql, share_where, sum_where

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _days(cond: Column) -> Column:
    return F.size(F.collect_set(F.when(cond, F.col("day")))).cast("long")


def _whole_seconds(us: Column) -> Column:
    return F.floor(us / F.lit(1e6))


def _type(t: str) -> Column:
    return F.col("tx_type") == t


def _dir(d: str) -> Column:
    return F.col("direction") == d


def with_sql(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *(f"{x} AS `{n}`" for n, x in columns.items()))


def aggregates(history: DataFrame, thresholds: DataFrame, config: EngineConfig) -> DataFrame:
    """Counts, moments, quantiles, by direction, by type and by both, and what follows from them."""
    h = history.crossJoin(F.broadcast(thresholds))  # thresholds: one row
    x = F.col("amount")
    base = {"n_tx": F.count(F.lit(1)), "active_days": _days(F.lit(True)), "first_age": F.max("age"), "last_age": F.min("age"), "amt_mean": F.avg(x), "amt_std": F.stddev_samp(x), "amt_min": F.min(x), "amt_max": F.max(x), "amt_skew": F.skewness(x), "amt_kurt": F.kurtosis(x), "amtx_sum": F.sum("e"), "amtx_mean": F.avg("e"), "net_flow": F.sum("flow"), "share_gt_p90": share_where(x > F.col("p90")), "share_gt_p99": share_where(x > F.col("p99")), "n_gt_p99": count_where(x > F.col("p99")), "share_lt_p10": share_where(x < F.col("p10")), "in_share": F.avg("is_in"), "_q": F.percentile(x, F.array(*map(F.lit, QUANTILES)))}
    for d in config.directions:
        base |= amount_block(d, _dir(d)) | {f"{d}_amtx_sum": sum_where(_dir(d), "e"), f"{d}_amtx_max": F.max(F.when(_dir(d), F.col("e")))}
    for t in config.types:
        base |= amount_block(t, _type(t)) | {f"{t}_amtx_sum": sum_where(_type(t), "e"), f"{t}_share": share_where(_type(t)), f"{t}_days": _days(_type(t)), f"{t}_last_age": F.min(F.when(_type(t), F.col("age")))}
        for d in config.directions:
            both = _type(t) & _dir(d)
            base |= {f"{t}_{d}_n": count_where(both), f"{t}_{d}_amtx_sum": sum_where(both, "e"), f"{t}_{d}_mean": F.avg(F.when(both, x)), f"{t}_{d}_max": F.max(F.when(both, x))}
    out = grouped(h, base).withColumns({f"amt_q{round(q * 100):02d}": F.get("_q", k) for k, q in enumerate(QUANTILES)}).drop("_q")
    return with_sql(out, aggregates_derived(config))


def aggregates_derived(config: EngineConfig) -> dict[str, str]:
    """What follows from the columns of ``aggregates``, as SQL."""
    shares = [f"`{t}_share`" for t in config.types]
    return {
        "span_days": "first_age - last_age",
        "tx_per_active_day": ratio_sql("n_tx", "active_days"),
        "active_day_ratio": ratio_sql("active_days", "ceil(first_age)"),
        "amt_max_minus_med": "amt_max - amt_q50",
        "in_out_n_ratio": ratio_sql("in_n", "out_n + 1"),
        "in_out_amtx_ratio": ratio_sql("in_amtx_sum", "out_amtx_sum + 1e-3D"),
        "out_in_amtx_ratio": ratio_sql("out_amtx_sum", "in_amtx_sum + 1e-3D"),
        "max_in_minus_max_out": "in_max - out_max",
        "net_flow_norm": ratio_sql("net_flow", "amtx_sum + 1e-3D"),
        "cash_intl_share": f"`{config.cash}_share` + `{config.intl}_share`",
        "type_entropy": " + ".join(f"if({s} > 0, -{s} * ln({s}), 0D)" for s in shares),
        "type_nunique": " + ".join(f"CAST({s} > 0 AS BIGINT)" for s in shares),
    }


def amount_histogram(history: DataFrame, edges: DataFrame, config: EngineConfig) -> DataFrame:
    """Counts in right-closed bins of each type's octiles, for all and by direction, and their shares of the type's total."""
    # by alert at once: where alerts have few rows, counts are nearly as many as rows
    rows = history.select("alert_id", "tx_type", "direction", "amount").repartition("alert_id").join(F.broadcast(edges), "tx_type")  # edges: one row a type
    found = F.array_position(F.transform("edges", lambda edge: F.col("amount") <= edge), F.lit(True))
    counted = rows.withColumn("bin", F.when(found > 0, found - 1).otherwise(7)).groupBy("alert_id", "tx_type", "direction", "bin").agg(F.count(F.lit(1)).alias("n"))
    # a slot for each type, each of all and the directions, and each bin
    ways = len(config.directions) + 1
    kind, way = (F.array_position(F.array(*map(F.lit, names)), F.col(c)) for names, c in ((config.types, "tx_type"), (config.directions, "direction")))
    both = F.filter(F.array(F.lit(0).cast("long"), way), lambda d, i: (i == 0) | (d > 0))
    slots = counted.select("alert_id", "n", (kind - 1).alias("t"), "bin", F.explode(both).alias("d")).where("d is not null")
    slots = slots.groupBy("alert_id", F.when(F.col("t") >= 0, ((F.col("t") * ways + F.col("d")) * 8 + F.col("bin")).cast("int")).alias("slot")).agg(F.sum("n").alias("n"))
    by = slots.groupBy("alert_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n")))).alias("by"))
    last = len(config.types) * ways * 8 - 1
    dense = by.select("alert_id", F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0))).alias("h"))
    totals = [f"aggregate(slice(h, {k * ways * 8 + 1}, 8), 0L, (a, b) -> a + b) AS _{k}" for k in range(len(config.types))]
    place = {f"{t}_{f'{d}_' if d else ''}bin{i}": (k, (k * ways + j) * 8 + i) for k, t in enumerate(config.types) for j, d in enumerate((None, *config.directions)) for i in range(8)}
    return dense.selectExpr("alert_id", "h", *totals).selectExpr("alert_id", *(f"h[{at}] AS `{n}_n`" for n, (_, at) in place.items()), *(f"{ratio_sql(f'h[{at}]', f'_{k}')} AS `{n}_frac`" for n, (k, at) in place.items()))


def burst(rows: DataFrame, config: EngineConfig) -> DataFrame:
    x = F.col("amount")
    out = {"b_n": F.count(F.lit(1)), "b_amt_mean": F.avg(x), "b_amt_std": F.stddev_samp(x), "b_amt_max": F.max(x), "b_amt_min": F.min(x), "b_amt_med": F.median(x), "b_amtx_sum": F.sum("e"), "b_net_flow": F.sum("flow"), "b_in_share": F.avg("is_in")}
    for t in config.types:
        out |= {f"b_{t}_n": count_where(_type(t)), f"b_{t}_mean": F.avg(F.when(_type(t), x)), f"b_{t}_max": F.max(F.when(_type(t), x))}
        for d in config.directions:
            both = _type(t) & _dir(d)
            out |= {f"b_{t}_{d}_n": count_where(both), f"b_{t}_{d}_mean": F.avg(F.when(both, x))}
    return grouped(rows, out)


def burst_relative(config: EngineConfig, c=F.col) -> dict[str, Column]:
    """Columns over a join of aggregates and burst, whose columns ``c`` gives; they are taken before counts are filled."""
    out = {"br_amt_mean_diff": c("b_amt_mean") - c("amt_mean"), "br_amt_max_diff": c("b_amt_max") - c("amt_max"), "br_amt_mean_z": ratio(c("b_amt_mean") - c("amt_mean"), c("amt_std") + 1e-3), "br_n_vs_daily_rate": ratio(c("b_n"), ratio(c("n_tx"), F.ceil(c("first_age"))) + 1e-3), "br_n_vs_hist_n": ratio(c("b_n"), c("n_tx") + 1), "br_in_share_diff": c("b_in_share") - c("in_share")}
    for t in config.types:
        out |= {f"br_{t}_share_diff": ratio(c(f"b_{t}_n"), c("b_n") + 1e-9) - c(f"{t}_share"), f"br_{t}_mean_diff": c(f"b_{t}_mean") - c(f"{t}_mean")}
    return out


def windows(history: DataFrame, config: EngineConfig) -> DataFrame:
    """Recent windows, each with the one before it, their ratios and the acceleration between windows."""
    age, base = F.col("age"), {"_n": F.count(F.lit(1)), "_e": F.sum("e"), "_age": F.max("age")}
    for w in config.windows:
        now, before, p = age <= w, (age > w) & (age <= 2 * w), f"w{w}"
        x = F.when(now, F.col("amount"))
        base |= {f"{p}_n": count_where(now), f"{p}_prev_n": count_where(before), f"{p}_amtx_sum": sum_where(now, "e"), f"{p}_prev_amtx_sum": sum_where(before, "e"), f"{p}_amt_mean": F.avg(x), f"{p}_amt_max": F.max(x), f"{p}_net_flow": sum_where(now, "flow"), f"{p}_in_share": F.avg(F.when(now, F.col("is_in"))), f"{p}_out_n": count_where(now & _dir("out")), f"{p}_out_amtx_sum": sum_where(now & _dir("out"), "e"), f"{p}_active_days": _days(now)}
        base |= {f"{p}_{t}_n": count_where(now & _type(t)) for t in config.types}
    return with_sql(grouped(history, base), windows_derived(config)).drop("_n", "_e", "_age")


def windows_derived(config: EngineConfig) -> dict[str, str]:
    """What follows from the columns of ``windows``, as SQL; _n, _e and _age are those of the whole history."""
    more = {}
    for w in config.windows:
        p, whole = f"w{w}", "ceil(_age)"
        more |= {f"{p}_vs_prev_n": ratio_sql(f"{p}_n", f"{p}_prev_n + 1"), f"{p}_vs_prev_amtx": ratio_sql(f"{p}_amtx_sum", f"{p}_prev_amtx_sum + 1"), f"{p}_rate_vs_hist": ratio_sql(f"{p}_n / {w}D", ratio_sql("_n", whole)), f"{p}_amtx_rate_vs_hist": ratio_sql(f"{p}_amtx_sum / {w}D", ratio_sql("_e", whole)), f"{p}_share_n": ratio_sql(f"{p}_n", "_n"), f"{p}_out_frac": ratio_sql(f"{p}_out_n", f"{p}_n + 1"), f"{p}_cash_frac": ratio_sql(f"`{p}_{config.cash}_n`", f"{p}_n + 1"), f"{p}_intl_frac": ratio_sql(f"`{p}_{config.intl}_n`", f"{p}_n + 1")}
    for a, b in pairwise(config.windows):
        more[f"accel_{a}_{b}"] = ratio_sql(f"w{a}_n / {a}D", f"w{b}_n / {b}D + 1e-3D")
    return more


def shift(history: DataFrame, config: EngineConfig) -> DataFrame:
    """The last days less what was before them."""
    x, out = F.col("amount"), {}
    for w in config.shift_windows:
        now, old = F.col("age") <= w, F.col("age") > w
        change = lambda f, v, now=now, old=old: f(F.when(now, v)) - f(F.when(old, v))
        out |= {f"sh{w}_amt_mean": change(F.avg, x), f"sh{w}_amt_std": change(F.stddev_samp, x), f"sh{w}_in_share": change(F.avg, F.col("is_in"))}
        for t in config.shift_types:
            out |= {f"sh{w}_{t}_amt_mean": change(F.avg, F.when(_type(t), x)), f"sh{w}_{t}_share": change(F.avg, _type(t).cast("double"))}
    return grouped(history, out)


def activity(history: DataFrame, config: EngineConfig) -> DataFrame:
    """Shares of hours and weekdays, decayed sums, and slopes of daily counts and amounts with empty days included."""
    hour, e = F.col("hour"), F.col("e")
    out = {"night_share": share_where(hour < 6), "weekend_share": share_where(F.col("wday") >= 5), "hour_mean": F.avg(hour), "hour_std": F.stddev_samp(hour), "night_amtx_sum": sum_where(hour < 6, "e"), "night_out_n": count_where((hour < 6) & _dir("out")), "round_minute_share": share_where(F.minute("tx_ts") == 0)}
    out |= {f"hour_{a}_{b}_share": share_where((hour >= a) & (hour < b)) for a, b in pairwise(config.hour_bins)}
    out |= {f"wday{k}_share": share_where(F.col("wday") == k) for k in range(7)}
    for life in config.half_lives:
        weight = F.exp(-F.col("age") * F.lit(log(2) / life))
        out |= {f"ewm{life}_n": F.sum(weight), f"ewm{life}_amtx": F.sum(weight * e), f"ewm{life}_flow": F.sum(weight * F.col("flow"))}
    for w in config.trends:
        inside, x = F.col("day") < w, F.lit(float(w - 1)) - F.col("day")
        for name, y in (("n", F.lit(1.0)), ("amtx", e)):
            out[f"trend{w}_{name}"] = (sum_where(inside, x * y) / F.lit(float(w)) - F.lit((w - 1) / 2) * sum_where(inside, y) / F.lit(float(w))) / F.lit((w * w - 1) / 12)
    return grouped(history, out)


def gaps(history: DataFrame) -> DataFrame:
    """Hours between consecutive transactions in whole seconds, and what follows the longest wait."""
    w = per_alert()
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', tx_ts)")
    rows = history.select("alert_id", "tx_ts", us.alias("us"), *ORDER[1:])
    return gaps_of(rows.withColumn("before", F.lag("us").over(w)))


def gaps_of(rows: DataFrame) -> DataFrame:
    """``rows``: alert_id, us (microseconds) and before (those of the transaction before)."""
    rows = rows.withColumn("gap", _whole_seconds(F.col("us") - F.col("before")) / F.lit(3600.0))
    g = F.col("gap")
    log_gap = F.log1p(g)
    out = {"gap_mean": F.avg(g), "gap_std": F.stddev_samp(g), "gap_med": F.median(g), "gap_min": F.min(g), "gap_max": F.max(g), "gap_q10": F.percentile(g, F.lit(0.1)), "gap_q90": F.percentile(g, F.lit(0.9)), "gap_lt1h_share": share_where(g < 1), "gap_lt5m_share": share_where(g < 1 / 12), "gap_gt7d_n": count_where(g > 168), "gap_logmean": F.avg(log_gap), "gap_logstd": F.stddev_samp(log_gap)}
    longest = F.max_by("us", F.struct(F.coalesce(g, F.lit(0.0)), F.col("us")))
    out |= {"days_active_after_max_gap": _whole_seconds(F.max("us") - longest) / F.lit(86400.0), "dormant_reactivated_30d": (F.max(F.coalesce(g, F.lit(0.0))) > 720).cast("long")}
    return grouped(rows, out).withColumn("gap_cv", ratio(F.col("gap_std"), F.col("gap_mean")))


def daily(history: DataFrame) -> DataFrame:
    """The distribution of daily counts over the whole span, days without transactions included."""
    days = history.groupBy("alert_id", "day").agg(F.count(F.lit(1)).alias("c"), F.sum("e").alias("e"))
    out = grouped(days, {"daily_n_max": F.max("c"), "daily_amtx_max": F.max("e"), "busiest_day_age": F.max_by("day", F.struct("c", "day")), "_h": F.max("day") + 1, "_c": F.sum("c"), "_cc": F.sum(F.col("c") * F.col("c")), "_e": F.sum("e")})
    out = out.withColumn("daily_n_mean", ratio(F.col("_c"), F.col("_h"))).withColumn("daily_n_std", F.sqrt(F.greatest(ratio(F.col("_cc"), F.col("_h")) - F.pow("daily_n_mean", F.lit(2)), F.lit(0.0))))
    return out.withColumns({"burst_z": (F.col("daily_n_max") - F.col("daily_n_mean")) / (F.col("daily_n_std") + 1e-6), "burst_amtx_ratio": F.col("daily_amtx_max") / (ratio(F.col("_e"), F.col("_h")) + 1e-6)}).drop("_h", "_c", "_cc", "_e")


def asof_backward(left: DataFrame, right: DataFrame, by: str, on: str, carried: list[str]) -> DataFrame:
    """Each left row with the ``carried`` columns of the latest right row of its ``by`` at or before it: one union and one window, no join."""
    both = left.withColumn("_right", F.lit(None).cast(right.select(F.struct(on, *carried).alias("r")).schema["r"].dataType)).withColumn("_late", F.lit(1))
    other = right.select(*(F.col(c) if c in (by, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.struct(on, *carried).alias("_right"), F.lit(0).alias("_late"), *(F.col(c).alias(f"_tie_{c}") for c in carried))
    ties = [f"_tie_{c}" for c in carried]
    both = both.withColumns({f"_tie_{c}": F.lit(None).cast(right.schema[c].dataType) for c in carried}).unionByName(other)
    w = Window.partitionBy(by).orderBy(on, "_late", *ties).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_late = 1")
    return found.select(*left.columns, F.col(f"_right.{on}").alias(f"in_{on}"), *(F.col(f"_right.{c}").alias(f"in_{c}") for c in carried))


def passthrough(history: DataFrame, config: EngineConfig) -> DataFrame:
    """Outgoing transactions against the latest incoming one at or before them; lags in whole seconds."""
    moved = asof_backward(history.where(_dir("out")).select("alert_id", "tx_ts", "amount", "e", "tx_type"), history.where(_dir("in")).select("alert_id", "tx_ts", "amount", "tx_type"), "alert_id", "tx_ts", ["amount", "tx_type"])
    return passthrough_of(moved, config)


def passthrough_of(moved: DataFrame, config: EngineConfig) -> DataFrame:
    """``moved``: outgoing transactions with in_tx_ts, in_amount and in_tx_type of the incoming one."""
    rows = moved.withColumn("lag", F.expr("timestampdiff(SECOND, in_tx_ts, tx_ts)") / F.lit(3600.0)).withColumn("delta", F.abs(F.col("amount") - F.col("in_amount")))
    lag, near = F.col("lag"), F.col("lag") < 24
    alike = F.col("delta") < 0.25
    out = {"pt_out_n": F.count(F.lit(1)), "pt_lag_med": F.median(lag), "pt_lag_mean": F.avg(lag), "pt_lag_min": F.min(lag), "pt_1h_n": count_where(lag < 1), "pt_24h_n": count_where(near), "pt_24h_similar_n": count_where(near & alike), "pt_72h_similar_n": count_where((lag < 72) & alike), "pt_24h_large_n": count_where(near & (F.col("amount") > 1)), "pt_24h_amtdiff_mean": F.avg(F.when(near, F.col("delta"))), "pt_24h_out_amtx": sum_where(near, "e"), "pt_24h_from_intl_n": count_where(near & (F.col("in_tx_type") == config.intl)), "pt_24h_to_cash_intl_n": count_where(near & F.col("tx_type").isin(config.cash, config.intl))}
    return grouped(rows, out).withColumns({"pt_24h_frac": ratio(F.col("pt_24h_n"), F.col("pt_out_n")), "pt_24h_similar_frac": ratio(F.col("pt_24h_similar_n"), F.col("pt_out_n"))})


def last_k(history: DataFrame, config: EngineConfig) -> DataFrame:
    """The k most recent transactions side by side; missing ranks are null, an unknown type is an error."""
    code = F.create_map(*(v for k, t in enumerate(config.types) for v in (F.lit(t), F.lit(k))))[F.col("tx_type")]
    code = F.when(code.isNull(), F.raise_error(F.concat(F.lit("unknown type "), F.col("tx_type")))).otherwise(code).cast("int")
    rows = history.select("alert_id", *ORDER, "age", "is_in").withColumn("rk", F.row_number().over(per_alert(True)) - 1).where(F.col("rk") < config.last_k).withColumn("code", code)
    out = {}
    for i in range(config.last_k):
        for name, column in (("amt", "amount"), ("age", "age"), ("in", "is_in"), ("type", "code")):
            out[f"last{i}_{name}"] = F.max(F.when(F.col("rk") == i, F.col(column)))
    k, intl = f"last{config.last_k}", [config.types.index(config.cash), config.types.index(config.intl)]
    out |= {f"{k}_amt_mean": F.avg("amount"), f"{k}_amt_max": F.max("amount"), f"{k}_in_share": F.avg("is_in"), f"{k}_span_days": F.max("age"), f"{k}_cash_intl_share": share_where(F.col("code").isin(intl))}
    return grouped(rows, out)


def average_rank(by: list[str], x: str) -> Column:
    """Rank of x among the rows of ``by``, ties sharing their mean."""
    peers = Window.partitionBy(*by, x)
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)


def transitions(history: DataFrame, config: EngineConfig) -> DataFrame:
    """What follows what: switches, changes of amount, the last against the rest, rates between types, and rolling velocity."""
    w = per_alert()
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', tx_ts)")
    rows = history.select("alert_id", *ORDER, "is_in").withColumn("us", us)
    rows = rows.withColumns({"p_in": F.lag("is_in").over(w), "p_type": F.lag("tx_type").over(w), "delta": F.col("amount") - F.lag("amount").over(w), "late": F.row_number().over(per_alert(True)), "avg_rank": average_rank(["alert_id"], "amount")})
    for name, seconds in config.velocities:
        rows = rows.withColumn(f"v_{name}", F.count(F.lit(1)).over(Window.partitionBy("alert_id").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)))
    return transitions_of(rows, config)


def transitions_of(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """``rows``: transactions with p_in and p_type of the one before, the change of amount, places from the end, ranks of amounts and rolling counts."""
    c, key = F.col, order_key()
    d = F.abs("delta")
    out = {"tr_dir_switch_rate": share_where(c("p_in") != c("is_in")), "tr_type_switch_rate": share_where(c("p_type") != c("tx_type")), "tr_in_to_out_rate": share_where((c("p_in") == 1) & (c("is_in") == 0)), "tr_out_to_in_rate": share_where((c("p_in") == 0) & (c("is_in") == 1)), "tr_damt_abs_mean": F.avg(d), "tr_damt_std": F.stddev_samp("delta"), "tr_damt_similar_share": share_where(d < 0.05), "tr_last_amt": F.max(F.when(c("late") == 1, c("amount"))), "_mean": F.avg("amount"), "_std": F.stddev_samp("amount"), "_last5": F.avg(F.when(c("late") <= 5, c("amount"))), "_last20": F.avg(F.when(c("late") <= 20, c("amount"))), "_rank": F.max(F.when(c("late") == 1, c("avg_rank"))), "_n": F.count(F.lit(1)), "_first": F.min_by("amount", key)}
    out |= {f"tr_{a}_to_{b}": share_where((c("p_type") == a) & (c("tx_type") == b)) for a, b in permutations(config.types, 2)}
    out |= {f"vel_max_{name}": F.max(f"v_{name}") for name, _ in config.velocities}
    last = c("tr_last_amt")
    return grouped(rows, out).withColumns({"tr_last_minus_mean": last - c("_mean"), "tr_last_z": ratio(last - c("_mean"), c("_std") + 1e-3), "tr_last5_minus_mean": c("_last5") - c("_mean"), "tr_last20_minus_mean": c("_last20") - c("_mean"), "tr_last_amt_pct_rank": ratio(c("_rank"), c("_n")), "tr_first_minus_last": c("_first") - last}).drop("_mean", "_std", "_last5", "_last20", "_rank", "_n", "_first")


def calendar(alerts: DataFrame) -> DataFrame:
    return alerts.select("alert_id", F.month("alert_date").alias("sig_month"), (F.weekday("alert_date") + 1).alias("sig_wday"), F.dayofmonth("alert_date").alias("sig_mday"), F.datediff("alert_date", F.lit("2025-01-01").cast("date")).alias("sig_days"))


def simple_aggregates(prepared: DataFrame, config: EngineConfig) -> DataFrame:
    x = F.col("amount")
    out = {"n": F.count(F.lit(1)), "mean": F.avg(x), "std": F.stddev_samp(x), "max": F.max(x), "min": F.min(x), "med": F.median(x), "in_share": F.avg("is_in"), "span": F.max("age") - F.min("age"), "last_age": F.min("age")}
    return grouped(prepared, out | {f"{t}_share": share_where(_type(t)) for t in config.types})


def sequences(prepared: DataFrame, alerts: DataFrame, config: EngineConfig, length: int) -> DataFrame:
    """The last ``length`` transactions before each alert, burst included, in order and padded in front with zeros; all zeros for an alert without any.

    Channels: mask, one-hot type, direction, amount, log age / 5.2, log hours since the transaction before / 5, hour on a circle, weekend, burst.
    """
    gap = F.expr("timestampdiff(SECOND, before, tx_ts)") / F.lit(3600.0)
    rows = prepared.withColumn("before", F.lag("tx_ts").over(per_alert())).withColumn("rk", F.row_number().over(per_alert(True))).where(F.col("rk") <= length)
    turn = F.lit(2 * 3.141592653589793 / 24)
    step = F.array(F.lit(1.0), *(_type(t).cast("double") for t in config.types), F.col("is_in").cast("double"), F.col("amount"), F.log1p("age") / 5.2, F.log1p(F.coalesce(gap, F.lit(0.0))) / 5.0, F.sin(F.col("hour") * turn), F.cos(F.col("hour") * turn), (F.col("wday") >= 5).cast("double"), (F.col("seconds") <= config.burst_seconds).cast("double"))
    steps = rows.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("rk")).alias("o"), step.cast("array<float>").alias("s")))).alias("steps"))
    width = 9 + len(config.types)
    all_steps = alerts.select("alert_id").join(steps, "alert_id", "left").withColumn("found", F.coalesce(F.transform("steps", lambda x: x["s"]), F.array().cast("array<array<float>>")))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), width), F.lit(length) - F.size("found"))
    return all_steps.select("alert_id", F.concat(pad, "found").alias("sequence"))
