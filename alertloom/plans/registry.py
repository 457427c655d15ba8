"""Queries by name over the tables of a folder, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import pairwise, permutations
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EVENTS, LINEITEM
from ..functions import profile, stats
from ..operators import families, reference, slices
from ..operators.prepare import prepare, split_burst, zero_fill
from ..sources import tables
from . import evaluation, features, reports, training, tuning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
C = EVENTS
DIGITS = 6


def _query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame) -> DataFrame:
    return df.selectExpr(*(f"round(`{f.name}`, {DIGITS}) AS `{f.name}`" if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`" for f in df.schema))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, tx = tables.events(spark, sf_dir)
    return prepare(tx, alerts)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_burst(_prepared(spark, sf_dir), C)[0]


def _burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_burst(_prepared(spark, sf_dir), C)[1]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    words = F.size(F.split("text", " "))
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), "toxic", "lang", "source", "n_chars", words.alias("n_words"), (F.col("n_chars") / words).alias("chars_word"))


# ---- SQL of the adapters and of the shared columns

TX = """tx AS (SELECT user_id AS alert_id, event_id AS tx_id, ts AS tx_ts, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 50 THEN 'in' ELSE 'out' END AS direction, event_type AS tx_type, ln(1 + value) - 3 AS amount FROM events),
alerts AS (SELECT DISTINCT user_id AS alert_id, TIMESTAMP '2024-01-20' + to_days(CAST(user_id % 10 AS INT)) AS alert_date FROM events),
p AS (SELECT *, seconds / 86400.0 AS age, CAST(floor(seconds / 86400.0) AS INT) AS day, exp(amount) AS e, exp(amount) * (2 * is_in - 1) AS flow, hour(tx_ts) AS hour, isodow(tx_ts) - 1 AS wday
  FROM (SELECT tx.*, alert_date, date_sub('second', tx_ts, alert_date) AS seconds, CASE WHEN direction = 'in' THEN 1 ELSE 0 END AS is_in FROM tx JOIN alerts USING (alert_id)) WHERE seconds > 0),
h AS (SELECT * FROM p WHERE seconds > 21600),
b AS (SELECT * FROM p WHERE seconds <= 21600)"""
LABELLED = "d AS (SELECT doc_id, quality AS label, toxic, lang, source, n_chars, len(string_split(text, ' ')) AS n_words, n_chars / len(string_split(text, ' ')) AS chars_word FROM labels JOIN documents USING (doc_id))"
ASC = "tx_ts, direction, tx_type, amount"
DESC = "tx_ts DESC, direction, tx_type, amount"


def _r(x: str, name: str) -> str:
    return f"round({x}, {DIGITS}) AS {name}"


def _n(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


def _of(columns: list[str], source: str = "h", extra: str = "") -> str:
    return f"WITH {TX}{extra} SELECT alert_id, {', '.join(columns)} FROM {source} GROUP BY alert_id"


def _block(p: str, cond: str) -> list[str]:
    x = f"CASE WHEN {cond} THEN amount END"
    return [_n(f"count({x})", f"{p}_n"), _r(f"coalesce(sum({x}), 0)", f"{p}_sum"), _r(f"avg({x})", f"{p}_mean"), _r(f"stddev_samp({x})", f"{p}_std"), _r(f"max({x})", f"{p}_max"), _r(f"min({x})", f"{p}_min"), _r(f"median({x})", f"{p}_med")]


def _sum(cond: str, x: str) -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN {x} END), 0)"


def _avg(cond: str, x: str) -> str:
    return f"avg(CASE WHEN {cond} THEN {x} END)"


def _share(cond: str) -> str:
    return f"avg(CAST(({cond}) AS DOUBLE))"


# ---- sources, preparation


@_query(f"WITH {TX} SELECT alert_id, tx_id, {_r('age', 'age')}, day, direction, tx_type, {_r('amount', 'amount')}, {_r('flow', 'flow')}, CAST(hour AS INT) AS hour, CAST(wday AS INT) AS wday FROM p")
def prepare_pit_filter(spark, sf_dir):
    return rounded(_prepared(spark, sf_dir).select("alert_id", "tx_id", "age", "day", "direction", "tx_type", "amount", "flow", "hour", "wday"))


@_query("""WITH tx AS (SELECT o_custkey AS alert_id, l_shipdate AS tx_ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT c_custkey AS alert_id, CAST(count(tx_ts) AS BIGINT) AS n, max(tx_ts) AS latest FROM customer LEFT JOIN tx ON alert_id = c_custkey AND date_sub('second', tx_ts, TIMESTAMP '2000-01-01') > 0 GROUP BY c_custkey""")
def prepare_lineitem_history(spark, sf_dir):
    alerts, tx = tables.lineitem(spark, sf_dir)
    counts = prepare(tx, alerts).groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"), F.max("tx_ts").alias("latest"))
    return alerts.select("alert_id").join(counts, "alert_id", "left").fillna(0, ["n"])


@_query(f"WITH {TX} SELECT alert_id, CAST(count(CASE WHEN seconds > 21600 THEN 1 END) AS BIGINT) AS history_n, CAST(count(CASE WHEN seconds <= 21600 THEN 1 END) AS BIGINT) AS burst_n FROM p GROUP BY alert_id")
def burst_split_counts(spark, sf_dir):
    inside = F.col("seconds") <= C.burst_seconds
    return _prepared(spark, sf_dir).groupBy("alert_id").agg(F.count_if(~inside).alias("history_n"), F.count_if(inside).alias("burst_n"))


@_query(f"WITH {TX} SELECT alert_id, CAST(month(alert_date) AS INT) AS sig_month, CAST(isodow(alert_date) AS INT) AS sig_wday, CAST(day(alert_date) AS INT) AS sig_mday, CAST(date_diff('day', DATE '2025-01-01', CAST(alert_date AS DATE)) AS INT) AS sig_days FROM alerts")
def calendar_parts(spark, sf_dir):
    return families.calendar(tables.events(spark, sf_dir)[0])


@_query(f"WITH {TX} SELECT date_trunc('week', tx_ts) AS wk, tx_type, {_r('median(amount)', 'base')} FROM p GROUP BY ALL")
def weekly_baseline(spark, sf_dir):
    return rounded(reference.weekly_baseline(_prepared(spark, sf_dir)).withColumn("wk", F.col("wk").cast("timestamp_ntz")))


@_query(f"WITH {TX}, base AS (SELECT date_trunc('week', tx_ts) AS wk, tx_type, median(amount) AS base FROM p GROUP BY ALL) SELECT alert_id, {_n('count(*)', 'n')}, {_r('avg(amount - coalesce(base, 0))', 'amt_mean')}, {_r('max(amount - coalesce(base, 0))', 'amt_max')} FROM p LEFT JOIN base ON date_trunc('week', tx_ts) = wk AND p.tx_type = base.tx_type GROUP BY alert_id")
def detrend_join(spark, sf_dir):
    alerts, tx = tables.events(spark, sf_dir)
    base = reference.weekly_baseline(prepare(tx, alerts))
    return rounded(prepare(tx, alerts, base).groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("amt_mean"), F.max("amount").alias("amt_max")))


# ---- aggregates


def _agg(spark, sf_dir, columns: list[str]) -> DataFrame:
    h = _history(spark, sf_dir)
    return rounded(families.aggregates(h, reference.global_thresholds(h), C).select("alert_id", *columns))


_BASIC = ["n_tx", "active_days", "first_age", "last_age", "amt_mean", "amt_std", "amt_min", "amt_max", "amtx_sum", "amtx_mean", "net_flow", "share_gt_p90", "share_gt_p99", "n_gt_p99", "share_lt_p10", "in_share"]


@_query(_of([_n("count(*)", "n_tx"), _n("count(DISTINCT day)", "active_days"), _r("max(age)", "first_age"), _r("min(age)", "last_age"), _r("avg(amount)", "amt_mean"), _r("stddev_samp(amount)", "amt_std"), _r("min(amount)", "amt_min"), _r("max(amount)", "amt_max"), _r("sum(e)", "amtx_sum"), _r("avg(e)", "amtx_mean"), _r("sum(flow)", "net_flow"), _r(_share("amount > p90"), "share_gt_p90"), _r(_share("amount > p99"), "share_gt_p99"), _n("count(CASE WHEN amount > p99 THEN 1 END)", "n_gt_p99"), _r(_share("amount < p10"), "share_lt_p10"), _r("avg(is_in)", "in_share")], "h, t", ", t AS (SELECT quantile_cont(amount, 0.1) AS p10, quantile_cont(amount, 0.9) AS p90, quantile_cont(amount, 0.99) AS p99 FROM h)"))
def agg_basic(spark, sf_dir):
    return _agg(spark, sf_dir, _BASIC)


_Q = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


@_query(_of([_r(f"quantile_cont(amount, {q})", f"amt_{n}") for n, q in _Q.items()]))
def agg_quantiles(spark, sf_dir):
    return _agg(spark, sf_dir, [f"amt_{n}" for n in _Q])


@_query(f"WITH {TX}, m AS (SELECT *, avg(amount) OVER (PARTITION BY alert_id) AS mu FROM h) SELECT alert_id, CASE WHEN count(*) > 1 THEN {'round(avg((amount - mu) ** 3) / pow(nullif(var_pop(amount), 0), 1.5), 6)'} END AS amt_skew, CASE WHEN count(*) > 1 THEN {'round(avg((amount - mu) ** 4) / pow(nullif(var_pop(amount), 0), 2) - 3, 6)'} END AS amt_kurt FROM m GROUP BY alert_id")
def agg_moments(spark, sf_dir):
    return _agg(spark, sf_dir, ["amt_skew", "amt_kurt"])


def _names(*prefixes: str) -> list[str]:
    return [f"{p}_{m}" for p in prefixes for m in ("n", "sum", "mean", "std", "max", "min", "med")]


@_query(_of([x for d in C.directions for x in [*_block(d, f"direction = '{d}'"), _r(_sum(f"direction = '{d}'", "e"), f"{d}_amtx_sum"), _r(f"max(CASE WHEN direction = '{d}' THEN e END)", f"{d}_amtx_max")]]))
def agg_by_direction(spark, sf_dir):
    return _agg(spark, sf_dir, [x for d in C.directions for x in [*_names(d), f"{d}_amtx_sum", f"{d}_amtx_max"]])


@_query(_of([x for t in C.types for x in [*_block(t, f"tx_type = '{t}'"), _r(_sum(f"tx_type = '{t}'", "e"), f"{t}_amtx_sum"), _r(_share(f"tx_type = '{t}'"), f"{t}_share"), _n(f"count(DISTINCT CASE WHEN tx_type = '{t}' THEN day END)", f"{t}_days"), _r(f"min(CASE WHEN tx_type = '{t}' THEN age END)", f"{t}_last_age")]]))
def agg_by_type(spark, sf_dir):
    return _agg(spark, sf_dir, [x for t in C.types for x in [*_names(t), f"{t}_amtx_sum", f"{t}_share", f"{t}_days", f"{t}_last_age"]])


_BOTH = [(f"{t}_{d}", f"tx_type = '{t}' AND direction = '{d}'") for t in C.types for d in C.directions]


@_query(_of([x for p, c in _BOTH for x in (_n(f"count(CASE WHEN {c} THEN 1 END)", f"{p}_n"), _r(_sum(c, "e"), f"{p}_amtx_sum"), _r(_avg(c, "amount"), f"{p}_mean"), _r(f"max(CASE WHEN {c} THEN amount END)", f"{p}_max"))]))
def agg_type_x_dir(spark, sf_dir):
    return _agg(spark, sf_dir, [f"{p}_{m}" for p, _ in _BOTH for m in ("n", "amtx_sum", "mean", "max")])


_IN, _OUT = "direction = 'in'", "direction = 'out'"


@_query(_of([_r("max(age) - min(age)", "span_days"), _r("count(*) / count(DISTINCT day)", "tx_per_active_day"), _r("count(DISTINCT day) / ceil(max(age))", "active_day_ratio"), _r("max(amount) - median(amount)", "amt_max_minus_med"), _r(f"count(CASE WHEN {_IN} THEN 1 END) / (count(CASE WHEN {_OUT} THEN 1 END) + 1)", "in_out_n_ratio"), _r(f"{_sum(_IN, 'e')} / ({_sum(_OUT, 'e')} + 1e-3)", "in_out_amtx_ratio"), _r(f"{_sum(_OUT, 'e')} / ({_sum(_IN, 'e')} + 1e-3)", "out_in_amtx_ratio"), _r(f"max(CASE WHEN {_IN} THEN amount END) - max(CASE WHEN {_OUT} THEN amount END)", "max_in_minus_max_out"), _r("sum(flow) / (sum(e) + 1e-3)", "net_flow_norm"), _r(_share(f"tx_type IN ('{C.cash}', '{C.intl}')"), "cash_intl_share")]))
def agg_derived(spark, sf_dir):
    return _agg(spark, sf_dir, ["span_days", "tx_per_active_day", "active_day_ratio", "amt_max_minus_med", "in_out_n_ratio", "in_out_amtx_ratio", "out_in_amtx_ratio", "max_in_minus_max_out", "net_flow_norm", "cash_intl_share"])


@_query(f"WITH {TX}, s AS (SELECT alert_id, tx_type, count(*) / sum(count(*)) OVER (PARTITION BY alert_id) AS s FROM h GROUP BY alert_id, tx_type) SELECT alert_id, round(-sum(s * ln(s)), {DIGITS}) + 0.0 AS type_entropy, CAST(count(*) AS BIGINT) AS type_nunique FROM s GROUP BY alert_id")
def agg_entropy(spark, sf_dir):
    return _agg(spark, sf_dir, ["type_entropy", "type_nunique"])


# ---- reference statistics and histograms


@_query(f"WITH {TX} SELECT {_r('quantile_cont(amount, 0.1)', 'p10')}, {_r('quantile_cont(amount, 0.9)', 'p90')}, {_r('quantile_cont(amount, 0.99)', 'p99')} FROM h")
def global_thresholds(spark, sf_dir):
    return rounded(reference.global_thresholds(_history(spark, sf_dir)))


@_query(f"WITH {TX} SELECT tx_type, {', '.join(_r(f'quantile_cont(amount, {i / 8})', f'edge{i}') for i in range(1, 8))} FROM h GROUP BY tx_type")
def type_edges(spark, sf_dir):
    edges = reference.type_edges(_history(spark, sf_dir))
    return rounded(edges.select("tx_type", *(F.get("edges", i - 1).alias(f"edge{i}") for i in range(1, 8))))


_BINS = f", q AS (SELECT tx_type, {', '.join(f'quantile_cont(amount, {i / 8}) AS e{i}' for i in range(1, 8))} FROM h GROUP BY tx_type), hb AS (SELECT h.*, CASE {' '.join(f'WHEN amount <= e{i} THEN {i - 1}' for i in range(1, 8))} ELSE 7 END AS bin FROM h JOIN q USING (tx_type))"
_CELLS = [(f"{t}_{f'{d}_' if d else ''}bin{i}", f"tx_type = '{t}' AND bin = {i}" + (f" AND direction = '{d}'" if d else ""), t) for t in C.types for d in (None, *C.directions) for i in range(8)]


def _hist(spark, sf_dir, ending: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return rounded(families.amount_histogram(h, reference.type_edges(h), C).select("alert_id", *(f"{p}_{ending}" for p, _, _ in _CELLS)))


@_query(_of([_n(f"count(CASE WHEN {c} THEN 1 END)", f"{p}_n") for p, c, _ in _CELLS], "hb", _BINS))
def hist_counts(spark, sf_dir):
    return _hist(spark, sf_dir, "n")


@_query(_of([_r(f"count(CASE WHEN {c} THEN 1 END) / nullif(count(CASE WHEN tx_type = '{t}' THEN 1 END), 0)", f"{p}_frac") for p, c, t in _CELLS], "hb", _BINS))
def hist_fracs(spark, sf_dir):
    return _hist(spark, sf_dir, "frac")


# ---- windows, burst, shift


def _win_base() -> list[str]:
    out = []
    for w in C.windows:
        now, before, p = f"age <= {w}", f"age > {w} AND age <= {2 * w}", f"w{w}"
        out += [_n(f"count(CASE WHEN {now} THEN 1 END)", f"{p}_n"), _n(f"count(CASE WHEN {before} THEN 1 END)", f"{p}_prev_n"), _r(_sum(now, "e"), f"{p}_amtx_sum"), _r(_sum(before, "e"), f"{p}_prev_amtx_sum"), _r(_avg(now, "amount"), f"{p}_amt_mean"), _r(f"max(CASE WHEN {now} THEN amount END)", f"{p}_amt_max"), _r(_sum(now, "flow"), f"{p}_net_flow"), _r(_avg(now, "is_in"), f"{p}_in_share"), _n(f"count(CASE WHEN {now} AND {_OUT} THEN 1 END)", f"{p}_out_n"), _r(_sum(f"{now} AND {_OUT}", "e"), f"{p}_out_amtx_sum"), _n(f"count(DISTINCT CASE WHEN {now} THEN day END)", f"{p}_active_days")]
        out += [_n(f"count(CASE WHEN {now} AND tx_type = '{t}' THEN 1 END)", f"{p}_{t}_n") for t in C.types]
    return out


def _win_ratios() -> list[str]:
    out, days = [], "ceil(max(age))"
    for w in C.windows:
        now, before, p = f"age <= {w}", f"age > {w} AND age <= {2 * w}", f"w{w}"
        n = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
        out += [_r(f"{n(now)} / ({n(before)} + 1)", f"{p}_vs_prev_n"), _r(f"{_sum(now, 'e')} / ({_sum(before, 'e')} + 1)", f"{p}_vs_prev_amtx"), _r(f"({n(now)} / {w}.0) / (count(*) / {days})", f"{p}_rate_vs_hist"), _r(f"({_sum(now, 'e')} / {w}.0) / (sum(e) / {days})", f"{p}_amtx_rate_vs_hist"), _r(f"{n(now)} / count(*)", f"{p}_share_n"), _r(f"{n(f'{now} AND {_OUT}')} / ({n(now)} + 1)", f"{p}_out_frac")]
        out += [_r(f"{n(f'''{now} AND tx_type = '{t}' ''')} / ({n(now)} + 1)", f"{p}_{name}_frac") for name, t in (("cash", C.cash), ("intl", C.intl))]
    return out


@_query(_of(_win_base()))
def win_base(spark, sf_dir):
    names = ["n", "prev_n", "amtx_sum", "prev_amtx_sum", "amt_mean", "amt_max", "net_flow", "in_share", "out_n", "out_amtx_sum", "active_days", *(f"{t}_n" for t in C.types)]
    return rounded(families.windows(_history(spark, sf_dir), C).select("alert_id", *(f"w{w}_{m}" for w in C.windows for m in names)))


@_query(_of(_win_ratios()))
def win_ratios(spark, sf_dir):
    names = ["vs_prev_n", "vs_prev_amtx", "rate_vs_hist", "amtx_rate_vs_hist", "share_n", "out_frac", "cash_frac", "intl_frac"]
    return rounded(families.windows(_history(spark, sf_dir), C).select("alert_id", *(f"w{w}_{m}" for w in C.windows for m in names)))


@_query(_of([_r(f"(count(CASE WHEN age <= {a} THEN 1 END) / {a}.0) / (count(CASE WHEN age <= {b} THEN 1 END) / {b}.0 + 1e-3)", f"accel_{a}_{b}") for a, b in pairwise(C.windows)]))
def win_accel(spark, sf_dir):
    return rounded(families.windows(_history(spark, sf_dir), C).select("alert_id", *(f"accel_{a}_{b}" for a, b in pairwise(C.windows))))


_B_TYPES = [x for t in C.types for x in (_n(f"count(CASE WHEN tx_type = '{t}' THEN 1 END)", f"b_{t}_n"), _r(_avg(f"tx_type = '{t}'", "amount"), f"b_{t}_mean"), _r(f"max(CASE WHEN tx_type = '{t}' THEN amount END)", f"b_{t}_max"))]
_B_ALL = [_n("count(*)", "b_n"), _r("avg(amount)", "b_amt_mean"), _r("stddev_samp(amount)", "b_amt_std"), _r("max(amount)", "b_amt_max"), _r("min(amount)", "b_amt_min"), _r("median(amount)", "b_amt_med"), _r("sum(e)", "b_amtx_sum"), _r("sum(flow)", "b_net_flow"), _r("avg(is_in)", "b_in_share")]


@_query(_of([*_B_ALL, *_B_TYPES, *(x for p, c in _BOTH for x in (_n(f"count(CASE WHEN {c} THEN 1 END)", f"b_{p}_n"), _r(_avg(c, "amount"), f"b_{p}_mean")))], "b"))
def burst_agg(spark, sf_dir):
    return rounded(families.burst(_burst(spark, sf_dir), C))


@_query(f"WITH {TX}, x AS (SELECT alert_id, count(*) AS n, ceil(max(age)) AS days, avg(amount) AS m, stddev_samp(amount) AS s, max(amount) AS mx, avg(is_in) AS i, {', '.join(f'''{_share(f"tx_type = '{t}'")} AS s_{t}, {_avg(f"tx_type = '{t}'", 'amount')} AS m_{t}''' for t in C.types)} FROM h GROUP BY alert_id), y AS (SELECT alert_id, count(*) AS n, avg(amount) AS m, max(amount) AS mx, avg(is_in) AS i, {', '.join(f'''count(CASE WHEN tx_type = '{t}' THEN 1 END) AS n_{t}, {_avg(f"tx_type = '{t}'", 'amount')} AS m_{t}''' for t in C.types)} FROM b GROUP BY alert_id) SELECT alerts.alert_id, {_r('y.m - x.m', 'br_amt_mean_diff')}, {_r('y.mx - x.mx', 'br_amt_max_diff')}, {_r('(y.m - x.m) / (x.s + 1e-3)', 'br_amt_mean_z')}, {_r('y.n / (x.n / x.days + 1e-3)', 'br_n_vs_daily_rate')}, {_r('coalesce(y.n / (x.n + 1), 0)', 'br_n_vs_hist_n')}, {_r('y.i - x.i', 'br_in_share_diff')}, {', '.join(_r(f'y.n_{t} / (y.n + 1e-9) - x.s_{t}', f'br_{t}_share_diff') + ', ' + _r(f'y.m_{t} - x.m_{t}', f'br_{t}_mean_diff') for t in C.types)} FROM alerts LEFT JOIN x USING (alert_id) LEFT JOIN y USING (alert_id)")
def burst_relative(spark, sf_dir):
    alerts, tx = tables.events(spark, sf_dir)
    h, b = split_burst(prepare(tx, alerts), C)
    joined = alerts.select("alert_id").join(families.aggregates(h, reference.global_thresholds(h), C), "alert_id", "left").join(families.burst(b, C), "alert_id", "left")
    columns = families.burst_relative(C)
    return rounded(zero_fill(joined.withColumns(columns).select("alert_id", *columns)))


def _shift_sql() -> list[str]:
    out = []
    for w in C.shift_windows:
        change = lambda f, x, w=w: f"{f}(CASE WHEN age <= {w} THEN {x} END) - {f}(CASE WHEN age > {w} THEN {x} END)"
        out += [_r(change("avg", "amount"), f"sh{w}_amt_mean"), _r(change("stddev_samp", "amount"), f"sh{w}_amt_std"), _r(change("avg", "is_in"), f"sh{w}_in_share")]
        for t in C.shift_types:
            out += [_r(change("avg", f"CASE WHEN tx_type = '{t}' THEN amount END"), f"sh{w}_{t}_amt_mean"), _r(change("avg", f"CASE WHEN tx_type = '{t}' THEN 1.0 ELSE 0.0 END"), f"sh{w}_{t}_share")]
    return out


@_query(_of(_shift_sql()))
def shift(spark, sf_dir):
    return rounded(families.shift(_history(spark, sf_dir), C))


# ---- order


_RANKED = f", r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY {DESC}) - 1 AS rk, CASE tx_type {' '.join(f'''WHEN '{t}' THEN {k}''' for k, t in enumerate(C.types))} END AS code FROM h)"


@_query(_of([x for i in range(C.last_k) for x in (_r(f"max(CASE WHEN rk = {i} THEN amount END)", f"last{i}_amt"), _r(f"max(CASE WHEN rk = {i} THEN age END)", f"last{i}_age"), f"CAST(max(CASE WHEN rk = {i} THEN is_in END) AS INT) AS last{i}_in", f"CAST(max(CASE WHEN rk = {i} THEN code END) AS INT) AS last{i}_type")], "r", _RANKED))
def lastk_pivot(spark, sf_dir):
    return rounded(families.last_k(_history(spark, sf_dir), C).select("alert_id", *(f"last{i}_{m}" for i in range(C.last_k) for m in ("amt", "age", "in", "type"))))


@_query(_of([_r("avg(amount)", "last5_amt_mean"), _r("max(amount)", "last5_amt_max"), _r("avg(is_in)", "last5_in_share"), _r("max(age)", "last5_span_days"), _r(_share(f"tx_type IN ('{C.cash}', '{C.intl}')"), "last5_cash_intl_share")], f"(SELECT * FROM r WHERE rk < {C.last_k})", _RANKED))
def lastk_summary(spark, sf_dir):
    return rounded(families.last_k(_history(spark, sf_dir), C).select("alert_id", *(f"last5_{m}" for m in ("amt_mean", "amt_max", "in_share", "span_days", "cash_intl_share"))))


_GAPS = f", g AS (SELECT *, ((epoch_us(tx_ts) - lag(epoch_us(tx_ts)) OVER (PARTITION BY alert_id ORDER BY {ASC})) // 1000000) / 3600.0 AS gap FROM h)"


@_query(_of([_r("avg(gap)", "gap_mean"), _r("stddev_samp(gap)", "gap_std"), _r("median(gap)", "gap_med"), _r("min(gap)", "gap_min"), _r("max(gap)", "gap_max"), _r("quantile_cont(gap, 0.1)", "gap_q10"), _r("quantile_cont(gap, 0.9)", "gap_q90"), _r(_share("gap < 1"), "gap_lt1h_share"), _r(_share("gap < 1.0 / 12"), "gap_lt5m_share"), _n("count(CASE WHEN gap > 168 THEN 1 END)", "gap_gt7d_n"), _r("avg(ln(1 + gap))", "gap_logmean"), _r("stddev_samp(ln(1 + gap))", "gap_logstd"), _r("stddev_samp(gap) / nullif(avg(gap), 0)", "gap_cv")], "g", _GAPS))
def gaps(spark, sf_dir):
    return rounded(families.gaps(_history(spark, sf_dir)).drop("days_active_after_max_gap", "dormant_reactivated_30d"))


@_query(_of([_r("((max(epoch_us(tx_ts)) - arg_max(epoch_us(tx_ts), (coalesce(gap, 0), epoch_us(tx_ts)))) // 1000000) / 86400.0", "days_active_after_max_gap"), _n("coalesce(max(gap), 0) > 720", "dormant_reactivated_30d")], "g", _GAPS))
def dormancy(spark, sf_dir):
    return rounded(families.gaps(_history(spark, sf_dir)).select("alert_id", "days_active_after_max_gap", "dormant_reactivated_30d"))


_LAG = f", l AS (SELECT *, lag(is_in) OVER w AS p_in, lag(tx_type) OVER w AS p_type, amount - lag(amount) OVER w AS delta, row_number() OVER (PARTITION BY alert_id ORDER BY {DESC}) AS late, rank() OVER (PARTITION BY alert_id ORDER BY amount) + (count(*) OVER (PARTITION BY alert_id, amount) - 1) / 2.0 AS ar FROM h WINDOW w AS (PARTITION BY alert_id ORDER BY {ASC}))"


@_query(_of([_r(_share("p_in <> is_in"), "tr_dir_switch_rate"), _r(_share("p_type <> tx_type"), "tr_type_switch_rate"), _r(_share("p_in = 1 AND is_in = 0"), "tr_in_to_out_rate"), _r(_share("p_in = 0 AND is_in = 1"), "tr_out_to_in_rate"), _r("avg(abs(delta))", "tr_damt_abs_mean"), _r("stddev_samp(delta)", "tr_damt_std"), _r(_share("abs(delta) < 0.05"), "tr_damt_similar_share"), *(_r(_share(f"p_type = '{a}' AND tx_type = '{b}'"), f"tr_{a}_to_{b}") for a, b in permutations(C.types, 2))], "l", _LAG))
def transitions(spark, sf_dir):
    names = ["tr_dir_switch_rate", "tr_type_switch_rate", "tr_in_to_out_rate", "tr_out_to_in_rate", "tr_damt_abs_mean", "tr_damt_std", "tr_damt_similar_share", *(f"tr_{a}_to_{b}" for a, b in permutations(C.types, 2))]
    return rounded(families.transitions(_history(spark, sf_dir), C).select("alert_id", *names))


_LAST = "max(CASE WHEN late = 1 THEN amount END)"


@_query(_of([_r(_LAST, "tr_last_amt"), _r(f"{_LAST} - avg(amount)", "tr_last_minus_mean"), _r(f"({_LAST} - avg(amount)) / (stddev_samp(amount) + 1e-3)", "tr_last_z"), _r("avg(CASE WHEN late <= 5 THEN amount END) - avg(amount)", "tr_last5_minus_mean"), _r("avg(CASE WHEN late <= 20 THEN amount END) - avg(amount)", "tr_last20_minus_mean"), _r("max(CASE WHEN late = 1 THEN ar END) / count(*)", "tr_last_amt_pct_rank"), _r(f"arg_min(amount, ({ASC})) - {_LAST}", "tr_first_minus_last")], "l", _LAG))
def last_vs_history(spark, sf_dir):
    return rounded(families.transitions(_history(spark, sf_dir), C).select("alert_id", "tr_last_amt", "tr_last_minus_mean", "tr_last_z", "tr_last5_minus_mean", "tr_last20_minus_mean", "tr_last_amt_pct_rank", "tr_first_minus_last"))


@_query(_of([_n(f"max(v_{n})", f"vel_max_{n}") for n, _ in C.velocities], "v", ", v AS (SELECT alert_id, " + ", ".join(f"count(*) OVER (PARTITION BY alert_id ORDER BY epoch_us(tx_ts) RANGE BETWEEN {s * 1000000 - 1} PRECEDING AND CURRENT ROW) AS v_{n}" for n, s in C.velocities) + " FROM h)"))
def velocity_max(spark, sf_dir):
    return families.transitions(_history(spark, sf_dir), C).select("alert_id", *(f"vel_max_{n}" for n, _ in C.velocities))


_ASOF = ", o AS (SELECT * FROM h WHERE direction = 'out'), i AS (SELECT alert_id, tx_ts, amount AS in_amount, tx_type AS in_type FROM h WHERE direction = 'in'), m AS (SELECT o.*, i.in_amount, i.in_type, date_sub('second', i.tx_ts, o.tx_ts) / 3600.0 AS lag, abs(o.amount - i.in_amount) AS delta FROM o ASOF LEFT JOIN i ON o.alert_id = i.alert_id AND o.tx_ts >= i.tx_ts)"


@_query(_of([_n("count(*)", "pt_out_n"), _r("median(lag)", "pt_lag_med"), _r("avg(lag)", "pt_lag_mean"), _r("min(lag)", "pt_lag_min"), _n("count(CASE WHEN lag < 1 THEN 1 END)", "pt_1h_n"), _n("count(CASE WHEN lag < 24 THEN 1 END)", "pt_24h_n"), _n("count(CASE WHEN lag < 24 AND delta < 0.25 THEN 1 END)", "pt_24h_similar_n"), _n("count(CASE WHEN lag < 72 AND delta < 0.25 THEN 1 END)", "pt_72h_similar_n"), _n("count(CASE WHEN lag < 24 AND amount > 1 THEN 1 END)", "pt_24h_large_n"), _r("avg(CASE WHEN lag < 24 THEN delta END)", "pt_24h_amtdiff_mean"), _r(_sum("lag < 24", "e"), "pt_24h_out_amtx"), _n(f"count(CASE WHEN lag < 24 AND in_type = '{C.intl}' THEN 1 END)", "pt_24h_from_intl_n"), _n(f"count(CASE WHEN lag < 24 AND tx_type IN ('{C.cash}', '{C.intl}') THEN 1 END)", "pt_24h_to_cash_intl_n"), _r("count(CASE WHEN lag < 24 THEN 1 END) / count(*)", "pt_24h_frac"), _r("count(CASE WHEN lag < 24 AND delta < 0.25 THEN 1 END) / count(*)", "pt_24h_similar_frac")], "m", _ASOF))
def asof_passthrough(spark, sf_dir):
    return rounded(families.passthrough(_history(spark, sf_dir), C))


# ---- time


@_query(_of([_r(_share("hour < 6"), "night_share"), _r(_share("wday >= 5"), "weekend_share"), _r("avg(hour)", "hour_mean"), _r("stddev_samp(hour)", "hour_std"), _r(_sum("hour < 6", "e"), "night_amtx_sum"), _n(f"count(CASE WHEN hour < 6 AND {_OUT} THEN 1 END)", "night_out_n"), _r(_share("minute(tx_ts) = 0"), "round_minute_share"), *(_r(_share(f"hour >= {a} AND hour < {b}"), f"hour_{a}_{b}_share") for a, b in pairwise(C.hour_bins)), *(_r(_share(f"wday = {k}"), f"wday{k}_share") for k in range(7))]))
def hour_wday_shares(spark, sf_dir):
    names = ["night_share", "weekend_share", "hour_mean", "hour_std", "night_amtx_sum", "night_out_n", "round_minute_share", *(f"hour_{a}_{b}_share" for a, b in pairwise(C.hour_bins)), *(f"wday{k}_share" for k in range(7))]
    return rounded(families.activity(_history(spark, sf_dir), C).select("alert_id", *names))


@_query(_of([x for hl in C.half_lives for x in (_r(f"sum(exp(-age * {log(2) / hl!r}))", f"ewm{hl}_n"), _r(f"sum(exp(-age * {log(2) / hl!r}) * e)", f"ewm{hl}_amtx"), _r(f"sum(exp(-age * {log(2) / hl!r}) * flow)", f"ewm{hl}_flow"))]))
def decayed_activity(spark, sf_dir):
    return rounded(families.activity(_history(spark, sf_dir), C).select("alert_id", *(f"ewm{hl}_{m}" for hl in C.half_lives for m in ("n", "amtx", "flow"))))


@_query(f"WITH {TX} SELECT alert_id, " + ", ".join(_r(f"regr_slope(y_{n}, x) FILTER (x >= {180 - w})", f"trend{w}_{n}") for w in C.trends for n in ("n", "amtx")) + " FROM (SELECT a.alert_id, 179 - d.day AS x, coalesce(c.n, 0) AS y_n, coalesce(c.e, 0) AS y_amtx FROM (SELECT DISTINCT alert_id FROM h) a CROSS JOIN (SELECT unnest(range(0, 180)) AS day) d LEFT JOIN (SELECT alert_id, day, count(*) AS n, sum(e) AS e FROM h GROUP BY alert_id, day) c ON c.alert_id = a.alert_id AND c.day = d.day) GROUP BY alert_id")
def daily_trend(spark, sf_dir):
    return rounded(families.activity(_history(spark, sf_dir), C).select("alert_id", *(f"trend{w}_{n}" for w in C.trends for n in ("n", "amtx"))))


@_query(f"WITH {TX}, c AS (SELECT alert_id, day, count(*) AS c, sum(e) AS e FROM h GROUP BY alert_id, day), s AS (SELECT alert_id, max(c) AS mx, max(e) AS me, arg_max(day, (c, day)) AS busy, max(day) + 1 AS days, sum(c) AS sc, sum(c * c) AS scc, sum(e) AS se FROM c GROUP BY alert_id), m AS (SELECT *, sc / days AS mean, sqrt(greatest(scc / days - (sc / days) ** 2, 0)) AS sd FROM s) SELECT alert_id, {_n('mx', 'daily_n_max')}, {_r('me', 'daily_amtx_max')}, CAST(busy AS INT) AS busiest_day_age, {_r('mean', 'daily_n_mean')}, {_r('sd', 'daily_n_std')}, {_r('(mx - mean) / (sd + 1e-6)', 'burst_z')}, {_r('me / (se / days + 1e-6)', 'burst_amtx_ratio')} FROM m")
def daily_distribution(spark, sf_dir):
    return rounded(families.daily(_history(spark, sf_dir)))


@_query(_of([_n("count(*)", "n"), _r("avg(amount)", "mean"), _r("stddev_samp(amount)", "std"), _r("max(amount)", "max"), _r("min(amount)", "min"), _r("median(amount)", "med"), _r("avg(is_in)", "in_share"), _r("max(age) - min(age)", "span"), _r("min(age)", "last_age"), *(_r(_share(f"tx_type = '{t}'"), f"{t}_share") for t in C.types)], "p"))
def simple_aggregates(spark, sf_dir):
    return rounded(families.simple_aggregates(_prepared(spark, sf_dir), C))


_PARTS_OF = ("agg_basic", "agg_quantiles", "agg_moments", "agg_by_direction", "agg_by_type", "agg_type_x_dir", "agg_derived", "agg_entropy", "win_base", "win_ratios", "win_accel", "lastk_pivot", "lastk_summary", "hist_counts", "hist_fracs", "burst_agg", "burst_relative", "hour_wday_shares", "decayed_activity", "daily_trend", "gaps", "dormancy", "daily_distribution", "asof_passthrough", "transitions", "last_vs_history", "velocity_max", "shift", "calendar_parts")


def _whole_sql(parts: tuple[str, ...]) -> str:
    """The SQL of the families, joined to all alerts."""
    joins = " ".join(f"LEFT JOIN ({ORACLE_SQL[name]}) q{k} USING (alert_id)" for k, name in enumerate(parts))
    count = "(c LIKE '%\\_n' ESCAPE '\\' OR c IN ('n_tx', 'active_days'))"
    return f"WITH {TX}, j AS (SELECT * EXCLUDE (alert_date) FROM alerts {joins}) SELECT alert_id, CAST(coalesce(COLUMNS(lambda c: {count}), 0) AS DOUBLE), CAST(COLUMNS(lambda c: NOT {count} AND c <> 'alert_id') AS DOUBLE) FROM j"


@_query(_whole_sql(_PARTS_OF))
def feature_matrix(spark, sf_dir):
    alerts, tx = tables.events(spark, sf_dir)
    rows = features.dealt(tx, alerts)
    return features.build_features(rows, alerts, C, features.fit_reference(rows, C), features.DEFAULT + features.OPTIONAL, DIGITS)


@_query()
def feature_matrix_lineitem(spark, sf_dir):
    alerts, tx = tables.lineitem(spark, sf_dir)
    rows = features.dealt(tx, alerts)
    return features.build_features(rows, alerts, LINEITEM, features.fit_reference(rows, LINEITEM), digits=DIGITS)


@_query()
def sequence_arrays(spark, sf_dir):
    alerts, tx = tables.events(spark, sf_dir)
    return families.sequences(prepare(tx, alerts), alerts, C, 32)


# ---- statistics on labelled documents

_FEATURES = ("n_chars", "n_words", "chars_word")
_LONG = f"WITH {LABELLED}, l AS (SELECT label, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS x FROM d UNION ALL SELECT label, 'n_words', n_words FROM d UNION ALL SELECT label, 'chars_word', chars_word FROM d), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS ar, count(*) OVER (PARTITION BY feature, x) AS t FROM l), s AS (SELECT feature, count(*) - sum(label) AS n0, sum(label) AS n1, sum(ar * label) AS rs, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY feature)"


def _long(spark, sf_dir) -> DataFrame:
    return stats.melt(_labelled(spark, sf_dir), ["label"], list(_FEATURES))


@_query(f"{_LONG} SELECT feature, {_n('n0', 'n0')}, {_n('n1', 'n1')}, {_r('(rs - n1 * (n1 + 1) / 2) / (n0 * n1)', 'auc')} FROM s")
def univariate_auc(spark, sf_dir):
    return rounded(stats.auc(_long(spark, sf_dir)).select("feature", "n0", "n1", "auc"))


@_query(f"{_LONG} SELECT feature, {_n('n0', 'n0')}, {_n('n1', 'n1')}, {_r('rs - n1 * (n1 + 1) / 2', 'u')}, {_r('2 * (rs - n1 * (n1 + 1) / 2) / (n0 * n1) - 1', 'cliffs_delta')}, {_r('(rs - n1 * (n1 + 1) / 2 - n0 * n1 / 2) / sqrt(n0 * n1 / 12.0 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1))))', 'z')} FROM s")
def mann_whitney(spark, sf_dir):
    return rounded(stats.mann_whitney(_long(spark, sf_dir)).select("feature", "n0", "n1", "u", "cliffs_delta", "z"))


@_query(f"{_LONG}, f AS (SELECT a.feature, a.x, avg(CASE WHEN b.label = 1 THEN CAST(b.x <= a.x AS INT) END) - avg(CASE WHEN b.label = 0 THEN CAST(b.x <= a.x AS INT) END) AS gap FROM (SELECT DISTINCT feature, x FROM l) a JOIN l b ON a.feature = b.feature GROUP BY ALL) SELECT f.feature, {_r('max(abs(gap))', 'ks')}, CAST(any_value(n0) AS BIGINT) AS n0, CAST(any_value(n1) AS BIGINT) AS n1 FROM f JOIN s ON f.feature = s.feature GROUP BY f.feature")
def ks_two_sample(spark, sf_dir):
    return rounded(stats.ks_two_sample(_long(spark, sf_dir)))


@_query(f"{_LONG}, f AS (SELECT a.feature, a.x, avg(CASE WHEN b.label = 1 THEN CAST(b.x <= a.x AS INT) END) - avg(CASE WHEN b.label = 0 THEN CAST(b.x <= a.x AS INT) END) AS gap FROM (SELECT DISTINCT feature, x FROM l) a JOIN l b ON a.feature = b.feature GROUP BY ALL), k AS (SELECT f.feature, max(abs(gap)) AS ks, any_value(n0) AS n0, any_value(n1) AS n1 FROM f JOIN s ON f.feature = s.feature GROUP BY f.feature), y AS (SELECT *, ks * ks * n0 * n1 / (n0 + n1) AS xx FROM k) SELECT feature, {_r('ks', 'ks')}, round(CASE WHEN xx < 0.04 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * i * i * xx))))) END, {DIGITS}) AS p FROM y")
def ks_p_values(spark, sf_dir):
    found = stats.ks_two_sample(_long(spark, sf_dir))
    return rounded(found.select("feature", "ks", stats.ks_p(F.col("ks"), F.col("n0"), F.col("n1")).alias("p")))


@_query("WITH o AS (SELECT CAST(o_orderstatus = 'F' AS INT) AS label, o_orderkey, epoch(o_orderdate) AS d FROM orders), l AS (SELECT label, 'id' AS feature, CAST(o_orderkey AS DOUBLE) AS x FROM o UNION ALL SELECT label, 'date', d FROM o), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS ar FROM l), s AS (SELECT feature, count(*) - sum(label) AS n0, sum(label) AS n1, sum(ar * label) AS rs FROM r GROUP BY feature) SELECT feature, " + _n("n0", "n0") + ", " + _n("n1", "n1") + ", " + _r("(rs - n1 * (n1 + 1) / 2) / (n0 * n1)", "auc") + " FROM s")
def audit_order_auc(spark, sf_dir):
    """Do ids or dates tell the label?"""
    orders = _table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("date"))
    return rounded(stats.auc(stats.melt(orders, ["label"], ["id", "date"])).select("feature", "n0", "n1", "auc"))


@_query(f"SELECT {_n('count(value)', 'n')}, {_r('avg(value)', 'mean')}, {_r('stddev_samp(value)', 'std')}, {_r('min(value)', 'min')}, {_r('quantile_cont(value, 0.25)', 'q25')}, {_r('quantile_cont(value, 0.5)', 'q50')}, {_r('quantile_cont(value, 0.75)', 'q75')}, {_r('max(value)', 'max')} FROM events")
def describe_values(spark, sf_dir):
    return rounded(stats.describe(_table(spark, sf_dir, "events"), "value"))


_CHI = "t AS (SELECT lang, label, count(*) AS o FROM d GROUP BY ALL), full_t AS (SELECT a.lang, b.label, coalesce(o, 0) AS o, r * c / n AS e, n FROM (SELECT lang, sum(o) AS r FROM t GROUP BY 1) a CROSS JOIN (SELECT label, sum(o) AS c FROM t GROUP BY 1) b CROSS JOIN (SELECT sum(o) AS n FROM t) LEFT JOIN t ON t.lang = a.lang AND t.label = b.label)"


@_query(f"WITH {LABELLED}, {_CHI} SELECT {_r('sum((o - e) ** 2 / e)', 'chi2')}, CAST((count(DISTINCT lang) - 1) * (count(DISTINCT label) - 1) AS BIGINT) AS dof, CAST(max(n) AS BIGINT) AS n, {_r('sqrt(sum((o - e) ** 2 / e) / (max(n) * least(count(DISTINCT lang) - 1, count(DISTINCT label) - 1)))', 'cramers_v')} FROM full_t")
def chi2_cramers_v(spark, sf_dir):
    return rounded(stats.chi_square(_labelled(spark, sf_dir), "lang", "label"))


def _tail_sql(x: str, dof: str) -> str:
    """The upper tail of chi-square by the series of the incomplete gamma function."""
    h, a = f"({x} / 2.0)", f"({dof} / 2.0)"
    return f"CASE WHEN {h} <= 0 THEN 1.0 WHEN {h} > {a} + 40 + 9 * sqrt({a}) THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 401), lambda k: exp(-{h} + ({a} + k) * ln({h}) - lgamma({a} + k + 1))))) END"


def _chi2_sql(rows: str, features: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS v, label FROM d WHERE {f} IS NOT NULL" for f in features)
    return f"WITH {rows}, u AS ({parts}), c AS (SELECT feature, v, label, count(*) AS o FROM u GROUP BY ALL), r AS (SELECT feature, v, sum(o) AS r FROM c GROUP BY ALL), k AS (SELECT feature, label, sum(o) AS k FROM c GROUP BY ALL), n AS (SELECT feature, sum(o) AS n FROM c GROUP BY ALL), e AS (SELECT r.feature, r.v, k.label, r.r * k.k / n.n AS e, coalesce(c.o, 0) AS o, n.n FROM r JOIN k USING (feature) JOIN n USING (feature) LEFT JOIN c ON c.feature = r.feature AND c.v = r.v AND c.label = k.label), t AS (SELECT feature, sum((o - e) ** 2 / e) AS chi2, (count(DISTINCT v) - 1) * (count(DISTINCT label) - 1) AS dof, max(n) AS n FROM e GROUP BY feature) SELECT feature, {_r('chi2', 'chi2')}, CAST(dof AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, round({_tail_sql('chi2', 'dof')}, {DIGITS}) AS p FROM t"


def _chi2(rows: DataFrame, features: list[str]) -> DataFrame:
    tests = [stats.chi_square(rows, f, "label").withColumn("feature", F.lit(f)) for f in features]
    both = reduce(DataFrame.unionByName, tests).withColumn("p", stats.chi_square_p(F.col("chi2"), F.col("dof")))
    return rounded(both.select("feature", "chi2", "dof", "n", "p"))


@_query(_chi2_sql(LABELLED, ["lang", "source"]))
def chi2_p_values(spark, sf_dir):
    """Language and source against the label, with p-values."""
    return _chi2(_labelled(spark, sf_dir), ["lang", "source"])


@_query(_chi2_sql("d AS (SELECT month(o_orderdate) AS month, isodow(o_orderdate) AS weekday, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders)", ["month", "weekday"]))
def audit_calendar_chi2(spark, sf_dir):
    """Does the month or the weekday of an order tell the label?"""
    date = F.col("o_orderdate")
    rows = _table(spark, sf_dir, "orders").select(F.month(date).alias("month"), (F.weekday(date) + 1).alias("weekday"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return _chi2(rows, ["month", "weekday"])


@_query(f"{_LONG}, m AS (SELECT feature, median(x) FILTER (label = 0) AS median_0, median(x) FILTER (label = 1) AS median_1 FROM l GROUP BY feature), z AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, (rs - n1 * (n1 + 1) / 2 - n0 * n1 / 2) / sqrt(n0 * n1 / 12.0 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS z FROM s) SELECT feature, {_n('n0', 'n0')}, {_n('n1', 'n1')}, {_r('u', 'u')}, {_r('2 * u / (n0 * n1) - 1', 'cliffs_delta')}, {_r('z', 'z')}, round({_tail_sql('(z * z)', '1')}, {DIGITS}) AS p, {_r('median_0', 'median_0')}, {_r('median_1', 'median_1')} FROM z JOIN m USING (feature)")
def mann_whitney_report(spark, sf_dir):
    return rounded(stats.mann_whitney_report(_long(spark, sf_dir)))


@_query(f"WITH {LABELLED}, r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in _FEATURES) + " FROM d) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_r(f'corr({a}, {b})', 'rho')} FROM r" for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]))
def spearman(spark, sf_dir):
    return rounded(stats.spearman(_labelled(spark, sf_dir), list(_FEATURES), "doc_id"))


@_query(f"WITH {LABELLED} SELECT lang, {_n('count(CASE WHEN label = 0 THEN 1 END)', 'n_0')}, {_n('count(CASE WHEN label = 1 THEN 1 END)', 'n_1')}, {_r('count(CASE WHEN label = 0 THEN 1 END) / (SELECT count(*) FROM d)', 'share_0')}, {_r('count(CASE WHEN label = 1 THEN 1 END) / (SELECT count(*) FROM d)', 'share_1')} FROM d GROUP BY lang")
def crosstab(spark, sf_dir):
    return rounded(stats.crosstab(_labelled(spark, sf_dir), "lang", "label", [0, 1]))


@_query(f"WITH {LABELLED} SELECT source, {_r('avg(label)', 'rate')}, {_n('count(*)', 'n')}, {_r('avg(label) - 1.96 * sqrt(avg(label) * (1 - avg(label)) / count(*))', 'low')}, {_r('avg(label) + 1.96 * sqrt(avg(label) * (1 - avg(label)) / count(*))', 'high')} FROM d GROUP BY source")
def rate_band(spark, sf_dir):
    return rounded(stats.rate_band(_labelled(spark, sf_dir), "source", "label"))


@_query(f"WITH {TX}, a AS (SELECT alert_id, alert_id % 2 AS label FROM alerts), c AS (SELECT alert_id, least(day, 29) AS day, count(*) AS c FROM p GROUP BY ALL), g AS (SELECT a.label, d.day, count(*) AS n, avg(coalesce(c, 0)) AS mean, stddev_pop(coalesce(c, 0)) AS sd FROM a CROSS JOIN (SELECT unnest(range(0, 30)) AS day) d LEFT JOIN c ON c.alert_id = a.alert_id AND c.day = d.day GROUP BY ALL) SELECT CAST(label AS BIGINT) AS label, CAST(day AS INT) AS day, {_n('n', 'n')}, {_r('mean', 'mean')}, {_r('mean - 1.96 * sd / sqrt(n)', 'low')}, {_r('mean + 1.96 * sd / sqrt(n)', 'high')} FROM g")
def event_time_curve(spark, sf_dir):
    alerts, tx = tables.events(spark, sf_dir)
    return rounded(stats.event_time_curve(prepare(tx, alerts), alerts.withColumn("label", F.col("alert_id") % 2), 30))


_EDGES = [0.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 40000.0]


@_query("WITH b AS (SELECT CASE " + " ".join(f"WHEN n_chars >= {a} AND n_chars {'<=' if i == len(_EDGES) - 2 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(pairwise(_EDGES))) + " END AS bin FROM documents), c AS (SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin) SELECT CAST(bin AS INT) AS bin, CAST(n AS BIGINT) AS n, round(n / ((SELECT sum(n) FROM c) * CASE bin " + " ".join(f"WHEN {i} THEN {b - a}" for i, (a, b) in enumerate(pairwise(_EDGES))) + f" END), {DIGITS}) AS density FROM c")
def fixed_histogram(spark, sf_dir):
    return rounded(stats.histogram(_table(spark, sf_dir, "documents"), "n_chars", _EDGES))


_VIG = ", ".join(f"quantile_cont(n_chars, {i / 20})" for i in range(1, 20))


@_query(f"WITH {LABELLED}, q AS (SELECT list_sort(list_distinct([{_VIG}])) AS edges FROM d), b AS (SELECT label, len(list_filter(edges, lambda e: e < n_chars)) AS bin FROM d, q), c AS (SELECT bin, count(CASE WHEN label = 0 THEN 1 END) AS n0, count(CASE WHEN label = 1 THEN 1 END) AS n1 FROM b GROUP BY bin) SELECT CAST(bin AS INT) AS bin, {_n('n0', 'n0')}, {_n('n1', 'n1')}, {_r('n1 * (SELECT sum(n0) FROM c) / nullif(n0 * (SELECT sum(n1) FROM c), 0)', 'ratio')} FROM c")
def density_ratio(spark, sf_dir):
    return rounded(stats.density_ratio(_labelled(spark, sf_dir), "n_chars", "label"))


@_query(f"WITH {TX} SELECT tx_type, {_n('count(*)', 'n')}, {', '.join(_r(f'quantile_cont(amount, {q})', f'q{round(q * 100):02d}') for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM p GROUP BY tx_type")
def quantile_box(spark, sf_dir):
    return rounded(stats.quantile_box(_prepared(spark, sf_dir), "tx_type", "amount"))


@_query(f"WITH {TX}, c AS (SELECT tx_type, direction, count(CASE WHEN alert_id % 2 = 1 THEN 1 END) AS n1, count(CASE WHEN alert_id % 2 = 0 THEN 1 END) AS n0 FROM p GROUP BY ALL) SELECT tx_type, direction, {_n('n1', 'n1')}, {_n('n0', 'n0')}, {_r('n1 * (SELECT sum(n0) FROM c) / nullif(n0 * (SELECT sum(n1) FROM c), 0)', 'lift')} FROM c")
def type_lift(spark, sf_dir):
    return rounded(stats.lift(_prepared(spark, sf_dir).withColumn("label", F.col("alert_id") % 2), ["tx_type", "direction"], "label"))


@_query(f"WITH {LABELLED} SELECT doc_id, round((rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0) / count(*) OVER (PARTITION BY source), {DIGITS}) AS pct FROM d")
def cohort_pct_rank(spark, sf_dir):
    return rounded(stats.cohort_rank(_labelled(spark, sf_dir), ["source"], "n_chars").select("doc_id", "pct"))


@_query(f"WITH m AS (SELECT n_chars AS x, avg(n_chars) OVER () AS mu FROM documents), s AS (SELECT count(*) AS n, avg((x - mu) ** 3) / pow(var_pop(x), 1.5) AS g, avg((x - mu) ** 4) / pow(var_pop(x), 2) - 3 AS k FROM m) SELECT {_n('n', 'n')}, {_r('g * sqrt(n * (n - 1.0)) / (n - 2)', 'skew')}, {_r('(n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * k + 6)', 'kurt')} FROM s")
def corrected_moments(spark, sf_dir):
    return rounded(stats.corrected_moments(_table(spark, sf_dir, "documents"), "n_chars"))


# ---- audit


@_query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS repeated_ids, CAST(count(*) - count(value) AS BIGINT) AS null_values, CAST(count(CASE WHEN NOT regexp_full_match(event_type, '[a-z]+') THEN 1 END) AS BIGINT) AS bad_types,
min(ts) AS first_ts, max(ts) AS last_ts, CAST((SELECT count(*) FROM (SELECT user_id, ts, event_type, value, props FROM events GROUP BY ALL HAVING count(*) > 1)) AS BIGINT) AS repeated_rows, CAST(count(CASE WHEN value < 0 THEN 1 END) AS BIGINT) AS negative, CAST(count(CASE WHEN value = 0 THEN 1 END) AS BIGINT) AS zero, CAST(count(DISTINCT value) AS BIGINT) AS distinct_values FROM events""")
def audit_integrity(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    same = rows.groupBy("user_id", "ts", "event_type", "value", "props").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_rows"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("event_id")).alias("repeated_ids"), F.count_if(F.col("value").isNull()).alias("null_values"), F.count_if(~F.col("event_type").rlike("^[a-z]+$")).alias("bad_types"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("value") == 0).alias("zero"), F.count_distinct("value").alias("distinct_values"))
    return facts.crossJoin(same)


@_query(f"WITH {TX}, j AS (SELECT alert_id, tx_ts, alert_date FROM tx JOIN alerts USING (alert_id)) SELECT {_n('count(CASE WHEN tx_ts >= alert_date THEN 1 END)', 'late_rows')}, {_n('count(DISTINCT CASE WHEN tx_ts >= alert_date THEN alert_id END)', 'late_alerts')}, {_r('max(epoch_us(tx_ts) - epoch_us(alert_date)) / 3.6e9', 'max_hours_after')}, {_n('count(CASE WHEN tx_ts = alert_date THEN 1 END)', 'at_midnight')} FROM j")
def audit_post_alert(spark, sf_dir):
    alerts, tx = tables.events(spark, sf_dir)
    late = F.col("tx_ts") >= F.col("alert_date")
    out = tx.join(alerts, "alert_id").agg(F.count_if(late).alias("late_rows"), F.count_distinct(F.when(late, F.col("alert_id"))).alias("late_alerts"), (F.max(F.expr("timestampdiff(MICROSECOND, alert_date, tx_ts)")) / F.lit(3.6e9)).alias("max_hours_after"), F.count_if(F.col("tx_ts") == F.col("alert_date")).alias("at_midnight"))
    return rounded(out)


@_query("SELECT CAST((SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS BIGINT) AS customers_without_orders, CAST((SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS BIGINT) AS orphan_orders, CAST((SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)) AS BIGINT) AS labelled_documents, CAST((SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS BIGINT) AS unlabelled_documents")
def audit_membership(spark, sf_dir):
    customers, orders, docs, labels = (_table(spark, sf_dir, t) for t in ("customer", "orders", "documents", "labels"))
    counts = {"customers_without_orders": customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "orphan_orders": orders.join(customers, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "labelled_documents": labels.select("doc_id").intersect(docs.select("doc_id")), "unlabelled_documents": docs.select("doc_id").subtract(labels.select("doc_id"))}
    out = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


@_query(f"WITH {TX} SELECT CAST(hour(tx_ts) AS INT) AS hour, CAST(seconds <= 21600 AS INT) AS in_burst, tx_type, {_n('count(*)', 'n')} FROM p GROUP BY ALL")
def audit_hour_counts(spark, sf_dir):
    return _prepared(spark, sf_dir).groupBy("hour", (F.col("seconds") <= C.burst_seconds).cast("int").alias("in_burst"), "tx_type").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {TX}, t AS (SELECT alert_id, count(*) AS n, max(age) - min(age) AS span FROM p GROUP BY alert_id) SELECT {_n('count(*)', 'alerts')}, {_n('min(n)', 'min_n')}, {_r('median(n)', 'median_n')}, {_n('max(n)', 'max_n')}, {_r('median(span)', 'median_span')} FROM t")
def audit_tx_per_alert(spark, sf_dir):
    t = _prepared(spark, sf_dir).groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"), (F.max("age") - F.min("age")).alias("span"))
    medians = stats.quantiles(t, [], "n", [0.5]).select(F.get("q", 0).alias("median_n")).crossJoin(stats.quantiles(t, [], "span", [0.5]).select(F.get("q", 0).alias("median_span")))
    return rounded(t.agg(F.count(F.lit(1)).alias("alerts"), F.min("n").alias("min_n"), F.max("n").alias("max_n")).crossJoin(medians))  # one row each


# ---- reports

_CODES = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 4}
_PARTS = {"economy": "^ECON", "small": "^SMALL", "standard": "^STAND"}
_GAIN = "SELECT p_partkey, p_type, CASE WHEN p_size > 25 THEN p_retailprice ELSE 0 END AS gain FROM part"


def _gains(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", "p_type", F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(0.0).alias("gain"))


@_query("SELECT event_id, CAST(CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for t, i in _CODES.items()) + " END AS INT) AS code FROM events")
def strict_recode(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", reports.recode("event_type", _CODES).alias("code"))


def _period_sql(period: str) -> str:
    return f"WITH o AS (SELECT CAST(date_trunc('{period}', o_orderdate) AS DATE) AS period, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders) SELECT period, {_r('avg(label)', 'rate')}, {_n('count(*)', 'n')}, {_r('avg(label) - 1.96 * sqrt(avg(label) * (1 - avg(label)) / count(*))', 'low')}, {_r('avg(label) + 1.96 * sqrt(avg(label) * (1 - avg(label)) / count(*))', 'high')} FROM o GROUP BY period"


def _period(spark, sf_dir, period: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(reports.period_rate(orders, "o_orderdate", "label", period))


@_query(_period_sql("month"))
def monthly_rate(spark, sf_dir):
    return _period(spark, sf_dir, "month")


@_query(_period_sql("quarter"))
def quarterly_rate(spark, sf_dir):
    return _period(spark, sf_dir, "quarter")


@_query(_period_sql("week"))
def weekly_rate(spark, sf_dir):
    return _period(spark, sf_dir, "week")


@_query(f"WITH g AS ({_GAIN}), f AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(p_type, '{p}') THEN '{n}'" for n, p in _PARTS.items()) + f" ELSE 'other' END AS family, gain FROM g) SELECT family, {_n('count(*)', 'built')}, {_n('count(CASE WHEN gain > 0 THEN 1 END)', 'used')}, {_r('sum(gain) / (SELECT sum(gain) FROM g)', 'share')} FROM f GROUP BY family")
def importance_rollup(spark, sf_dir):
    return rounded(reports.importance_rollup(_gains(spark, sf_dir), "p_type", "gain", _PARTS))


@_query(f"WITH g AS ({_GAIN}), r AS (SELECT gain, row_number() OVER (ORDER BY gain DESC, p_partkey) AS k FROM g) SELECT CAST(t AS INT) AS top, {_r('sum(gain) / (SELECT sum(gain) FROM g)', 'share')} FROM r JOIN (VALUES (20), (100)) v(t) ON k <= t GROUP BY t")
def importance_top_share(spark, sf_dir):
    return rounded(reports.top_share(_gains(spark, sf_dir), "p_partkey", "gain"))


@_query(f"WITH l AS (SELECT event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT name, {_r('value', 'value')}, {_r('value - (SELECT value FROM l WHERE name = ' + chr(39) + 'click' + chr(39) + ')', 'delta')} FROM l")
def ledger_ablation(spark, sf_dir):
    return rounded(reports.ablation(_table(spark, sf_dir, "events"), "click", "event_type", "value", "event_id"))


@_query(f"SELECT 'mean' AS \"column\", {_r('max(abs(a.m - b.m))', 'difference')}, CAST(count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND (a.m IS NULL) <> (b.m IS NULL) THEN 1 END) AS BIGINT) AS one_null, CAST(count(CASE WHEN a.k IS NULL OR b.k IS NULL THEN 1 END) AS BIGINT) AS unmatched FROM (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def table_difference(spark, sf_dir):
    a, b = (_table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean")) for s in "FO")
    return rounded(reports.largest_difference(a, b, "o_custkey", ["mean"]))


@_query("WITH o AS (SELECT user_id % 3 = 0 AS other, CAST(user_id AS VARCHAR) AS u, event_type AS t FROM events), p AS (SELECT other, 'user_id' AS c, u AS v FROM o UNION ALL SELECT other, 'event_type', t FROM o) SELECT c AS \"column\", v AS value, CAST(count(*) AS BIGINT) AS n FROM p WHERE other AND NOT EXISTS (SELECT 1 FROM p q WHERE NOT q.other AND q.c = p.c AND q.v = p.v) GROUP BY ALL")
def unseen_categories(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    return reports.unseen_categories(rows.where("user_id % 3 <> 0"), rows.where("user_id % 3 = 0"), ["user_id", "event_type"])


@_query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 25)")
def top_orders(spark, sf_dir):
    return rounded(reports.top_n(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25))


@_query(f"WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, date_trunc('month', o_orderdate) AS m FROM orders) SELECT o_orderkey, round((rank() OVER (PARTITION BY m ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY m, o_totalprice) - 1) / 2.0) / count(*) OVER (PARTITION BY m), {DIGITS}) AS pct FROM o")
def monthly_pct_rank(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn("m", F.date_trunc("month", "o_orderdate"))
    return rounded(stats.ranks(orders, ["m"], "o_totalprice").select("o_orderkey", (F.col("rank") / F.col("n")).alias("pct")))


# ---- evaluation

_FOLD = "f AS (SELECT d.*, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1) % 5 AS fold FROM d)"


@_query(f"WITH {LABELLED}, {_FOLD} SELECT doc_id, label, CAST(fold AS INT) AS fold FROM f")
def stratified_folds(spark, sf_dir):
    return evaluation.stratified_folds(_labelled(spark, sf_dir), "doc_id", "label", 5, 42).select("doc_id", "label", F.col("fold").cast("int"))


def _nb_sql() -> str:
    long = " UNION ALL ".join(f"SELECT doc_id, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, fold FROM f" for f in _FEATURES)
    edges = ", ".join(f"quantile_cont(x, {i / 10})" for i in range(1, 10))
    return f"WITH {LABELLED}, {_FOLD}, l AS ({long}), q AS (SELECT feature, [{edges}] AS edges FROM l WHERE fold <> 0 GROUP BY feature), b AS (SELECT l.*, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e < x)) END AS bin FROM l JOIN q USING (feature)), base AS (SELECT avg(label) AS rate FROM f WHERE fold <> 0), o AS (SELECT feature, bin, (sum(label) + 200 * any_value(rate)) / (count(*) + 200) AS p, any_value(rate) AS rate FROM b, base WHERE fold <> 0 GROUP BY feature, bin) SELECT doc_id, round(sum(coalesce(ln(p / (1 - p)) - ln(rate / (1 - rate)), 0)), {DIGITS}) AS score FROM b LEFT JOIN o USING (feature, bin) WHERE fold = 0 GROUP BY doc_id"


@_query(_nb_sql())
def naive_bayes_bins(spark, sf_dir):
    rows = evaluation.stratified_folds(_labelled(spark, sf_dir), "doc_id", "label", 5, 42)
    return rounded(evaluation.naive_bayes_bins(rows.where("fold <> 0"), rows.where("fold = 0"), "doc_id", "label", list(_FEATURES)))


@_query(f"WITH {LABELLED}, c AS (SELECT a.n_chars, avg(CASE WHEN b.label = 0 THEN CAST(b.n_chars >= a.n_chars AS INT) END) AS f, avg(CASE WHEN b.label = 1 THEN CAST(b.n_chars >= a.n_chars AS INT) END) AS t FROM (SELECT DISTINCT n_chars FROM d) a CROSS JOIN d b GROUP BY 1) SELECT round(g / 200.0, {DIGITS}) AS fpr, round(coalesce((SELECT max(t) FROM c WHERE c.f <= g / 200.0 + 1e-12), 0), {DIGITS}) AS tpr FROM (SELECT unnest(range(0, 201)) AS g)")
def roc_grid(spark, sf_dir):
    return rounded(evaluation.roc_grid(_labelled(spark, sf_dir), "n_chars", "label"))


_RANKS = {f: f"(rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0)" for f in _FEATURES}


@_query(f"WITH {LABELLED} SELECT doc_id, {_r(' + '.join(f'{w} * {_RANKS[f]} / count(*) OVER ()' for f, w in zip(_FEATURES, (0.5, 0.3, 0.2), strict=True)), 'blend')} FROM d")
def rank_blend(spark, sf_dir):
    return rounded(evaluation.rank_blend(_labelled(spark, sf_dir), list(_FEATURES), [0.5, 0.3, 0.2]).select("doc_id", "blend"))


@_query(f"WITH {LABELLED} SELECT doc_id, {_r(_RANKS['n_chars'] + ' / (count(*) OVER () + 1)', 'score')} FROM d")
def rank01(spark, sf_dir):
    return rounded(evaluation.rank01(_labelled(spark, sf_dir), "n_chars", "score").select("doc_id", "score"))


@_query(f"WITH {LABELLED}, s AS (SELECT doc_id AS alert_id, n_chars / 1000.0 AS score FROM d WHERE doc_id % 7 <> 0) SELECT 'no_missing_id' AS check, (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT alert_id FROM s)) = 0 AS passed UNION ALL SELECT 'no_unknown_id', (SELECT count(*) FROM s WHERE alert_id NOT IN (SELECT doc_id FROM d)) = 0 UNION ALL SELECT 'no_repeated_id', (SELECT count(*) = count(DISTINCT alert_id) FROM s) UNION ALL SELECT 'finite', (SELECT count(*) FROM s WHERE score IS NULL) = 0 UNION ALL SELECT 'in_range', (SELECT count(*) FROM s WHERE score < 0 OR score > 1) = 0 UNION ALL SELECT 'distinct', (SELECT count(DISTINCT score) >= 0.95 * count(*) FROM s)")
def validator_checks(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    scores = rows.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("alert_id"), (F.col("n_chars") / 1000).alias("score"))
    return evaluation.check_submission(scores, rows.select(F.col("doc_id").alias("alert_id")))


@_query()
def logistic_cv(spark, sf_dir):
    return evaluation.fold_report(training.out_of_fold(_labelled(spark, sf_dir), "doc_id", "label", list(_FEATURES), k=3))


@_query()
def gbt_cv(spark, sf_dir):
    return evaluation.fold_report(training.out_of_fold(_labelled(spark, sf_dir), "doc_id", "label", list(_FEATURES), fit=training.boosted, k=3))


@_query()
def adversarial_drift(spark, sf_dir):
    """Can a model tell even from odd documents by their lengths? It shouldn't."""
    rows = _labelled(spark, sf_dir)
    return training.adversarial(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "doc_id", list(_FEATURES), k=3)


@_query()
def logistic_search(spark, sf_dir):
    """The better of two strengths, by out-of-fold AUC."""
    best, value = training.search(_labelled(spark, sf_dir), "doc_id", "label", list(_FEATURES), {"c": [0.005, 0.5]}, tries=2, folds=2)
    return spark.createDataFrame([(float(best["c"]), float(value))], "c double, auc double")


# ---- timelines in slices

_SLICE = 20


@_query(ORACLE_SQL["gaps"])
def sliced_gaps(spark, sf_dir):
    names = QUERIES["gaps"](spark, sf_dir).columns
    return rounded(slices.gaps(_history(spark, sf_dir), _SLICE).select(*names))


@_query(ORACLE_SQL["asof_passthrough"])
def sliced_passthrough(spark, sf_dir):
    return rounded(slices.passthrough(_history(spark, sf_dir), C, _SLICE))


@_query(ORACLE_SQL["last_vs_history"])
def sliced_last_vs_history(spark, sf_dir):
    names = ["tr_last_amt", "tr_last_minus_mean", "tr_last_z", "tr_last5_minus_mean", "tr_last20_minus_mean", "tr_last_amt_pct_rank", "tr_first_minus_last"]
    return rounded(slices.transitions(_history(spark, sf_dir), C, _SLICE).select("alert_id", *names))


@_query(ORACLE_SQL["velocity_max"])
def sliced_velocity_max(spark, sf_dir):
    return slices.transitions(_history(spark, sf_dir), C, _SLICE).select("alert_id", *(f"vel_max_{n}" for n, _ in C.velocities))


# ---- profiles and samples

_KINDS = {"orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "d", "o_orderpriority": "t"}, "customer": {"c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t"}}


def _profile_sql(table: str) -> str:
    number = {"n": "CAST({c} AS DOUBLE)", "t": "CAST(NULL AS DOUBLE)", "d": "epoch_us(CAST({c} AS TIMESTAMP)) / 1e6"}
    rows = " UNION ALL ".join(f"SELECT '{c}' AS col, {c if kind == 't' else 'CAST(NULL AS VARCHAR)'} AS text, {number[kind].format(c=c)} AS number FROM {table}" for c, kind in _KINDS[table].items())
    quantiles = ", ".join(f"round(quantile_cont(number, {q}), {DIGITS}) AS q{round(q * 100):02d}" for q in (0.25, 0.5, 0.75))
    return f"WITH c AS ({rows}), t AS (SELECT col, text, number, count(*) AS t FROM c WHERE text IS NOT NULL OR number IS NOT NULL GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY t DESC, text, number) AS k, count(*) OVER (PARTITION BY col) AS distinct_n FROM t), q AS (SELECT col, count(*) AS n, count(CASE WHEN text IS NULL AND number IS NULL THEN 1 END) AS nulls, round(min(number), {DIGITS}) AS min, {quantiles}, round(max(number), {DIGITS}) AS max FROM c GROUP BY col) SELECT q.col AS \"column\", CAST(n AS BIGINT) AS n, CAST(nulls AS BIGINT) AS nulls, CAST(coalesce(distinct_n, 0) AS BIGINT) AS \"distinct\", text AS top_text, round(number, {DIGITS}) AS top_number, CAST(t AS BIGINT) AS top_n, min, q25, q50, q75, max FROM q LEFT JOIN m ON m.col = q.col AND k = 1"


@_query(_profile_sql("orders"))
def profile_orders(spark, sf_dir):
    return rounded(profile.profile(_table(spark, sf_dir, "orders").select(*_KINDS["orders"])))


@_query(_profile_sql("customer"))
def profile_customer(spark, sf_dir):
    return rounded(profile.profile(_table(spark, sf_dir, "customer").select(*_KINDS["customer"])))


@_query("SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|7')) AS k FROM orders) WHERE k <= 50")
def seeded_sample(spark, sf_dir):
    """Fifty orders of each status, the same ones whatever the partitioning."""
    return profile.bottom_k(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 50, "o_orderkey", 7, ["o_orderstatus"])


@_query("WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS a, row_number() OVER (ORDER BY o_orderkey) - 1 AS b FROM orders) SELECT CAST(x.a AS BIGINT) AS row_idx FROM o x JOIN o y ON x.a = y.b WHERE x.o_orderkey <> y.o_orderkey")
def audit_sample_order(spark, sf_dir):
    """The positions at which orders by date and orders by key don't hold the same order."""
    orders = _table(spark, sf_dir, "orders")
    one = F.lit(1).alias("one")
    by_key = stats.running(orders.select("o_orderkey", one), [], "o_orderkey", ["one"]).select("o_orderkey", (F.col("upto_one") - 1).alias("row_idx"))
    date = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    dated = stats.running(orders.select("o_orderkey", (date * 1_000_000_000 + F.col("o_orderkey")).alias("at"), one), [], "at", ["one"]).select("o_orderkey", (F.col("upto_one") - 1).alias("row_idx"))
    return tables.misaligned(by_key, dated, "o_orderkey", "row_idx")


# ---- shuffles, blends and searches


@_query(f"WITH {LABELLED}, l AS (" + " UNION ALL ".join(f"SELECT label, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM d" for f in _FEATURES) + f") SELECT label, feature, CAST(count(*) AS BIGINT) AS n, CAST(count(x) AS BIGINT) AS known, CAST(count(DISTINCT x) AS BIGINT) AS \"distinct\", {_r('sum(x)', 'total')}, {_r('min(x)', 'least')}, {_r('max(x)', 'most')} FROM l GROUP BY label, feature")
def class_shuffle(spark, sf_dir):
    """Every column dealt anew within each class has the same values a class."""
    moved = training.shuffle_within(_labelled(spark, sf_dir).select("doc_id", "label", *_FEATURES), "doc_id", "label", list(_FEATURES))
    long = moved.unpivot(["label"], [F.col(f).cast("double").alias(f) for f in _FEATURES], "feature", "x")
    return rounded(long.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("known"), F.count_distinct("x").alias("distinct"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most")))


@_query()
def blend_overfit(spark, sf_dir):
    """AUC on held-out folds of fitted weights, of equal ones, and of each input alone."""
    rows = evaluation.stratified_folds(_labelled(spark, sf_dir), "doc_id", "label", 5, 42)
    found = training.blend_overfit(rows, list(_FEATURES), "label", rounds=8)
    return spark.createDataFrame(sorted(found.items()), "blend string, auc double")


@_query()
def adversarial_gains(spark, sf_dir):
    """Can boosted trees tell long documents' halves apart, and by which columns?"""
    rows = _labelled(spark, sf_dir).withColumn("late", F.col("doc_id").cast("double"))
    report, gains = training.adversarial_trees(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "doc_id", [*_FEATURES, "late"], k=2)
    return training.top_gains(gains).crossJoin(report.select("auc"))  # one row


@_query()
def guided_search(spark, sf_dir):
    """The best trial of a search for the strength of a regression and the number of its folds' features."""
    rows = evaluation.kept(evaluation.stratified_folds(_labelled(spark, sf_dir), "doc_id", "label", 2, 42))

    def value(options: dict, fold: int) -> float:
        features = list(_FEATURES)[: options["features"]]
        test = rows.where(F.col("fold") == fold)
        scored = training.logistic(rows.where(F.col("fold") != fold), test, "doc_id", "label", features, options["c"]).join(test.select("doc_id", "label"), "doc_id")
        return stats.auc(scored.select(F.lit("all").alias("feature"), "label", F.col("score").alias("x"))).first()["auc"] or 0.0

    found = tuning.guided_search(spark, {"c": ("log", 1e-3, 10.0), "features": ("int", 1, 3)}, value, 2, 6, starts=3)
    return tuning.best_trial(found)


@_query("SELECT c_custkey, CAST(substr(c_name, 10) AS INT) AS code, CAST(substr(c_name, 10) AS INT) = c_custkey AS agrees FROM customer")
def name_codes(spark, sf_dir):
    """The number that a customer's name ends with, and whether it is the key."""
    code = F.substring("c_name", 10, 2**31 - 1).cast("int")
    return _table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"), (code == F.col("c_custkey")).alias("agrees"))


@_query("SELECT " + ", ".join(f"CAST(count({c}) AS BIGINT) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem")
def matching_columns(spark, sf_dir):
    """Known values of the columns that a pattern takes and another leaves out."""
    rows = _table(spark, sf_dir, "lineitem")
    return rows.agg(*(F.count(c).alias(c) for c in reports.matching_columns(rows, "^l_(quantity|extended|discount|tax|ship)", "ship")))
