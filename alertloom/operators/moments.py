"""Counts, sums, moments and distinct days of every group that an alert's features are about, from one aggregation over its rows.

A row belongs to a cell: its type, its direction, the age bucket between neighbouring window bounds, and whether it is in the burst. A state holds what
can be merged: counts, sums of powers about a common centre, sums, extremes, and 64 days as bits. Rows are summed into states by alert, cell and block of 64 days. Which
groups (all, a type, a window, a type in a window, ...) a cell is part of is a table of a few thousand rows whose size the configuration fixes; joined
with it, states are merged by alert and group. So however many features there are, both aggregations have one expression for each part of a
state, and no row is looked at once a feature. Medians and quantiles can't be merged; they are taken of the few groups that need them.

A state is wider than a row, and where alerts have few rows there are nearly as many states as rows, each part of several groups. So narrow rows are shuffled
by alert once (``by_alert``), and all that follows stays where it is. Only for alerts too large for one task states are made before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .families import QUANTILES
from .prepare import ratio_sql

#: How two states become one.
MERGE = {"n": F.sum, "nx": F.sum, "nd": F.sum, "nt": F.sum, "ni": F.sum, "s1": F.sum, "s2": F.sum, "s3": F.sum, "s4": F.sum, "se": F.sum, "sf": F.sum, "g90": F.sum, "g99": F.sum, "l10": F.sum, "lo": F.min, "hi": F.max, "he": F.max, "oldest": F.max, "newest": F.min, "centre": F.max, "days": F.bit_or}

#: What is kept of a group: SQL over a merged state, with the mean ``a`` of the amounts less the centre and the sum of squares ``m2`` about it.
MEASURES = {"n": "n", "nt": "nt", "days": "days", "oldest": "oldest", "newest": "newest", "lo": "lo", "hi": "hi", "se": "se", "sf": "sf", "he": "he", "g99": "g99", "sum": "s1 + nx * centre", "mean": "centre + a", "e_mean": "se / nullif(nx, 0)", "std": "if(nx > 1, sqrt(m2 / (nx - 1)), NULL)", "skew": "if(hi > lo, sqrt(nx) * (s3 - 3 * a * s2 + 2 * a * a * s1) / power(m2, 1.5D), NULL)", "kurt": "if(hi > lo, nx * (s4 - 4 * a * s3 + 6 * a * a * s2 - 3 * a * a * a * s1) / (m2 * m2) - 3, NULL)", "in_share": "ni / nullif(nd, 0)", "p90": "g90 / nullif(nx, 0)", "p99": "g99 / nullif(nx, 0)", "p10": "l10 / nullif(nx, 0)"}


@dataclass
class Groups:
    """The cells of a configuration and the groups they are part of, for the families asked for."""

    config: EngineConfig
    families: tuple[str, ...]
    bounds: list[int] = field(init=False)
    number: dict[str, int] = field(init=False)
    parts: list[tuple[int, int]] = field(init=False)

    def __post_init__(self):
        c, self.number = self.config, {}
        self.bounds = sorted({w for base in c.windows for w in (base, 2 * base)} | set(c.shift_windows))
        self.parts = [(self._cell(t, d, b, inside), self.number.setdefault(name, len(self.number))) for inside in (0, 1) for t in range(len(c.types) + 1) for d in range(len(c.directions) + 1) for b in range(len(self.bounds) + 1) for name in dict.fromkeys(self._names(t, d, b, inside))]

    def _cell(self, t, d, b, inside):
        c = self.config
        return ((t * (len(c.directions) + 1) + d) * (len(self.bounds) + 1) + b) * 2 + inside

    def _names(self, t: int, d: int, b: int, inside: int) -> list[str]:
        """Types and directions count from 1; 0 is any other. Bucket b holds ages up to the bound b, above the one before."""
        c, until = self.config, self.bounds.index
        kinds = [c.types[t - 1]] * (t > 0)
        ways = [c.directions[d - 1]] * (d > 0)
        if inside:
            return [x for x in ("b", *(f"b_{k}" for k in kinds), *(f"b_{k}_{w}" for k in kinds for w in ways)) if "burst" in self.families]
        out = ["all"]
        if "agg" in self.families:
            out += [*ways, *kinds, *(f"{k}_{w}" for k in kinds for w in ways)]
        if "win" in self.families:
            for w in c.windows:
                if b <= until(w):
                    out += [f"w{w}", *(f"w{w}_{x}" for x in kinds), *(f"w{w}_out" for x in ways if x == "out")]
                elif b <= until(2 * w):
                    out.append(f"w{w}_prev")
        if "shift" in self.families:
            for w in c.shift_windows:
                p = "w" if b <= until(w) else "o"
                out += [f"{p}{w}", *(f"{p}{w}_{x}" for x in kinds if x in c.shift_types)]
        return out

    def cell(self) -> Column:
        """The cell of a prepared row."""
        c = self.config
        among = lambda names, x: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(x)), F.lit(0)).cast("int")
        bucket = sum((F.when(F.col("age") > b, 1).otherwise(0) for b in self.bounds), F.lit(0))
        return self._cell(among(c.types, "tx_type"), among(c.directions, "direction"), bucket, F.when(F.col("seconds") <= c.burst_seconds, 1).otherwise(0))

    def table(self, spark, only=None) -> DataFrame:
        """cell, grp: a row for each part a cell has in a group."""
        rows = [(c, g) for c, g in self.parts if only is None or g in only]
        return spark.createDataFrame(rows, "cell int, grp int")


def by_alert(prepared: DataFrame, groups: Groups) -> DataFrame:
    """The rows by alert, with their cell in place of what it is made of: e, flow, age and day follow from the amount and the seconds."""
    return prepared.select("alert_id", groups.cell().alias("cell"), "amount", "seconds", F.col("is_in").cast("byte").alias("is_in"), F.col("tx_type").isNotNull().alias("typed")).repartition("alert_id")


def with_derived(rows: DataFrame) -> DataFrame:
    """Rows of ``by_alert`` with the columns of prepared rows that states are made of."""
    rows = rows.withColumns({"age": F.col("seconds") / F.lit(86400.0), "e": F.exp("amount"), "is_in": F.col("is_in").cast("int"), "tx_type": F.when(F.col("typed"), F.lit(""))})
    return rows.withColumns({"day": F.floor("age").cast("int"), "flow": F.col("e") * (2 * F.col("is_in") - 1)})


def states(prepared: DataFrame, thresholds: DataFrame, groups: Groups) -> DataFrame:
    """alert_id, cell, block and a state: one aggregation over the rows, which may have their cell already."""
    if "cell" not in prepared.columns:
        prepared = prepared.withColumn("cell", groups.cell())
    rows = prepared.crossJoin(F.broadcast(thresholds))  # thresholds: one row
    x, day = F.col("amount"), F.col("day")
    centre = F.coalesce((F.col("p10") + F.col("p90")) / 2, F.lit(0.0))
    rows = rows.select("alert_id", "cell", (day / 64).cast("int").alias("block"), F.expr("shiftleft(1L, day % 64)").alias("bit"), "amount", (x - centre).alias("v"), "e", "flow", "is_in", "tx_type", "age", centre.alias("centre"), *(c.cast("int").alias(n) for n, c in (("a90", x > F.col("p90")), ("a99", x > F.col("p99")), ("b10", x < F.col("p10")))))
    v = F.col("v")
    parts = {"n": F.count(F.lit(1)), "nx": F.count("amount"), "nd": F.count("is_in"), "nt": F.count("tx_type"), "ni": F.sum("is_in"), "s1": F.sum(v), "s2": F.sum(v * v), "s3": F.sum(v * v * v), "s4": F.sum(v * v * v * v), "se": F.sum("e"), "sf": F.sum("flow"), "g90": F.sum("a90"), "g99": F.sum("a99"), "l10": F.sum("b10"), "lo": F.min("amount"), "hi": F.max("amount"), "he": F.max("e"), "oldest": F.max("age"), "newest": F.min("age"), "centre": F.max("centre"), "days": F.bit_or("bit")}
    return rows.groupBy("alert_id", "cell", "block").agg(*(p.alias(n) for n, p in parts.items()))


def merged(found: DataFrame, groups: Groups) -> DataFrame:
    """alert_id, grp and the measures of each group: the states of its cells made one, and what follows from them."""
    parts = found.join(F.broadcast(groups.table(found.sparkSession)), "cell")
    blocks = parts.groupBy("alert_id", "grp", "block").agg(*(f(n).alias(n) for n, f in MERGE.items()))
    whole = blocks.groupBy("alert_id", "grp").agg(*(f(n).alias(n) for n, f in MERGE.items() if n != "days"), F.sum(F.bit_count("days")).alias("days"))
    varies = "hi > lo"
    whole = whole.selectExpr("*", "s1 / nullif(nx, 0) AS a", f"if({varies}, greatest(s2 - s1 * s1 / nx, 0D), 0D) AS m2")
    return whole.selectExpr("alert_id", "grp", *(f"{x} AS {n}" for n, x in MEASURES.items()))


def _dense(rows: DataFrame, value: Column, size: int, name: str) -> DataFrame:
    """alert_id and an array with the value of each group at its number, null where there is none."""
    by = rows.groupBy("alert_id").agg(F.map_from_entries(F.collect_list(F.struct("grp", value.alias("value")))).alias("by"))
    return by.select("alert_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.try_element_at("by", k)).alias(name))


def quantiles_of(prepared: DataFrame, groups: Groups) -> DataFrame:
    """alert_id and ``q``: exact quantiles of the groups that need medians."""
    c = groups.config
    wanted = {groups.number[n] for n in ("all", *c.directions, *c.types, "b") if n in groups.number}
    rows = prepared.select("alert_id", groups.cell().alias("cell"), "amount").repartition("alert_id").join(F.broadcast(groups.table(prepared.sparkSession, wanted)), "cell")
    found = rows.groupBy("alert_id", "grp").agg(F.percentile("amount", F.array(*map(F.lit, QUANTILES))).alias("v"))
    return _dense(found, F.col("v"), len(groups.number), "q")


class State:
    """SQL over the state of one group, which is much faster to plan than columns; without rows its counts and totals are 0 and all else is null."""

    def __init__(self, groups: Groups, name: str):
        k = groups.number.get(name)
        self.row, self.q = ("CAST(NULL AS DOUBLE)", "CAST(NULL AS ARRAY<DOUBLE>)") if k is None else (f"g[{k}]", f"q[{k}]")
        self.known = k is not None

    def __getattr__(self, part: str) -> str:
        return f"{self.row}.{part}" if self.known else self.row

    def count(self, part: str = "n") -> str:
        return f"CAST(coalesce({getattr(self, part)}, 0) AS BIGINT)"

    def total(self, part: str) -> str:
        return f"coalesce({getattr(self, part)}, 0D)"

    @property
    def med(self) -> str:
        return f"{self.q}[{QUANTILES.index(0.5)}]"

    def block(self, prefix: str) -> dict[str, str]:
        return {f"{prefix}_n": self.count(), f"{prefix}_sum": self.total("sum"), f"{prefix}_mean": self.mean, f"{prefix}_std": self.std, f"{prefix}_max": self.hi, f"{prefix}_min": self.lo, f"{prefix}_med": self.med}


def _aggregates(groups: Groups) -> dict[str, str]:
    c, a = groups.config, State(groups, "all")
    out = {"n_tx": a.n, "active_days": a.days, "first_age": a.oldest, "last_age": a.newest, "amt_mean": a.mean, "amt_std": a.std, "amt_min": a.lo, "amt_max": a.hi, "amt_skew": a.skew, "amt_kurt": a.kurt, "amtx_sum": a.se, "amtx_mean": a.e_mean, "net_flow": a.sf, "share_gt_p90": a.p90, "share_gt_p99": a.p99, "n_gt_p99": a.count("g99"), "share_lt_p10": a.p10, "in_share": a.in_share}
    out |= {f"amt_q{round(q * 100):02d}": f"{a.q}[{k}]" for k, q in enumerate(QUANTILES)}
    for d in c.directions:
        s = State(groups, d)
        out |= s.block(d) | {f"{d}_amtx_sum": s.total("se"), f"{d}_amtx_max": s.he}
    for t in c.types:
        s = State(groups, t)
        out |= s.block(t) | {f"{t}_amtx_sum": s.total("se"), f"{t}_share": ratio_sql(s.count(), a.nt), f"{t}_days": s.count("days"), f"{t}_last_age": s.newest}
        for d in c.directions:
            s = State(groups, f"{t}_{d}")
            out |= {f"{t}_{d}_n": s.count(), f"{t}_{d}_amtx_sum": s.total("se"), f"{t}_{d}_mean": s.mean, f"{t}_{d}_max": s.hi}
    return out


def _windows(groups: Groups) -> dict[str, str]:
    a = State(groups, "all")
    out = {"_n": a.n, "_e": a.se, "_age": a.oldest}
    for w in groups.config.windows:
        p = f"w{w}"
        now, before, outgoing = State(groups, p), State(groups, f"{p}_prev"), State(groups, f"{p}_out")
        out |= {f"{p}_n": now.count(), f"{p}_prev_n": before.count(), f"{p}_amtx_sum": now.total("se"), f"{p}_prev_amtx_sum": before.total("se"), f"{p}_amt_mean": now.mean, f"{p}_amt_max": now.hi, f"{p}_net_flow": now.total("sf"), f"{p}_in_share": now.in_share, f"{p}_out_n": outgoing.count(), f"{p}_out_amtx_sum": outgoing.total("se"), f"{p}_active_days": now.count("days")}
        out |= {f"{p}_{t}_n": State(groups, f"{p}_{t}").count() for t in groups.config.types}
    return out


def _burst(groups: Groups) -> dict[str, str]:
    c, b = groups.config, State(groups, "b")
    out = {"b_n": b.n, "b_amt_mean": b.mean, "b_amt_std": b.std, "b_amt_max": b.hi, "b_amt_min": b.lo, "b_amt_med": b.med, "b_amtx_sum": b.se, "b_net_flow": b.sf, "b_in_share": b.in_share}
    for t in c.types:
        s = State(groups, f"b_{t}")
        out |= {f"b_{t}_n": s.count(), f"b_{t}_mean": s.mean, f"b_{t}_max": s.hi}
        for d in c.directions:
            s = State(groups, f"b_{t}_{d}")
            out |= {f"b_{t}_{d}_n": s.count(), f"b_{t}_{d}_mean": s.mean}
    return out


def _shift(groups: Groups) -> dict[str, str]:
    out = {}
    for w in groups.config.shift_windows:
        now, old = State(groups, f"w{w}"), State(groups, f"o{w}")
        out |= {f"sh{w}_amt_mean": f"{now.mean} - {old.mean}", f"sh{w}_amt_std": f"{now.std} - {old.std}", f"sh{w}_in_share": f"{now.in_share} - {old.in_share}"}
        for t in groups.config.shift_types:
            x, y = State(groups, f"w{w}_{t}"), State(groups, f"o{w}_{t}")
            out |= {f"sh{w}_{t}_amt_mean": f"{x.mean} - {y.mean}", f"sh{w}_{t}_share": f"{ratio_sql(x.count(), now.nt)} - {ratio_sql(y.count(), old.nt)}"}
    return out


#: The columns of a family that come from states, and the group without which an alert has none of them.
FAMILIES = {"agg": (_aggregates, "all"), "win": (_windows, "all"), "burst": (_burst, "b"), "shift": (_shift, "all")}


def features(prepared: DataFrame, thresholds: DataFrame, config: EngineConfig, families: tuple[str, ...], derived: dict, large: bool = False) -> tuple[DataFrame, dict[str, list[str]]]:
    """alert_id and a struct for each of ``families``, and the structs' columns. ``derived``: what follows from a family's columns. ``large``: alerts may be too large for one task."""
    groups = Groups(config, families)
    rows = prepared if large else with_derived(by_alert(prepared, groups))
    g = _dense(merged(states(rows, thresholds, groups), groups), F.struct(*MEASURES), len(groups.number), "g")
    rows = g.join(quantiles_of(prepared, groups), "alert_id", "left")
    base = {f: FAMILIES[f][0](groups) for f in families}
    more = {f: derived[f](config) if f in derived else {} for f in families}
    has = {f: f"{State(groups, FAMILIES[f][1]).n} IS NOT NULL AS _has_{f}" for f in families}
    rows = rows.selectExpr("alert_id", *has.values(), *(f"{x} AS `{n}`" for f in families for n, x in base[f].items()))
    if any(more.values()):
        rows = rows.selectExpr("*", *(f"{x} AS `{n}`" for f in families for n, x in more[f].items()))
    columns = {f: [n for n in (*base[f], *more[f]) if n[0] != "_"] for f in families}
    return rows.selectExpr("alert_id", *(f"if(_has_{f}, struct({', '.join(f'`{n}`' for n in columns[f])}), NULL) AS m_{f}" for f in families)), columns
