"""The whole feature matrix from alerts and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.kept import kept
from ..operators import families as f
from ..operators import moments, slices
from ..operators.prepare import derived, is_count, prepare, split_burst
from ..operators.reference import global_thresholds, type_edges

DEFAULT = ("agg", "win", "lastk", "hist", "burst")
OPTIONAL = ("time", "pt", "trans", "shift", "calendar")


def dealt(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """The prepared rows, written once without what follows from them: every family and the reference statistics read from there the columns they need."""
    rows = prepare(tx, alerts)
    made = {"alert_id", "tx_id", "tx_ts", "direction", "tx_type", "amount", "alert_date", "seconds"}
    return derived(kept(rows.select(*(c for c in rows.columns if c in made)))).select(*rows.columns)


def fit_reference(prepared: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(thresholds, edges) from the prepared rows of one split, for use on any split."""
    history, _ = split_burst(prepared, config)
    return global_thresholds(history), type_edges(history)


def build_features(prepared: DataFrame, alerts: DataFrame, config: EngineConfig, reference: tuple[DataFrame, DataFrame], families: tuple[str, ...] = DEFAULT, digits: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """One row for each alert, with or without transactions; all measures are doubles, rounded to ``digits`` if given.

    ``prepared``: see ``dealt``. Families of counts, sums and moments come from one aggregation (see ``moments``), the others
    from one or two each, over rows shuffled by alert once. They are joined as one struct each, so that no join copies hundreds of columns, and taken apart once. With ``slice_rows``,
    what looks along timelines does so in slices of so many rows (see ``slices``): for data with alerts too large for one task.
    """
    history, _ = split_burst(prepared, config)
    thresholds, edges = reference
    made = {
        "lastk": lambda: [f.last_k(history, config)],
        "hist": lambda: [f.amount_histogram(history, edges, config)],
        "time": lambda: [f.activity(history, config), slices.gaps(history, slice_rows) if slice_rows else f.gaps(history), f.daily(history)],
        "pt": lambda: [slices.passthrough(history, config, slice_rows) if slice_rows else f.passthrough(history, config)],
        "trans": lambda: [slices.transitions(history, config, slice_rows) if slice_rows else f.transitions(history, config)],
        "calendar": lambda: [f.calendar(alerts)],
    }
    frames = [frame for name in families if name in made for frame in made[name]()]
    summed = tuple(name for name in families if name in moments.FAMILIES)
    joined, place = alerts.select("alert_id"), {}
    if summed:
        found, columns = moments.features(prepared, thresholds, config, summed, {"agg": f.aggregates_derived, "win": f.windows_derived}, bool(slice_rows))
        joined = joined.join(found, "alert_id", "left")
        place |= {c: f"m_{name}.{c}" for name in summed for c in columns[name]}
    for k, frame in enumerate(frames):
        names = [c for c in frame.columns if c != "alert_id"]
        place |= {c: f"f{k}.{c}" for c in names}
        joined = joined.join(frame.selectExpr("alert_id", f"struct({', '.join(f'`{c}`' for c in names)}) AS f{k}"), "alert_id", "left")
    if {"agg", "burst"} <= set(families):
        relative = f.burst_relative(config, lambda c: F.col(place[c]))
        joined = joined.withColumn("relative", F.struct(*(x.alias(c) for c, x in relative.items())))
        place |= {c: f"relative.{c}" for c in relative}

    def measure(c: str) -> str:
        x = f"CAST({place[c]} AS DOUBLE)"
        x = f"coalesce({x}, 0D)" if is_count(c) else x
        return f"{x if digits is None else f'round({x}, {digits})'} AS `{c}`"

    return joined.selectExpr("alert_id", *map(measure, place))
