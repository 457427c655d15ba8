"""Timelines in slices against the plain way."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.config import EngineConfig
from alertloom.operators import families, slices
from alertloom.operators.prepare import prepare, split_burst

C = EngineConfig(types=("card", "transfer", "cash", "intl"), windows=(1, 3), shift_windows=(1,), last_k=3, burst_seconds=300, trends=(30,))
DATE = datetime(2024, 1, 20)


@pytest.fixture(scope="module")
def history(spark):
    """One alert with 100,000 transactions, many at the same second, and some with few."""
    n = 100_000
    rows = spark.range(n + 200).select(F.when(F.col("id") < n, F.lit("huge")).otherwise(F.concat(F.lit("a"), F.col("id") % 7)).alias("alert_id"), F.abs(F.xxhash64("id")).alias("h"))
    back = F.when(F.col("h") % 3 == 0, F.col("h") % 3_000_000).when(F.col("h") % 3 == 1, 700_000 + F.col("h") % 9_000).otherwise(700_123)
    tx = rows.select("alert_id", (F.lit(DATE).cast("timestamp_ntz") - F.make_dt_interval(secs=(back + 400).cast("decimal(18,6)"))).alias("tx_ts"), F.when(F.col("h") % 11 < 4, "in").otherwise("out").alias("direction"), F.get(F.array(*map(F.lit, C.types)), (F.shiftright("h", 9) % 4).cast("int")).alias("tx_type"), (F.shiftright("h", 14) % 400 / 100).alias("amount"))
    alerts = spark.createDataFrame([(a, DATE) for a in ("huge", *(f"a{k}" for k in range(7)))], "alert_id string, alert_date timestamp_ntz")
    found, _ = split_burst(prepare(tx, alerts), C)
    return found.cache()


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    found = {r["alert_id"]: r for r in got.collect()}
    rows = want.collect()
    assert len(found) == len(rows) == 8
    for r in rows:
        for c in want.columns:
            x, y = found[r["alert_id"]][c], r[c]
            assert x == y or (isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (r["alert_id"], c, x, y)


def test_gaps(history):
    same(slices.gaps(history, 5000), families.gaps(history))


def test_passthrough(history):
    same(slices.passthrough(history, C, 5000), families.passthrough(history, C))


def test_transitions_and_velocity(history):
    same(slices.transitions(history, C, 5000), families.transitions(history, C))


def test_no_slice_is_larger_than_its_size_and_a_unit(history):
    points = slices.with_slices(history.select("alert_id", *slices.ORDER, F.expr(slices.MICROS).alias("us")), 5000)
    units = points.groupBy("alert_id", F.floor(F.col("us") / slices.UNIT)).count().agg(F.max("count")).first()[0]
    parts = points.groupBy("alert_id", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("a"), F.max("us").alias("b")).orderBy("alert_id", "slice").collect()
    assert max(r["n"] for r in parts) < 5000 + units and sum(r["n"] for r in parts) == history.count() and len([r for r in parts if r["alert_id"] == "huge"]) > 5
    assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:], strict=False) if x["alert_id"] == y["alert_id"])
