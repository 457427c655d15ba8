"""Properties of the feature matrix, and small cases computed by hand."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.config import EngineConfig
from alertloom.functions import stats
from alertloom.operators import families
from alertloom.operators.prepare import prepare, split_burst
from alertloom.plans import evaluation
from alertloom.plans.features import DEFAULT, OPTIONAL, build_features, dealt, fit_reference

C = EngineConfig(types=("card", "transfer", "cash", "intl"), windows=(1, 3), shift_windows=(1,), last_k=3, burst_seconds=300, trends=(30,))
DATE = datetime(2024, 1, 20)
TX = "alert_id string, tx_ts timestamp_ntz, direction string, tx_type string, amount double"


def table(spark, rows):
    return spark.createDataFrame([(a, DATE - timedelta(seconds=s), d, t, float(x)) for a, s, d, t, x in rows], TX)


def alerts(spark, *ids):
    return spark.createDataFrame([(i, DATE) for i in ids], "alert_id string, alert_date timestamp_ntz")


ROWS = [("a", 100, "out", "cash", 0.5), ("a", 3700, "in", "card", 1), ("a", 7300, "out", "intl", 2), ("a", 7300, "in", "card", 2), ("a", 200000, "in", "transfer", 3), ("b", 90000, "out", "cash", -1)]


def features(spark, rows, ids=("a", "b", "none")):
    tx, al = table(spark, rows), alerts(spark, *ids)
    reference = fit_reference(dealt(table(spark, ROWS), alerts(spark, "a", "b", "none")), C)
    return {r["alert_id"]: r.asDict() for r in build_features(dealt(tx, al), al, C, reference, DEFAULT + OPTIONAL).collect()}


def same(x, y):
    return x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12))


def test_nothing_at_or_after_the_alert_changes_a_feature(spark):
    later = [("a", -h * 3600, "out", "intl", 6.5) for h in (0, 1, 30, 480)]
    x, y = features(spark, ROWS), features(spark, ROWS + later)
    assert all(same(x[k][c], y[k][c]) for k in x for c in x[k] if c != "alert_id")


def test_order_of_rows_and_of_alerts_does_not_matter(spark):
    x, y = features(spark, ROWS), features(spark, ROWS[::-1], ("none", "b", "a"))
    assert all(same(x[k][c], y[k][c]) for k in x for c in x[k] if c != "alert_id")


def test_whole_seconds_decide(spark):
    tx = spark.createDataFrame([("a", DATE - timedelta(milliseconds=m), "in", "card", 1.0) for m in (500, 1000, 0, -3600000)], TX)
    assert [r["seconds"] for r in prepare(tx, alerts(spark, "a")).collect()] == [1]


def test_alerts_without_history_count_zero_and_know_nothing(spark):
    r = features(spark, ROWS)["none"]
    assert r["n_tx"] == 0 and r["cash_n"] == 0 and r["w1_vs_prev_n"] == 0 and r["amt_mean"] is None and r["cash_sum"] is None


def test_values_by_hand(spark):
    r = features(spark, ROWS)["a"]
    assert (r["n_tx"], r["b_n"], r["in_n"], r["card_n"], r["cash_n"]) == (4, 1, 3, 2, 0)
    assert r["cash_sum"] == 0 and r["cash_mean"] is None and r["pt_out_n"] == 1 and r["pt_lag_med"] == 0
    assert (r["last0_amt"], r["last1_in"], r["last2_in"], r["last0_type"]) == (1, 1, 0, 0)
    assert r["vel_max_1h"] == 2
    assert r["tr_last_amt_pct_rank"] == 0.25


def test_velocity_frame_is_open_at_its_start(spark):
    tx = table(spark, [("a", 10000 - s, "in", "card", 1) for s in (0, 3599, 3600)])
    h, _ = split_burst(prepare(tx, alerts(spark, "a")), C)
    assert families.transitions(h, C).first()["vel_max_1h"] == 2


def test_bins_are_right_closed(spark):
    edges = spark.createDataFrame([("card", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])], "tx_type string, edges array<double>")
    h, _ = split_burst(prepare(table(spark, [("a", 1000, "in", "card", x) for x in (1, 1.5, 2, 9)]), alerts(spark, "a")), C)
    r = families.amount_histogram(h, edges, C).first()
    assert (r["card_bin0_n"], r["card_bin1_n"], r["card_bin7_n"], r["card_bin1_frac"], r["cash_bin0_frac"]) == (1, 2, 1, 0.5, None)


def test_unknown_types_are_errors(spark):
    h, _ = split_burst(prepare(table(spark, [("a", 1000, "in", "other", 1)]), alerts(spark, "a")), C)
    with pytest.raises(Exception, match="unknown type"):
        families.last_k(h, C).collect()


def test_auc_with_ties(spark):
    long = spark.createDataFrame([("f", 0, 1.0), ("f", 1, 1.0), ("f", 0, 2.0), ("f", 1, 2.0), ("f", 1, 3.0)], "feature string, label int, x double")
    assert stats.auc(long).first()["auc"] == pytest.approx(2 / 3)
    ranks = sorted(r[0] for r in long.select(families.average_rank(["feature"], "x")).collect())
    assert ranks == [1.5, 1.5, 3.5, 3.5, 5]


def test_moments(spark):
    r = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 9, 4)], "x double").agg(F.skewness("x"), F.kurtosis("x")).first()
    assert r[0] == pytest.approx(1.0391889224) and r[1] == pytest.approx(-0.3312254225)


@pytest.mark.parametrize(("data", "name", "wrong"), [
    (b"alert_id,score\na,0.5\n", "team_1.csv", []),
    (b"\xef\xbb\xbfalert_id,score\na,0.5\n", "team_1.csv", ["byte order mark"]),
    (b"id,score\na,0.5\n", "team_1.csv", ["header"]),
    (b"alert_id,score\na,0.5\n", "team 1.txt", ["file name"]),
    (b"alert_id,score\n0,a,0.5\n", "team_1.csv", ["fields"]),
    (b"alert_id,score\na,nan\n", "team_1.csv", ["number"]),
    (b'alert_id,score\n"a",0.5\n', "team_1.csv", ["quotes"]),
])
def test_submission_bytes(data, name, wrong):
    assert evaluation.check_submission_file(data, name) == wrong


@pytest.mark.parametrize(("rows", "failed"), [
    ([("a", 0.1), ("b", 0.2)], set()),
    ([("a", 0.1)], {"no_missing_id"}),
    ([("a", 0.1), ("b", 0.2), ("b", 0.3)], {"no_repeated_id"}),
    ([("a", 0.1), ("b", 0.2), ("c", 0.3)], {"no_unknown_id"}),
    ([("a", 0.1), ("b", 1.2)], {"in_range"}),
    ([("a", None), ("b", 0.2)], {"finite", "distinct"}),
    ([("a", 0.2), ("b", 0.2)], {"distinct"}),
])
def test_submission_rows(spark, rows, failed):
    found = evaluation.check_submission(spark.createDataFrame(rows, "alert_id string, score double"), spark.createDataFrame([("a",), ("b",)], "alert_id string"))
    assert {r["check"] for r in found.collect() if not r["passed"]} == failed


def test_stream_of_velocity(spark, tmp_path):
    from alertloom.streaming.velocity import replay

    rows = [(1, DATE - timedelta(minutes=m)) for m in (0, 10, 5000)] + [(2, DATE + timedelta(days=9))]
    schema = "user_id long, ts timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = replay(spark, f"{tmp_path}/in", schema, f"{tmp_path}/check", f"{tmp_path}/out", "*.parquet")
    assert out.where("alert_id = 1").agg(F.max("n")).first()[0] == 2


def test_sequences_hold_the_last_transactions_with_the_burst(spark):
    length, rows = 4, ROWS + [("a", 100, "in", "card", 7), ("c", 200, "in", "cash", 4)]
    got = {r["alert_id"]: r["sequence"] for r in families.sequences(prepare(table(spark, rows), alerts(spark, "a", "b", "c", "none")), alerts(spark, "a", "b", "c", "none"), C, length).collect()}
    assert set(got) == {"a", "b", "c", "none"}
    for alert, sequence in got.items():
        mine = sorted((-s, d, t, x, s) for a, s, d, t, x in rows if a == alert)
        steps = []
        for k, (_, d, t, x, s) in enumerate(mine):
            at, gap = DATE - timedelta(seconds=s), (mine[k - 1][4] - s) / 3600 if k else 0
            turn = at.hour * 2 * math.pi / 24
            steps.append((s, d, t, x, [1, *(t == y for y in C.types), d == "in", x, math.log1p(s / 86400) / 5.2, math.log1p(gap) / 5, math.sin(turn), math.cos(turn), at.weekday() >= 5, s <= C.burst_seconds]))
        last = sorted(steps)[:length][::-1]
        want = [[0] * 13] * (length - len(last)) + [y[4] for y in last]
        assert len(sequence) == length and all(len(y) == 13 for y in sequence)
        assert sequence == [pytest.approx([float(v) for v in y], abs=1e-6) for y in want]


def test_states_are_not_shuffled(spark):
    """States outnumber rows once each is part of several groups: only narrow rows are dealt, by alert."""
    import re

    rows = dealt(table(spark, ROWS), alerts(spark, "a", "b", "none"))
    plan = build_features(rows, alerts(spark, "a", "b", "none"), C, fit_reference(rows, C))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(alert_id#\d+, (grp|cell|slot|tx_type)", plan)


def test_alerts_in_slices_have_the_same_states(spark):
    tx, al = table(spark, ROWS), alerts(spark, "a", "b", "none")
    rows = dealt(tx, al)
    x, y = ({r["alert_id"]: r.asDict() for r in build_features(rows, al, C, fit_reference(rows, C), slice_rows=n).collect()} for n in (None, 2))
    assert all(same(x[k][c], y[k][c]) for k in x for c in x[k])
