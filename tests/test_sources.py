"""Readers and sinks: one named file each, round trips, and a cache that follows its inputs."""

import pytest

from alertloom.functions import stats
from alertloom.plans import evaluation
from alertloom.sources import tables


def test_scores_are_one_named_file_with_line_feeds(spark, tmp_path):
    rows = [("b", 0.25), ("a", 1 / 3), ("c", 0.123456789)]
    scores = spark.createDataFrame(rows, "alert_id string, score double")
    path = f"{tmp_path}/team_1.csv"
    tables.write_scores_csv(scores, path, "alert_id")
    with open(path, "rb") as f:
        data = f.read()
    assert data == b"alert_id,score\na,0.33333333\nb,0.25000000\nc,0.12345679\n"
    assert evaluation.check_submission_file(data, "team_1.csv") == []
    back = tables.read_scores_csv(spark, path)
    assert [r[0] for r in evaluation.rank01(back, "score", "r").orderBy("r").collect()] == [r[0] for r in sorted(rows, key=lambda r: r[1])]
    tables.write_scores_csv(scores.limit(1), path, "alert_id")
    assert tables.read_scores_csv(spark, path).count() == 1


def test_ledger_keeps_the_last_entry_of_a_name(spark, tmp_path):
    for ts, value in ((1, 0.5), (2, 0.6)):
        tables.append_ledger(spark.createDataFrame([("x", ts, value)], "name string, ts long, auc double"), f"{tmp_path}/ledger")
    assert [(r["name"], r["auc"]) for r in tables.read_ledger(spark, f"{tmp_path}/ledger").collect()] == [("x", 0.6)]


def test_readers(spark, tmp_path):
    (tmp_path / "alerts.csv").write_text("alert_id,alert_date,label\n007,2024-02-03,1\n")
    row = tables.read_alerts_csv(spark, f"{tmp_path}/alerts.csv").first()
    assert (row["alert_id"], str(row["alert_date"]), row["label"]) == ("007", "2024-02-03 00:00:00", 1)
    (tmp_path / "importance.csv").write_text("feature,gain\namt_mean,3.5\n")
    assert [tuple(r) for r in tables.read_importance_csv(spark, f"{tmp_path}/importance.csv").collect()] == [("amt_mean", 3.5)]
    (tmp_path / "c.json").write_text('{"seed": 7, "families": ["agg"]}')
    assert tables.read_config(spark, f"{tmp_path}/c.json") == {"seed": 7, "families": ["agg"]}
    tables.write_json(spark, {"b": 1.5, "a": [1]}, f"{tmp_path}/out.json")
    assert tables.read_config(spark, f"{tmp_path}/out.json") == {"a": [1], "b": 1.5}


def test_cache_follows_families_and_data(spark, tmp_path):
    built = []

    def features(rows, families):
        df = spark.createDataFrame(rows, "id long, x double")
        return sorted(r["x"] for r in tables.cached_features(spark, str(tmp_path), families, [df], lambda: built.append(1) or df).collect())

    assert features([(1, 1.0)], ("agg",)) == features([(1, 1.0)], ("agg",)) == [1.0] and len(built) == 1
    assert features([(1, 1.0)], ("agg", "win")) == [1.0] and len(built) == 2
    assert features([(1, 2.0)], ("agg",)) == [2.0] and len(built) == 3


def test_no_id_leaves(spark):
    tables.assert_private(spark.createDataFrame([("safe", 1)], "t string, n long"), r"A\d{4}")
    with pytest.raises(ValueError, match="id"):
        tables.assert_private(spark.createDataFrame([("see A1234", 1)], "t string, n long"), r"A\d{4}")


def test_positions_that_differ(spark):
    a, b = (spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos long, id string") for ids in ("abcd", "abdc"))
    assert sorted(r["pos"] for r in tables.misaligned(a, b, "id", "pos").collect()) == [2, 3]
    assert tables.misaligned(a, a, "id", "pos").count() == 0




def test_quantiles_with_an_outlier_and_hot_values(spark):
    import numpy as np

    x = [1e300, -1e300, *np.random.default_rng(1).normal(size=500).tolist(), *([0.5] * 300)]
    df = spark.createDataFrame([("a" if i % 2 else None, v) for i, v in enumerate(x)] + [("a", None)], "g string, x double")
    for group, values in (("a", x[1::2]), (None, x[::2])):
        got = [r for r in stats.quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 0.99, 1.0]).collect() if r["g"] == group][0]
        assert got["n"] == len(values) and got["q"] == pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 0.99, 1.0]).tolist())
    steps = stats.running(df.where("x is not null").groupBy("x").count(), [], "x", ["count"], 16)
    assert steps.agg({"upto_count": "max"}).first()[0] == len(x)
