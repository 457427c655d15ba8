"""Ranks over whole tables, and training around Spark's learners, on small rows made by rule."""

import math
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alertloom.functions import stats
from alertloom.plans import reports, training


def test_ranks_equal_brute_force_with_nulls_nan_and_ties(spark):
    values = [None, 1.0, 1.0, -5.0, 0.0, -0.0, 1e9, 1e-9, float("nan"), float("inf"), 2.5, 2.5, 2.5, None]
    df = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(values)], "id long, g int, v double")
    place = lambda v: (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v + 0.0)
    for by in ([], ["g"]):
        for r in stats.ranks(df, by, "v").collect():
            peers = [place(v) for i, v in enumerate(values) if not by or i % 2 == r["g"]]
            mine = place(values[r["id"]])
            assert r["n"] == len(peers)
            assert r["rank"] == sum(p < mine for p in peers) + (peers.count(mine) + 1) / 2
    assert stats.ranks(df.limit(0), [], "v").count() == 0


def test_recode_is_strict(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r[0] for r in df.select(reports.recode("t", {"a": 3})).collect()] == [3, None]
    with pytest.raises(PySparkException):
        df.select(reports.recode("t", {"b": 1})).collect()


def test_normal_quantile(spark):
    ps = [0.001, 0.1, 0.5, 0.77, 0.999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").coalesce(1).select(training.normal_quantile(F.col("p"))).collect()]
    assert all(abs(a - statistics.NormalDist().inv_cdf(p)) < 5e-4 for a, p in zip(got, ps, strict=True))


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, int(i * 37 % 100 + i % 2 * 40 > 70), float(i * 37 % 100) if i % 11 else None, float(i % 2 * 40), float(i * 17 % 13)) for i in range(240)]
    return spark.createDataFrame(made, "id long, y int, a double, b double, noise double").repartition(2).cache()


def test_out_of_fold_logistic_and_selection(spark, rows):
    assert set(training.strongest(rows, "y", ["a", "b", "noise"], 2)) == {"a", "b"}
    oof = training.out_of_fold(rows, "id", "y", ["a", "b", "noise"], k=2, top=2).cache()
    assert oof.count() == 240 and oof.select("id").distinct().count() == 240
    report = training.repeat_report(oof).collect()
    assert len(report) == 1 and report[0]["auc"] > 0.85
    assert reports.oof_mean(oof, "id").count() == 240


def test_boosted_seeds_and_drift(spark, rows):
    scored = training.seed_average(rows, rows, "id", "y", ["a", "b"], seeds=(1, 2), rounds=3)
    long = scored.join(rows.select("id", "y"), "id").selectExpr("'m' AS feature", "y AS label", "score AS x")
    assert stats.auc(long).first()["auc"] > 0.9
    same = training.adversarial(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), "id", ["noise", "b"], k=2).first()
    assert 0.3 < same["auc"] < 0.7


def test_blend_overfit_and_search(spark, rows):
    oof = rows.withColumn("fold", F.col("id") % 2)
    found = training.blend_overfit(oof, ["b", "noise"], "y", k=2)
    assert set(found) == {"fitted", "equal", "b", "noise"} and found["fitted"] >= found["noise"]
    best, value = training.search(rows, "id", "y", ["a", "b"], {"c": [0.05, 0.5]}, tries=2, folds=2)
    assert best["c"] in (0.05, 0.5) and value > 0.5
