"""Profiles, samples, searches, blends and shuffles against brute force."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.functions import profile, stats
from alertloom.plans import evaluation, training, tuning
from alertloom.sources import tables


def test_profile_of_any_types(spark):
    rows = [(1, "a", 1.5, True, [1], None), (2, "b", None, False, [1], None), (2, "b", 2.5, None, None, None), (None, "", 2.5, True, [2], None)]
    df = spark.createDataFrame(rows, "k int, s string, x double, b boolean, l array<int>, z string")
    got = {r["column"]: r.asDict() for r in profile.profile(df).collect()}
    assert {c: (r["n"], r["nulls"], r["distinct"]) for c, r in got.items()} == {"k": (4, 1, 2), "s": (4, 0, 3), "x": (4, 1, 2), "b": (4, 1, 2), "l": (4, 1, 2), "z": (4, 4, 0)}
    assert (got["k"]["top_number"], got["k"]["top_n"], got["s"]["top_text"], got["b"]["top_number"], got["z"]["top_n"]) == (2, 2, "b", 1, None)
    assert (got["x"]["min"], got["x"]["q25"], got["x"]["q50"], got["x"]["max"]) == (1.5, 2.0, 2.5, 2.5) and got["s"]["q50"] is None
    assert profile.profile(df.where("k > 9")).count() == 0


def test_bottom_k_is_the_same_for_any_partitioning(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    want = {r["id"] for r in profile.bottom_k(df, 10, "id", 5).collect()}
    assert len(want) == 10 and {r["id"] for r in profile.bottom_k(df.repartition(7), 10, "id", 5).collect()} == want != {r["id"] for r in profile.bottom_k(df, 10, "id", 6).collect()}
    groups = [r["g"] for r in profile.bottom_k(df.repartition(5), 4, "id", 5, ["g"]).collect()]
    assert sorted(groups) == [0] * 4 + [1] * 4 + [2] * 4 and profile.bottom_k(df, 2000, "id", 5).count() == 1000


def test_running_in_steps_equals_one_step(spark, monkeypatch):
    random.seed(3)
    rows = spark.createDataFrame([(random.choice("ab"), random.choice([None, *range(40)]), random.random()) for _ in range(300)], "g string, x int, y double").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(map(str, stats.running(rows, ["g"], "x", ["n"]).select("g", "x", "n", "upto_n", "whole_n").collect()))
    monkeypatch.setattr(stats, "ONE_STEP", 0)
    assert sorted(map(str, stats.running(rows, ["g"], "x", ["n"], steps=8).select("g", "x", "n", "upto_n", "whole_n").collect())) == found


def test_tails(spark):
    cases = [(7.814728, 3, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (3.841459, 1, 0.05), (0.0, 4, 1.0), (1e5, 3, 0.0), (30.143527, 19, 0.05), (None, 3, None), (1.0, 0, None)]
    got = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, x double, dof long, p double").withColumn("got", stats.chi_square_p(F.col("x"), F.col("dof"))).orderBy("k").collect()
    assert all(r["got"] is None if r["p"] is None else r["got"] == pytest.approx(r["p"], abs=1e-6) for r in got)
    p = spark.range(1).select(stats.two_sided_p(F.lit(1.959964)).alias("p"), stats.two_sided_p(F.lit(-3.0)).alias("q")).first()
    assert p["p"] == pytest.approx(0.05, abs=1e-6) and p["q"] == pytest.approx(math.erfc(3 / math.sqrt(2)), abs=1e-9)


def test_strength_needs_enough_values(spark):
    df = spark.range(40).select(F.col("id").alias("good"), (F.col("id") > 19).cast("int").alias("y"), F.lit(1.0).alias("flat"), F.when(F.col("id") < 5, F.col("id")).alias("few"))
    assert [(r["feature"], r["strength"]) for r in stats.univariate_strength(df, "y", ["good", "flat", "few"], least=10).collect()] == [("good", 0.5)]
    assert evaluation.prefer_blend(0.7, {"a": 0.7, "b": 0.2}) and not evaluation.prefer_blend(0.6, {"a": 0.7})


SPACE = {"c": ("log", 1e-4, 1e2), "n": ("int", 1, 60), "kind": ("choice", ["x", "y", "z"]), "r": ("real", -1.0, 1.0)}


def surface(o, step=0):
    return -((math.log10(o["c"]) - 0.5) ** 2) / 4 - ((o["n"] - 41) / 20) ** 2 + {"x": 0.0, "y": 0.6, "z": 0.1}[o["kind"]] - 2 * (o["r"] - 0.3) ** 2 + step * 0.001


def test_guided_search_beats_random_search():
    wins, guided, drawn = 0, [], []
    for seed in range(12):
        trials, chance = [], random.Random(seed)
        for _ in range(50):
            o = tuning.suggest(SPACE, trials, chance)
            assert 1e-4 <= o["c"] <= 1e2 and 1 <= o["n"] <= 60 and isinstance(o["n"], int) and -1 <= o["r"] <= 1
            trials.append((o, surface(o)))
        plain = [surface(tuning.suggest(SPACE, [], random.Random(f"{seed}/{k}"))) for k in range(50)]
        guided.append(max(v for _, v in trials))
        drawn.append(max(plain))
        wins += guided[-1] > drawn[-1]
    assert wins >= 10 and statistics.fmean(guided) > statistics.fmean(drawn) + 0.05


def test_guided_search_prunes_and_resumes(spark, tmp_path):
    calls = []

    def objective(o, step):
        calls.append(step)
        return surface(o, step)

    path = f"{tmp_path}/ledger"
    first = tuning.guided_search(spark, SPACE, objective, 3, 9, seed=1, ledger=path).orderBy("trial").collect()
    assert any(r["pruned"] for r in first) and len(calls) < 27
    n = len(calls)
    both = tuning.guided_search(spark, SPACE, objective, 3, 12, seed=1, ledger=path).orderBy("trial").collect()
    assert both[:9] == first and len(both) == 12 and len(calls) - n <= 9
    whole = tuning.guided_search(spark, SPACE, objective, 3, 12, seed=1).orderBy("trial").collect()
    assert [r["options"] for r in whole] == [r["options"] for r in both]
    best = tuning.best_trial(spark.createDataFrame(both)).first()
    assert best["value"] == max(r["value"] for r in both if not r["pruned"])


def ranked_auc(y, x):
    order = np.argsort(x, kind="stable")
    ranks = np.empty(x.size)
    ranks[order] = np.arange(1, x.size + 1)
    for v in np.unique(x):
        ranks[x == v] = ranks[x == v].mean()
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_blend_weights_equal_a_grid(spark):
    rng = np.random.default_rng(4)
    n, pull = 240, 0.5
    y = (rng.random(n) < 0.4).astype(int)
    x = np.stack([y * 0.9 + rng.normal(size=n), y * 0.6 + rng.normal(size=n), rng.normal(size=n)], 1)
    df = spark.createDataFrame([(int(k), int(y[k]), *map(float, x[k])) for k in range(n)], "id int, y int, a double, b double, noise double")
    got = evaluation.blend_weights(df, ["a", "b", "noise"], "y", pull=pull)
    r = x.argsort(0).argsort(0) / n
    value = lambda w: ranked_auc(y, np.round(r @ np.array(w), 12)) - pull * sum((v - 1 / 3) ** 2 for v in w)
    grid = [(i / 50, j / 50, (50 - i - j) / 50) for i, j in itertools.product(range(51), repeat=2) if i + j <= 50]
    best = max(grid, key=value)
    assert sum(got) == pytest.approx(1) and min(got) >= 0 and value(got) >= value(best) - 0.001
    assert max(abs(a - b) for a, b in zip(got, best, strict=True)) <= 0.06 and evaluation.blend_weights(df, ["a", "b", "noise"], "y", pull=50.0) == pytest.approx([1 / 3] * 3, abs=0.02)


def test_planted_column_has_the_largest_gain(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(rng.normal()), float(rng.normal() + 2 * (k % 2)), float(rng.normal())) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, planted double, b double")
    report, gains = training.adversarial_trees(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "id", ["a", "planted", "b"], k=2)
    top = training.top_gains(gains).collect()
    assert top[0]["column"] == "planted" and top[0]["gain"] > 0.5 and report.first()["auc"] > 0.8 and gains.count() == 6


def test_columns_are_shuffled_within_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(k, None if k % 17 == 0 else k % 2, float(x), None if k % 9 == 0 else float(x), "t") for k, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double, other string")
    got = training.shuffle_within(df, "id", "y", ["a", "b"]).collect()
    assert [*got[0].asDict()] == df.columns and sorted((r["id"], r["other"]) for r in got) == [(k, "t") for k in range(600)]
    for y in (0, 1, None):
        before, after = [r for r in rows if r[1] == y], [r for r in got if r["y"] == y]
        for c, at in (("a", 2), ("b", 3)):
            assert sorted(map(str, (r[c] for r in after))) == sorted(map(str, (r[at] for r in before)))
    pairs = np.array([(r["a"], r["b"]) for r in got if r["y"] == 1 and r["b"] is not None])
    assert abs(np.corrcoef(pairs.T)[0, 1]) < 0.2
    old = {r[0]: r[2] for r in rows}
    assert sum(r["a"] == old[r["id"]] for r in got) < 30


def test_scores_against_out_of_fold_ranks_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    oof = spark.createDataFrame([(float(v),) for v in rng.beta(2, 8, 500)], "oof double")
    ids = [f"a{k}" for k in range(400)]
    ranks_ = spark.createDataFrame([(i, (k + 1) / 401, k) for k, i in enumerate(ids)], "alert_id string, score double, o int")
    raw = spark.createDataFrame([(i, float(v), k) for k, (i, v) in enumerate(zip(ids, rng.beta(2, 8, 400), strict=True))], "alert_id string, score double, o int")
    assert evaluation.check_against_oof(ranks_, oof).first()["passed"] and not evaluation.check_against_oof(raw, oof).first()["passed"]
    path = f"{tmp_path}/scores.csv"
    tables.write_scores_csv(ranks_, path, "o")
    tables.write_scores_csv(ranks_, path, "o")
    back = tables.read_scores_csv(spark, path)
    assert evaluation.rank_round_trip(ranks_, back).first().asDict() == {"n": 400, "moved": 0, "missing": 0}
    assert evaluation.rank_round_trip(ranks_, back.where("alert_id <> 'a0'")).first()["missing"] == 1
    with open(path, "rb") as f:
        data = f.read()
    assert evaluation.check_submission_file(data, "scores.csv", exact="scores.csv") == [] and evaluation.check_submission_file(data, "scores.csv", exact="final.csv") == ["file name"]
    facts = evaluation.submission_manifest(data, "scores.csv", ranks_, back, model="m")
    assert facts["wrong"] == [] and facts["rows"] == 400 and facts["model"] == "m" and evaluation.submission_manifest(data, "s.txt", ranks_, back.limit(399))["wrong"] == ["file name", "1 rows in one table only"]
    (tmp_path / "folder").mkdir()
    with pytest.raises(IsADirectoryError):
        tables.write_scores_csv(ranks_, f"{tmp_path}/folder", "o")


def test_count_below_is_a_search_of_sorted_values(spark):
    import bisect

    for bounds in ([], [2.0], [float(i * i) for i in range(37)]):
        rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 2.0, 4.0, 100.5, 1296.0, 1e9, float("nan"))], "x double")
        array = F.array(*map(F.lit, bounds)).cast("array<double>")
        for r in rows.select("x", stats.count_below(array, F.col("x"), 40).alias("a"), stats.count_below(array, F.col("x"), 40, True).alias("b")).collect():
            want = (len(bounds),) * 2 if r["x"] != r["x"] else (bisect.bisect_left(bounds, r["x"]), bisect.bisect_right(bounds, r["x"]))
            assert (r["a"], r["b"]) == want


def test_running_brings_no_group_to_one_task(spark, monkeypatch):
    """Large groups are dealt by step; a group with few values needs none; no join is by the group alone, even where Spark wouldn't broadcast."""
    import re

    monkeypatch.setattr(stats, "ONE_STEP", 50)
    rows = spark.createDataFrame([("a", float(i), 1) for i in range(300)] + [("b", 1.0, 2), ("b", None, 3), ("c", None, 4)], "g string, x double, n long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = stats.running(rows, ["g"], "x", ["n"], steps=8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r["g"], r["x"]): (r["upto_n"], r["whole_n"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and re.search(r"hashpartitioning\(g#\d+, _step", plan)
    assert got == {("a", float(i)): (i + 1, 300) for i in range(300)} | {("b", None): (3, 5), ("b", 1.0): (5, 5), ("c", None): (4, 4)}
