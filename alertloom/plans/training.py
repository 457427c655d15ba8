"""Training around Spark's learners: quantile-normal inputs, early stopping, seeds, selection in the fold, search, drift and overfit checks."""

from __future__ import annotations

import itertools
import math
import random
import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import auc, beside, count_below, melt, ranks, running
from . import evaluation


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, from the series of the tail (Abramowitz and Stegun 26.2.23; error under 4.5e-4)."""
    # fixed values: the published coefficients
    c, d = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
    q = F.greatest(F.least(p, 1 - p), F.lit(1e-12))
    t = F.sqrt(-2 * F.ln(q))
    x = t - (c[0] + c[1] * t + c[2] * t * t) / (1 + d[0] * t + d[1] * t * t + d[2] * t * t * t)
    return F.when(p == 0.5, F.lit(0.0)).when(p < 0.5, -x).otherwise(x)


def quantile_edges(train: DataFrame, features: list[str], points: int = 200) -> dict[str, list[float]]:
    """``points`` quantiles of each feature's training rows: a list of fixed size. Features without values are left out."""
    at = F.array(*(F.lit((i + 0.5) / points) for i in range(points)))
    row = train.agg(*(F.percentile_approx(F.col(c).cast("double"), at, F.lit(10_000)).alias(c) for c in features)).first()
    return {c: row[c] for c in features if row[c] is not None}


def quantile_normal(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Each feature becomes the normal quantile of its place among the edges, ties in their middle; null becomes 0, the median."""
    def place(c: str) -> Column:
        e, x = F.array(*map(F.lit, edges[c])), F.col(c).cast("double")
        below, upto = (count_below(e, x, len(edges[c]), equal) for equal in (False, True))
        return F.coalesce(normal_quantile(((below + upto) / 2 + 0.5) / F.lit(len(edges[c]) + 1.0)), F.lit(0.0))

    return df.withColumns({c: place(c) for c in edges})


def boosted(train: DataFrame, test: DataFrame, key: str, label: str, features: list[str], seed: int = 42, rounds: int = 20, depth: int = 4, stop_share: float = 0.1) -> DataFrame:
    """key, score: boosted trees that stop early on a stratified share of the training rows; missing values get training medians."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [f"{c}__x" for c in features]
    parts = max(2, round(1 / stop_share))
    held = evaluation.stratified_folds(_doubles(train, key, label, features), key, label, parts, seed).withColumn("held", F.col("fold") == 0)
    tree = GBTClassifier(featuresCol="raw", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="held", validationTol=0.0)
    model = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=names), VectorAssembler(inputCols=names, outputCol="raw"), tree]).fit(held)
    return model.transform(_doubles(test, key, None, features)).select(key, vector_to_array("probability")[1].alias("score"))


def logistic(train: DataFrame, test: DataFrame, key: str, label: str, features: list[str], c: float = 0.05) -> DataFrame:
    """key, score: L2 logistic regression on quantile-normal features; those without a training value are left out.

    ``c`` weighs the summed loss against half the squared weights; Spark's strength belongs to the mean loss, so it is 1 / (c n).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    edges, n = quantile_edges(train, features), train.count()
    model = Pipeline(stages=[VectorAssembler(inputCols=list(edges), outputCol="raw"), LogisticRegression(featuresCol="raw", labelCol=label, regParam=1 / (c * max(n, 1)), standardization=False)]).fit(quantile_normal(_doubles(train, key, label, features), edges))
    return model.transform(quantile_normal(_doubles(test, key, None, features), edges)).select(key, vector_to_array("probability")[1].alias("score"))


def _doubles(df: DataFrame, key: str, label: str | None, features: list[str]) -> DataFrame:
    return df.select(key, *([F.col(label).cast("double").alias(label)] if label else []), *(F.col(c).cast("double").alias(c) for c in features))


def out_of_fold(df: DataFrame, key: str, label: str, features: list[str], fit=logistic, k: int = 5, repeats: int = 1, seed: int = 42, top: int | None = None, **options) -> DataFrame:
    """key, repeat, fold, label, oof. With ``top``, each fold's model has the features strongest by AUC in its own training rows."""
    out = None
    for repeat in range(repeats):
        dealt = evaluation.kept(evaluation.stratified_folds(df, key, label, k, seed + repeat))
        for fold in range(k):
            train, test = dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
            scored = fit(train, test, key, label, strongest(train, label, features, top) if top else features, **options)
            part = test.select(key, F.lit(repeat).alias("repeat"), "fold", F.col(label).cast("double").alias("label")).join(scored, key).withColumnRenamed("score", "oof")
            part = evaluation.kept(part)
            out = part if out is None else out.unionByName(part)
    return out


def strongest(train: DataFrame, label: str, features: list[str], top: int) -> list[str]:
    """The features whose AUC is farthest from one half; ties by name."""
    rows = auc(melt(train.select(F.col(label).alias("_label"), *features), ["_label"], features), label="_label").select("feature", "auc").collect()  # a row a feature
    return [r["feature"] for r in sorted(rows, key=lambda r: (-abs((0.5 if r["auc"] is None else r["auc"]) - 0.5), r["feature"]))[:top]]


def repeat_report(oof: DataFrame) -> DataFrame:
    """repeat, auc of all its out-of-fold rows, mean and population deviation of the AUCs of its folds."""
    def of(name: Column) -> DataFrame:
        return auc(oof.select(name.alias("feature"), "label", F.col("oof").alias("x"))).select("feature", "auc")

    folds = of(F.concat_ws("/", "repeat", "fold")).groupBy(F.split_part("feature", F.lit("/"), F.lit(1)).cast("int").alias("repeat")).agg(F.avg("auc").alias("fold_mean"), F.stddev_pop("auc").alias("fold_std"))
    return of(F.col("repeat").cast("string")).select(F.col("feature").cast("int").alias("repeat"), "auc").join(folds, "repeat")


def seed_average(train: DataFrame, test: DataFrame, key: str, label: str, features: list[str], seeds: tuple[int, ...] = (1, 2, 3, 4, 5), rounds: int = 20, more: float = 1.1, **options) -> DataFrame:
    """key, score: the mean over seeds of models of all training rows, with ``more`` times the rounds."""
    parts = [boosted(train, test, key, label, features, seed=s, rounds=math.ceil(rounds * more - 1e-9), **options) for s in seeds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.avg("score").alias("score"))


def adversarial(train: DataFrame, test: DataFrame, key: str, features: list[str], k: int = 5, **options) -> DataFrame:
    """Can a model tell the two tables apart? The report of ``repeat_report`` for the label "is a test row"; keys must differ between them."""
    rows = train.select(key, *features, F.lit(0).alias("is_test")).unionByName(test.select(key, *features, F.lit(1).alias("is_test")))
    return repeat_report(out_of_fold(rows, key, "is_test", features, k=k, **options))


def blend_overfit(oof: DataFrame, models: list[str], label: str, fold: str = "fold", k: int = 5, **options) -> dict[str, float]:
    """Mean AUC on each fold of weights fitted on the others, of equal weights, and of each model alone. Weights of all folds are fitted together."""
    oof = evaluation.kept(oof)
    rest = oof.withColumn("_out", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))))
    fitted = evaluation.blend_fits(rest, models, label, "_out", **options)
    m = len(models)
    named = {"equal": [1 / m] * m} | {c: [float(c == d) for d in models] for c in models}
    table = oof.sparkSession.createDataFrame([(f, name, [float(w) for w in ws]) for f in range(k) for name, ws in ({"fitted": fitted.get(f, [1 / m] * m)} | named).items()], "_out int, name string, ws array<double>")
    long = oof.select(F.col(fold).alias("_out"), F.col(label).alias("label"), F.monotonically_increasing_id().alias("_id"), *(F.col(c).cast("double").alias(c) for c in models)).unpivot(["_out", "label", "_id"], models, "model", "x")
    ranked = ranks(long, ["_out", "model"], "x", "r", "n").withColumn("r", F.col("r") / F.col("n")).groupBy("_out", "label", "_id").pivot("model", models).agg(F.max("r"))
    blend = sum((F.get("ws", i) * F.col(f"`{c}`") for i, c in enumerate(models)), F.lit(0.0))
    points = ranked.join(F.broadcast(table), "_out").select(F.concat_ws("/", "_out", "name").alias("feature"), "label", F.round(blend, 12).alias("x"))
    rows = auc(points).withColumn("name", F.split_part("feature", F.lit("/"), F.lit(2))).groupBy("name").agg(F.avg("auc").alias("auc")).collect()  # a row a blend
    return {r["name"]: r["auc"] for r in rows}


def tree_gains(model, columns: list[str]) -> list[tuple[str, float]]:
    """The share of a fitted tree ensemble's split gains that each column has."""
    return [(c, float(g)) for c, g in zip(columns, model.featureImportances.toArray(), strict=True)]


def adversarial_trees(train: DataFrame, test: DataFrame, key: str, features: list[str], k: int = 3, seed: int = 42, rounds: int = 10, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Can boosted trees tell the two tables apart, and by which columns? (repeat, auc, fold_mean, fold_std) and (fold, column, gain); keys must differ between the tables."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = train.select(key, *features, F.lit(0).alias("is_test")).unionByName(test.select(key, *features, F.lit(1).alias("is_test")))
    dealt = evaluation.kept(evaluation.stratified_folds(_doubles(rows, key, "is_test", features), key, "is_test", k, seed))
    names = [f"{c}__x" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=names), VectorAssembler(inputCols=names, outputCol="raw"), GBTClassifier(featuresCol="raw", labelCol="is_test", maxIter=rounds, maxDepth=depth, seed=seed)]
    parts, gains = [], []
    for fold in range(k):
        fitted = Pipeline(stages=stages).fit(dealt.where(F.col("fold") != fold))
        scored = fitted.transform(dealt.where(F.col("fold") == fold))
        parts.append(evaluation.kept(scored.select(F.lit(0).alias("repeat"), "fold", F.col("is_test").alias("label"), vector_to_array("probability")[1].alias("oof"))))
        gains += [(fold, c, g) for c, g in tree_gains(fitted.stages[-1], features)]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return repeat_report(oof), train.sparkSession.createDataFrame(gains, "fold int, column string, gain double")


def top_gains(gains: DataFrame, most: int = 5) -> DataFrame:
    """column, gain: the mean over folds of each column's share of the gains, the largest first."""
    return gains.groupBy("column").agg(F.avg("gain").alias("gain")).orderBy(F.desc("gain"), "column").limit(most)


def shuffle_within(df: DataFrame, key: str, label: str, columns: list[str], seed: int = 42) -> DataFrame:
    """The rows with every column's values dealt anew within each class, each column by itself; nulls move like values. ``key`` is unique.

    Values and rows are put in the order of hashes, and value k of a column and class goes to row k of the class. Places come from running counts over steps
    of the hashes, so no task sorts a class.
    """
    rows = evaluation.kept(df.select(key, label, *(F.col(c).cast("double").alias(c) for c in columns)))
    one = F.lit(1).alias("one")
    values = rows.unpivot([key, label], columns, "column", "x").select(label, "column", "x", F.xxhash64(key, "column", F.lit(seed)).alias("h"), one)
    places = running(rows.select(key, label, F.xxhash64(key, F.lit(seed)).alias("h"), one), [label], "h", ["one"]).select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col("upto_one").alias("_at"))
    dealt = running(values, [label, "column"], "h", ["one"])
    moved = dealt.join(places, F.col(label).eqNullSafe(F.col("_label")) & (F.col("upto_one") == F.col("_at"))).groupBy(F.col("_key").alias(key), F.col("_label").alias(label)).pivot("column", columns).agg(F.max("x"))
    others = [c for c in df.columns if c not in (key, label, *columns)]
    return beside(df.select(key, label, *others), moved.drop(label), [key]).select(*df.columns)


def search(df: DataFrame, key: str, label: str, features: list[str], grid: dict[str, list], fit=logistic, tries: int = 8, folds: int = 3, seed: int = 42) -> tuple[dict, float]:
    """The options with the best out-of-fold AUC among ``tries`` drawn from the grid. After its first fold, an attempt below the median of the others' first folds ends."""
    options = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    drawn = random.Random(seed).sample(options, min(tries, len(options)))
    dealt = evaluation.kept(evaluation.stratified_folds(df, key, label, folds, seed))
    firsts: list[float] = []
    best: tuple[dict, float] = ({}, -1.0)
    for option in drawn:
        values = []
        for f in range(folds):
            test = dealt.where(F.col("fold") == f)
            scored = fit(dealt.where(F.col("fold") != f), test, key, label, features, **option).join(test.select(key, F.col(label).alias("label")), key)
            scored = evaluation.kept(scored)
            values.append(auc(scored.select(F.lit("all").alias("feature"), "label", F.col("score").alias("x"))).first()["auc"] or 0.0)
            if f == 0:
                below = len(firsts) >= 3 and values[0] < statistics.median(firsts)
                firsts.append(values[0])
                if below:
                    break
        else:
            if statistics.fmean(values) > best[1]:
                best = (option, statistics.fmean(values))
    return best
