"""Model evaluation: folds, naive Bayes on bins, ROC grid, rank blending, cross-validated models, submissions."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kept import kept
from ..functions.stats import auc, beside, ks_two_sample, melt, quantiles, ranks, running


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """Adds fold: each label's rows, in the order of a hash of key and seed, are dealt in turn.

    Rows are numbered within 4096 ranges of the hash a label; sums of the ranges carry on.
    """
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_range", F.substring("_h", 1, 3))
    before = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_c")).select(label, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", key))
    return beside(rows, starts, [label, "_range"]).withColumn("fold", ((F.col("_start") + number - 1) % k).cast("int")).drop("_h", "_range", "_start")


def rank01(df: DataFrame, x: str, out: str, plus: int = 1) -> DataFrame:
    """Adds ``out``: the average rank of x among all rows over n + ``plus``."""
    return ranks(df, [], x, "_rank", "_n").withColumn(out, F.col("_rank") / (F.col("_n") + plus)).drop("_rank", "_n")


def naive_bayes_bins(train: DataFrame, test: DataFrame, key: str, label: str, features: list[str], bins: int = 10, prior: float = 200.0) -> DataFrame:
    """key, score: sum over features of the log odds of the row's quantile bin, smoothed towards the base rate; missing values have their own bin."""
    long = train.unpivot([key, label], [F.col(c).cast("double").alias(c) for c in features], "feature", "x")
    edges = quantiles(long, ["feature"], "x", [i / bins for i in range(1, bins)], "edges").drop("n")
    position = F.array_position(F.transform("edges", lambda e: F.col("x") <= e), F.lit(True))
    bin_of = F.when(F.col("x").isNull(), -1).when(position > 0, position - 1).otherwise(bins - 1).cast("int")
    rate = train.agg(F.avg(label).alias("rate"))
    binned = long.join(F.broadcast(edges), "feature").withColumn("bin", bin_of)  # edges: a row a feature
    p = (F.col("s") + prior * F.col("rate")) / (F.col("n") + prior)
    odds = binned.groupBy("feature", "bin").agg(F.sum(label).alias("s"), F.count(F.lit(1)).alias("n")).crossJoin(rate).select("feature", "bin", (F.ln(p / (1 - p)) - F.ln(F.col("rate") / (1 - F.col("rate")))).alias("odds"))
    other = test.unpivot([key], [F.col(c).cast("double").alias(c) for c in features], "feature", "x").join(F.broadcast(edges), "feature").withColumn("bin", bin_of)
    return other.join(F.broadcast(odds), ["feature", "bin"], "left").groupBy(key).agg(F.sum(F.coalesce("odds", F.lit(0.0))).alias("score"))


def roc_grid(df: DataFrame, score: str, label: str, points: int = 201) -> DataFrame:
    """fpr, tpr: the largest true positive rate at or below each point of a grid of false positive rates; rows without a score are left out."""
    counts = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("c1"), F.sum(1 - F.col(label).cast("long")).alias("c0"))
    counts = running(counts.where(F.col(score).isNotNull()).withColumn("_down", -F.col(score).cast("double")), [], "_down", ["c0", "c1"])
    curve = counts.select((F.col("upto_c0") / F.col("whole_c0")).alias("f"), (F.col("upto_c1") / F.col("whole_c1")).alias("t"))
    steps = curve.groupBy(F.least(F.lit(points - 1), F.greatest(F.lit(0), F.ceil(F.round(F.col("f") * (points - 1), 9)))).cast("int").alias("g")).agg(F.max("t").alias("t"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("g"))
    best = F.max("t").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(steps, "g", "left").select((F.col("g") / F.lit(float(points - 1))).alias("fpr"), F.coalesce(best, F.lit(0.0)).alias("tpr"))


def rank_blend(oof: DataFrame, models: list[str], weights: list[float]) -> DataFrame:
    """The weighted mean of the models' rank positions."""
    total, ranked = sum(weights), oof
    for m in models:
        ranked = rank01(ranked, m, f"_r_{m}", 0)
    return ranked.withColumn("blend", sum((F.col(f"_r_{m}") * F.lit(w / total) for m, w in zip(models, weights, strict=True)), F.lit(0.0))).drop(*(f"_r_{m}" for m in models))


def blend_fits(oof: DataFrame, models: list[str], label: str, part: str, pull: float = 0.1, rounds: int = 14, step: float = 0.6) -> dict:
    """For each value of ``part`` the weights on the simplex that maximise AUC of the rank blend less ``pull`` times the squared distance from equal weights.

    Multiplicative steps: from its best weights, each part tries every model's weight times and over exp(step), and every pair of these, brought back to
    a sum of 1; where none is better, its step is halved. All points of all parts are scored by one job over one long table a round.
    """
    m = len(models)
    long = oof.select(part, F.col(label).alias("label"), F.monotonically_increasing_id().alias("_id"), *(F.col(c).cast("double").alias(c) for c in models))
    long = kept(long).unpivot([part, "label", "_id"], models, "model", "x")
    ranked = kept(ranks(long, [part, "model"], "x", "r", "n").withColumn("r", F.col("r") / F.col("n")).groupBy(part, "label", "_id").pivot("model", models).agg(F.max("r")))
    parts = [r[0] for r in ranked.select(part).distinct().orderBy(part).collect()]
    best = {p: [1 / m] * m for p in parts}
    value, steps = {}, dict.fromkeys(parts, step)

    def tried(options: dict) -> dict:
        table = ranked.sparkSession.createDataFrame([(p, k, ws) for p, tries in options.items() for k, ws in enumerate(tries)], f"`{part}` {ranked.schema[part].dataType.simpleString()}, k int, ws array<double>")
        blend = sum((F.get("ws", i) * F.col(f"`{c}`") for i, c in enumerate(models)), F.lit(0.0))
        points = ranked.join(F.broadcast(table), part).select(F.concat_ws("/", part, "k").alias("feature"), "label", F.round(blend, 12).alias("x"))
        found = {r["feature"]: r["auc"] for r in auc(points).collect()}  # a row a point
        return {p: [(found[f"{p}/{k}"] or 0.0) - pull * sum((w - 1 / m) ** 2 for w in ws) for k, ws in enumerate(tries)] for p, tries in options.items()}

    def moves(ws: list[float], size: float) -> list[list[float]]:
        out = []
        for i in range(m):
            for j in range(i, m):
                for a in (size, -size):
                    moved = [w * math.exp(a * (k == i) - a * (k == j) * (i != j)) for k, w in enumerate(ws)]
                    out.append([w / sum(moved) for w in moved])
        return out

    for p, v in tried({p: [ws] for p, ws in best.items()}).items():
        value[p] = v[0]
    for _ in range(rounds):
        options = {p: moves(best[p], steps[p]) for p in parts}
        for p, values in tried(options).items():
            if max(values) > value[p]:
                value[p] = max(values)
                best[p] = options[p][values.index(value[p])]
            else:
                steps[p] /= 2
    return best


def blend_weights(oof: DataFrame, models: list[str], label: str, **options) -> list[float]:
    """See ``blend_fits``, for all rows."""
    return blend_fits(oof.withColumn("_all", F.lit(0)), models, label, "_all", **options)[0]


def fold_report(oof: DataFrame, label: str = "label") -> DataFrame:
    """AUC of each repeat and fold."""
    long = oof.select(F.concat_ws("/", "repeat", "fold").alias("feature"), F.col(label).alias("label"), F.col("oof").alias("x"))
    return auc(long).select("feature", "n0", "n1", "auc")


def prefer_blend(blend: float, singles: dict[str, float]) -> bool:
    """Whether the blend is at least as good as the best single model."""
    return blend >= max(singles.values())


def check_submission(scores: DataFrame, expected: DataFrame, id_column: str = "alert_id", score_column: str = "score", least_unique: float = 0.95) -> DataFrame:
    """check, passed: ids complete, known and single; scores present, finite, in [0, 1], and mostly distinct."""
    found = scores.select(F.col(id_column).alias("id"), F.col(score_column).cast("double").alias("s"))
    wanted = expected.select(F.col(id_column).alias("id"))
    facts = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("s").isNull() | F.isnan("s") | (F.abs("s") == float("inf"))).alias("bad"), F.count_if((F.col("s") < 0) | (F.col("s") > 1)).alias("outside"), F.count_distinct("s").alias("unique"))
    missing = wanted.join(found, "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    unknown = found.join(wanted, "id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    row = facts.crossJoin(missing).crossJoin(unknown)
    checks = {"no_missing_id": F.col("missing") == 0, "no_unknown_id": F.col("unknown") == 0, "no_repeated_id": F.col("n") == F.col("ids"), "finite": F.col("bad") == 0, "in_range": F.col("outside") == 0, "distinct": F.col("unique") >= least_unique * F.col("n")}
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), passed.alias("passed")) for name, passed in checks.items()))).alias("c")).select("c.*")


def check_against_oof(scores: DataFrame, oof: DataFrame, score_column: str = "score", oof_column: str = "oof", most: float = 0.05) -> DataFrame:
    """ks, passed: do submitted scores have the distribution of out-of-fold scores, once these are rank-normalised (average rank over n + 1)?

    Scores that were meant to be ranks and are raw probabilities, or the other way round, are far from that.
    """
    ranked = rank01(oof.select(F.col(oof_column).cast("double").alias("o")).where("o is not null"), "o", "x")
    both = ranked.select(F.lit("all").alias("feature"), F.lit(0).alias("label"), "x").unionByName(scores.select(F.lit("all").alias("feature"), F.lit(1).alias("label"), F.col(score_column).cast("double").alias("x")).where("x is not null"))
    return ks_two_sample(both).select("ks", (F.col("ks") < most).alias("passed"))


def rank_round_trip(scores: DataFrame, written: DataFrame, id_column: str = "alert_id", score_column: str = "score") -> DataFrame:
    """n, moved, missing: scores against what was read back of a written file; how many have another average rank, and how many are in one table only."""
    a = ranks(scores.select(F.col(id_column).cast("string").alias("id"), F.col(score_column).cast("double").alias("a")), [], "a", "ra", "na")
    b = ranks(written.select(F.col(id_column).cast("string").alias("id2"), F.col(score_column).cast("double").alias("b")), [], "b", "rb", "nb")
    both = a.join(b, a["id"] == b["id2"], "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ra") != F.col("rb")).alias("moved"), F.count_if(F.col("id").isNull() | F.col("id2").isNull()).alias("missing"))


def check_submission_file(data: bytes, name: str, header: str = "alert_id,score", pattern: str = r"[A-Za-z0-9_]+\.csv", exact: str | None = None) -> list[str]:
    """What is wrong with the bytes of a submission: mark, name (``exact``, if given, else ``pattern``), header, quotes, fields, numbers."""
    import re

    wrong = []
    if data.startswith(b"\xef\xbb\xbf"):
        wrong.append("byte order mark")
    if name != exact if exact else not re.fullmatch(pattern, name):
        wrong.append("file name")
    lines = data.decode("utf-8-sig", "replace").split("\n")
    if lines[0].rstrip("\r") != header:
        wrong.append("header")
    if b'"' in data:
        wrong.append("quotes")
    for line in filter(None, lines[1:]):
        fields = line.rstrip("\r").split(",")
        if len(fields) != 2:
            wrong.append("fields")
            break
        try:
            if not math.isfinite(float(fields[1])):
                wrong.append("number")
                break
        except ValueError:
            wrong.append("number")
            break
    return wrong


def manifest(data: bytes, **facts: object) -> dict[str, object]:
    """The hash and size of a written file, with the facts of its run."""
    return {"sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)} | facts


def submission_manifest(data: bytes, name: str, scores: DataFrame, written: DataFrame, **facts: object) -> dict[str, object]:
    """The manifest of a written submission, with what is wrong with the file and what its ranks have lost: a run should end if ``wrong`` isn't empty."""
    trip = rank_round_trip(scores, written).first()
    wrong = check_submission_file(data, name) + [f"{trip[c]} rows {what}" for c, what in (("moved", "with another rank"), ("missing", "in one table only")) if trip[c]]
    return manifest(data, rows=trip["n"], wrong=wrong, **facts)
