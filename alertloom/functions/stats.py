"""Grouped statistics as DataFrames: rank tests, tables, densities, curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prepare import ratio
from .kept import kept

#: So many counted values may be put in order by one task; there are never more in it, as they are counted first.
ONE_STEP = 100_000


def melt(df: DataFrame, keys: list[str], features: list[str], name: str = "feature", value: str = "x") -> DataFrame:
    return df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in features], name, value).where(F.col(value).isNotNull())


def beside(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``other``, which has a row for each value of ``keys`` (null is a value), or one row if there are none."""
    if not keys:
        return df.crossJoin(F.broadcast(other))  # one row
    other = other.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)})
    return df.join(other, [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)], how).drop(*(f"_j{i}" for i in range(len(keys))))


def count_below(bounds: Column, x: Column, most: int, equal: bool = False) -> Column:
    """How many of the (up to ``most``) sorted values of an array are less than x, or with ``equal`` at most x; 0 for null. A search by halves: its steps are a logarithm of the array's length."""
    sizes = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
    step = lambda at, size: at + F.when((F.get(bounds, at + size - 1) <= x) if equal else (F.get(bounds, at + size - 1) < x), size).otherwise(0)
    return F.aggregate(F.array(*map(F.lit, sizes)), F.lit(0), step)


def running(counts: DataFrame, by: list[str], x: str, sums: list[str], steps: int = 256) -> DataFrame:
    """Adds upto_c and whole_c for each c of ``sums``: over the rows of ``by`` with values up to this one, and over all. One row a value.

    ``counts`` is computed once and kept. If it has up to ``ONE_STEP`` rows, one window orders them. Beyond that no task sorts a whole column: the values of a group of ``by`` with more than ``ONE_STEP`` of them are dealt into steps
    between sampled bounds, windows run within a step, and the sums of the steps carry on. There are ``steps`` of them, and more (up to 8192) where one would have more than ``ONE_STEP`` values on average. The sample is the value
    with the smallest hash of each of so many classes of hashes, so it depends on the values alone, is found with partial aggregation, and is the same when a task runs again. Only groups so large have bounds and
    sums of steps, so these are broadcast: a join by group would bring a whole column to one task. Nulls come first, NaN last, as in Spark's order.
    """
    counts = kept(counts)
    n = counts.count()
    if n <= ONE_STEP:
        every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        upto = every.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({f"{name}_{c}": F.sum(c).over(w) for name, w in (("upto", upto), ("whole", every)) for c in sums})
    while steps < 8192 and n > steps * ONE_STEP:
        steps *= 2
    v = F.col(x).cast("double")
    large = F.broadcast(counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ONE_STEP))  # a row for each ONE_STEP values at most
    drawn = beside(counts, large, by).select(*by, v.alias("_v"), F.xxhash64(v).alias("_h")).groupBy(*by, F.pmod("_h", F.lit(steps)).alias("_k")).agg(F.min_by("_v", "_h").alias("_v"))
    bounds = F.broadcast(drawn.groupBy(*by).agg(F.array_sort(F.collect_set("_v")).alias("_bounds")))
    placed = beside(counts, bounds, by, "left").withColumn("_step", count_below(F.col("_bounds"), v, steps)).drop("_bounds")  # nulls come first in step 0
    totals = beside(placed, large, by).groupBy(*by, "_step").agg(*(F.sum(c).alias(f"_s_{c}") for c in sums))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_step", *(F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums), *(F.sum(f"_s_{c}").over(group).alias(f"_w_{c}") for c in sums))
    # a group without bounds is all in step 0
    step = Window.partitionBy(*by, "_step")
    within = step.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"{name}_{c}": F.sum(c).over(w) for name, w in (("upto", within), ("whole", step)) for c in sums})
    out = beside(out, F.broadcast(totals), [*by, "_step"], "left")
    out = out.withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.coalesce(f"_b_{c}", F.lit(0)) for c in sums} | {f"whole_{c}": F.coalesce(f"_w_{c}", f"whole_{c}") for c in sums})
    return out.drop("_step", *(f"_{k}_{c}" for k in "bw" for c in sums))


def ranks(df: DataFrame, by: list[str], x: str, rank: str = "rank", n: str = "n") -> DataFrame:
    """Adds the average rank of x among the rows of ``by``, and their number. Equal values are counted before anything is sorted."""
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_t"))
    found = running(counts, by, x, ["_t"])
    found = found.select(*by, x, (F.col("upto__t") - (F.col("_t") - 1) / F.lit(2.0)).alias(rank), F.col("whole__t").alias(n))
    return beside(df, found, [*by, x])


def quantiles(df: DataFrame, by: list[str], x: str, qs: list[float], out: str = "q", weight: str | None = None) -> DataFrame:
    """by, n, ``out``: exact quantiles with linear interpolation, as an array; nulls don't count. With ``weight``, a row stands for so many. Read off running counts of distinct values, so no task holds a column."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_t"))
    place = {q: F.lit(float(q)) * (F.col("whole__t") - 1) for q in qs}
    ends = [f(F.when(F.col("upto__t") > side(place[q]), F.col(x).cast("double"))).alias(f"_{name}{k}") for k, q in enumerate(qs) for name, side, f in (("a", F.floor, F.min), ("b", F.ceil, F.min))]
    found = running(counts, by, x, ["_t"]).groupBy(*by).agg(F.max("whole__t").alias("whole__t"), *ends)
    values = [F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (place[q] - F.floor(place[q])) for k, q in enumerate(qs)]
    return found.select(*by, F.col("whole__t").alias("n"), F.array(*values).alias(out))


def rank_sums(long: DataFrame, label: str = "label", by: str = "feature", x: str = "x") -> DataFrame:
    """For each feature: n0, n1, the rank sum of positives, the sum of t**3 - t over ties.

    Ranks come from counts of distinct values, so equal values are added up before they are sorted.
    """
    counts = long.groupBy(by, x).agg(F.count(F.lit(1)).alias("t"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = running(counts, [by], x, ["t"]).withColumn("rank", F.col("upto_t") - (F.col("t") - 1) / F.lit(2.0))
    return ranked.groupBy(by).agg((F.sum("t") - F.sum("pos")).alias("n0"), F.sum("pos").alias("n1"), F.sum(F.col("rank") * F.col("pos")).alias("rank_sum"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))


def auc(long: DataFrame, **names: str) -> DataFrame:
    """feature, n0, n1, auc: the chance that a positive is above a negative, ties counting half."""
    rows = rank_sums(long, **names)
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    return rows.withColumn("auc", ratio(F.col("rank_sum") - n1 * (n1 + 1) / 2, n0 * n1))


def mann_whitney(long: DataFrame, **names: str) -> DataFrame:
    """U of positives, Cliff's delta, and z by the normal approximation with correction for ties (no continuity correction)."""
    rows = auc(long, **names)
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    sd = F.sqrt(n0 * n1 / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1))))
    return rows.withColumns({"u": F.col("auc") * n0 * n1, "cliffs_delta": 2 * F.col("auc") - 1}).withColumn("z", ratio(F.col("u") - n0 * n1 / 2, sd)).drop("rank_sum", "ties")


def two_sided_p(z: Column) -> Column:
    """The chance that a standard normal is as far from 0 as z: its square is chi-square with one degree of freedom."""
    return chi_square_p(z * z, F.lit(1))


def chi_square_p(x: Column, dof: Column, terms: int = 400) -> Column:
    """The upper tail of chi-square, as 1 less the series of the lower incomplete gamma function; 0 where it is under about 1e-15.

    The series is sum over k of exp(-h + (a + k) ln h - lngamma(a + k + 1)) with h = x / 2, a = dof / 2; each term is the one before times h / (a + k).
    """
    h, a = x / 2, dof / F.lit(2.0)
    # ln gamma(a + 1) of a whole or half a: a sum of logs down to gamma(1) = 1 or gamma(1/2)
    logs = F.aggregate(F.filter(F.transform(F.sequence(F.lit(0), F.lit(terms)), lambda i: a - i), lambda v: v > 0), F.lit(0.0), lambda s, v: s + F.ln(v)) + F.when(dof % 2 == 1, F.lit(math.log(math.pi) / 2)).otherwise(0.0)
    first = F.exp(-h + a * F.ln(h) - logs)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(first.alias("t"), first.alias("s")), lambda s, k: F.struct((s["t"] * h / (a + k)).alias("t"), (s["s"] + s["t"] * h / (a + k)).alias("s")), lambda s: s["s"])
    far = h > a + 40 + 9 * F.sqrt(a)
    return F.when(x.isNull() | dof.isNull() | (dof < 1), F.lit(None).cast("double")).when(h <= 0, F.lit(1.0)).when(far, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - series))


def class_medians(long: DataFrame, label: str = "label", by: str = "feature", x: str = "x") -> DataFrame:
    """feature, median_0, median_1."""
    found = quantiles(long, [by, label], x, [0.5])
    return found.groupBy(by).agg(*(F.max(F.when(F.col(label) == k, F.get("q", 0))).alias(f"median_{k}") for k in (0, 1)))


def mann_whitney_report(long: DataFrame) -> DataFrame:
    """feature, n0, n1, u, cliffs_delta, z, p and the medians of both classes."""
    found = mann_whitney(long).withColumn("p", two_sided_p(F.col("z")))
    return beside(found, class_medians(long), ["feature"]).select("feature", "n0", "n1", "u", "cliffs_delta", "z", "p", "median_0", "median_1")


def univariate_strength(df: DataFrame, label: str, features: list[str], least: int = 1000) -> DataFrame:
    """AUC of each feature with more than ``least`` values that differ, by distance from one half."""
    long = melt(df.withColumn("label", F.col(label)), ["label"], features)
    enough = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sd")).where((F.col("n") > least) & (F.col("sd") > 0)).select("feature")
    return auc(long.join(F.broadcast(enough), "feature")).withColumn("strength", F.abs(F.col("auc") - 0.5))  # a row a feature


def ks_two_sample(long: DataFrame, label: str = "label", by: str = "feature", x: str = "x") -> DataFrame:
    """Largest distance of the two distribution functions, taken after all rows of a value."""
    counts = long.groupBy(by, x).agg(F.sum(F.col(label).cast("long")).alias("c1"), F.sum(1 - F.col(label).cast("long")).alias("c0"))
    gap = F.abs(F.col("upto_c1") / F.col("whole_c1") - F.col("upto_c0") / F.col("whole_c0"))
    return running(counts, [by], x, ["c0", "c1"]).withColumn("gap", gap).groupBy(by).agg(F.max("gap").alias("ks"), F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))


def ks_p(d: Column, n0: Column, n1: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic."""
    xx = d * d * n0 * n1 / (n0 + n1)
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * xx))
    return F.when(xx < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof, n and Cramer's V of the table of two columns, cells without rows included."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("o")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows, columns = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    # a table of the two columns' values: its size is that of the result
    full = rows.crossJoin(columns).join(cells, [a, b], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    full = full.crossJoin(cells.agg(F.sum("o").alias("n"))).withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    out = full.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"), F.max("n").alias("n"), F.least(F.count_distinct(a) - 1, F.count_distinct(b) - 1).alias("k"))
    return out.select("chi2", "dof", "n", F.sqrt(ratio(F.col("chi2"), F.col("n") * F.col("k"))).alias("cramers_v"))


def spearman(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """a, b, rho for all pairs of features with a < b, over rows where all are known."""
    known = df.dropna(subset=features)
    ranked = ranks(melt(known, [key], features), ["feature"], "x")
    wide = ranked.groupBy(key).pivot("feature", features).agg(F.max("rank"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    return wide.agg(*(F.corr(f"`{a}`", f"`{b}`").alias(f"{a}|{b}") for a, b in pairs)).unpivot([], [F.col(f"`{a}|{b}`") for a, b in pairs], "pair", "rho").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "rho")


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of b's values in columns, and their shares of the whole table."""
    table = df.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).fillna(0)
    whole = sum((F.sum(F.col(f"`{v}`")) for v in values), F.lit(0))
    total = table.agg(whole.alias("total"))
    return table.crossJoin(total).select(a, *(F.col(f"`{v}`").alias(f"n_{v}") for v in values), *(ratio(F.col(f"`{v}`"), F.col("total")).alias(f"share_{v}") for v in values))


def rate_band(df: DataFrame, by: str, label: str) -> DataFrame:
    """Mean and count of a label with a band of 1.96 standard errors."""
    out = df.groupBy(by).agg(F.avg(label).alias("rate"), F.count(F.lit(1)).alias("n"))
    se = F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return out.withColumns({"low": F.col("rate") - 1.96 * se, "high": F.col("rate") + 1.96 * se})


def event_time_curve(prepared: DataFrame, alerts: DataFrame, days: int, label: str = "label") -> DataFrame:
    """Mean transactions an alert on each day before it, by label, alerts without any counted as 0; population standard deviation."""
    per_day = prepared.groupBy("alert_id", F.least(F.col("day"), F.lit(days - 1)).alias("day")).agg(F.count(F.lit(1)).alias("c")).join(alerts.select("alert_id", label), "alert_id")
    sums = per_day.groupBy(label, "day").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    groups = alerts.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    out = groups.join(sums, [label, "day"], "left").fillna(0, ["s", "ss"]).withColumn("mean", F.col("s") / F.col("n"))
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.col("mean") ** 2, F.lit(0.0)))
    return out.select(label, "day", "n", "mean", (F.col("mean") - 1.96 * sd / F.sqrt("n")).alias("low"), (F.col("mean") + 1.96 * sd / F.sqrt("n")).alias("high"))


def histogram(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """bin, n, density: left-closed bins, the last one closed on both sides."""
    v, last = F.col(x), len(edges) - 2
    index = F.coalesce(*(F.when((v >= a) & ((v < b) if i < last else (v <= b)), i) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    counts = df.select(index.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    widths = F.create_map(*(F.lit(w) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for w in (i, float(b - a))))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("bin", "n", (F.col("n") / (F.col("total") * widths[F.col("bin")])).alias("density"))


def density_ratio(df: DataFrame, x: str, label: str, bins: int = 20) -> DataFrame:
    """In quantile bins of all rows: share of positives over share of negatives. Bins are right-closed."""
    edges = quantiles(df, [], x, [i / bins for i in range(1, bins)], "edges").drop("n")
    found = F.array_position(F.transform(F.array_distinct("edges"), lambda e: F.col(x) <= e), F.lit(True))
    rows = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", F.when(found > 0, found - 1).otherwise(F.size(F.array_distinct("edges"))).cast("int"))  # edges: one row
    counts = rows.groupBy("bin").agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    total = counts.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    return counts.crossJoin(total).select("bin", "n0", "n1", ratio(F.col("n1") * F.col("t0"), F.col("n0") * F.col("t1")).alias("ratio"))


def quantile_box(df: DataFrame, by: str, x: str) -> DataFrame:
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    out = quantiles(df, [by], x, list(qs))
    return out.select(by, "n", *(F.get("q", i).alias(f"q{round(q * 100):02d}") for i, q in enumerate(qs)))


def lift(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of each key among positives over its share among negatives."""
    counts = df.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    total = counts.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    return counts.crossJoin(total).select(*keys, "n1", "n0", ratio(F.col("n1") * F.col("t0"), F.col("n0") * F.col("t1")).alias("lift"))


def cohort_rank(df: DataFrame, cohort: list[str], x: str, out: str = "pct") -> DataFrame:
    """Adds ``out``: the average rank within the cohort over its size."""
    return ranks(df, cohort, x, "_rank", "_n").withColumn(out, F.col("_rank") / F.col("_n")).drop("_rank", "_n")


def describe(df: DataFrame, x: str, qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """n, mean, std, min, the quantiles, max of one column."""
    facts = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    found = quantiles(df, [], x, list(qs)).select("n", *(F.get("q", k).alias(f"q{round(q * 100):02d}") for k, q in enumerate(qs)))
    return found.crossJoin(facts)  # one row each


def corrected_moments(df: DataFrame, x: str) -> DataFrame:
    """Skewness and excess kurtosis with correction for bias."""
    n, g, k = F.col("n").cast("double"), F.col("g"), F.col("k")
    out = df.agg(F.count(x).alias("n"), F.skewness(x).alias("g"), F.kurtosis(x).alias("k"))
    return out.select("n", (g * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)).alias("kurt"))
