"""Search of options guided by what earlier trials found: Parzen estimators of good and bad trials, pruning by medians, a ledger to resume from.

The driver decides on a handful of numbers; each evaluation of an objective is a Spark job of its own. The ledger is a table of one row a
trial, so a search that ends early goes on where it was.
"""

from __future__ import annotations

import json
import math
import random
import statistics
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> ("log", low, high), ("real", low, high), ("int", low, high) or ("choice", [values])
Space = dict[str, tuple]
LEDGER = "trial int, options string, value double, steps int, pruned boolean"


def _to_line(kind: tuple, value) -> float:
    return math.log(value) if kind[0] == "log" else float(value)


def _from_line(kind: tuple, x: float):
    low, high = kind[1], kind[2]
    if kind[0] == "log":
        return min(max(math.exp(x), low), high)
    return min(max(round(x) if kind[0] == "int" else x, low), high)


class Parzen:
    """One dimension of a group of trials: a mixture of a normal around each value and the prior over the whole range, or smoothed frequencies."""

    def __init__(self, kind: tuple, values: list):
        self.kind = kind
        if kind[0] == "choice":
            counts = [1 + sum(v == c for v in values) for c in kind[1]]
            self.weights = [c / sum(counts) for c in counts]
            return
        self.low, self.high = _to_line(kind, kind[1]), _to_line(kind, kind[2])
        self.points = sorted(_to_line(kind, v) for v in values)
        width = self.high - self.low
        ends = [self.low, *self.points, self.high]
        # as wide as the farther neighbour is away, within limits
        self.widths = [min(max(ends[i + 1] - ends[i], ends[i + 2] - ends[i + 1], width / min(100, len(values) + 1)), width) for i in range(len(self.points))]

    def draw(self, chance: random.Random):
        if self.kind[0] == "choice":
            return chance.choices(self.kind[1], self.weights)[0]
        k = chance.randrange(len(self.points) + 1)
        if k == len(self.points):
            return _from_line(self.kind, chance.uniform(self.low, self.high))
        for _ in range(50):
            x = chance.gauss(self.points[k], self.widths[k])
            if self.low <= x <= self.high:
                break
        return _from_line(self.kind, min(max(x, self.low), self.high))

    def density(self, value) -> float:
        if self.kind[0] == "choice":
            return self.weights[self.kind[1].index(value)]
        x = _to_line(self.kind, value)
        flat = 1 / max(self.high - self.low, 1e-12)
        near = [math.exp(-0.5 * ((x - p) / w) ** 2) / (w * math.sqrt(2 * math.pi)) for p, w in zip(self.points, self.widths, strict=True) if w > 0]
        return (flat + sum(near)) / (len(self.points) + 1)


def suggest(space: Space, trials: list[tuple[dict, float]], chance: random.Random, starts: int = 8, share: float = 0.25, candidates: int = 24) -> dict:
    """Options for the next trial. After ``starts`` random ones: of candidates drawn like the best ``share`` of trials, the one most likelier there than among the others."""
    uniform = {name: Parzen(kind, []) for name, kind in space.items()}
    if len(trials) < starts:
        return {name: p.draw(chance) for name, p in uniform.items()}
    ordered = sorted(trials, key=lambda t: -t[1])
    cut = max(2, math.ceil(share * len(trials)))
    good, bad = ({name: Parzen(kind, [o[name] for o, _ in group]) for name, kind in space.items()} for group in (ordered[:cut], ordered[cut:]))
    drawn = [{name: p.draw(chance) for name, p in good.items()} for _ in range(candidates)]
    return max(drawn, key=lambda o: sum(math.log(good[n].density(o[n]) / bad[n].density(o[n])) for n in space))


def guided_search(spark: SparkSession, space: Space, objective: Callable[[dict, int], float], steps: int, trials: int, seed: int = 42, ledger: str | None = None, **options) -> DataFrame:
    """The ledger of all trials. ``objective(options, step)`` gives one of ``steps`` values, whose mean is to be large (a fold's AUC, say).

    After each step a trial ends if the mean of its values is below the median of what the others had after as many. ``ledger``: a folder of JSON lines;
    trials found there count, and new ones are added as they end.
    """
    rows: list[tuple] = []
    curves: list[list[float]] = []
    if ledger and _exists(spark, ledger):
        for r in spark.read.schema(LEDGER + ", curve array<double>").json(ledger).orderBy("trial").collect():  # a row a trial
            rows.append((r["trial"], r["options"], r["value"], r["steps"], r["pruned"]))
            curves.append(list(r["curve"]))
    for trial in range(len(rows), trials):
        chance = random.Random(f"{seed}/{trial}")
        tried = suggest(space, [(json.loads(o), v) for _, o, v, *_ in rows], chance, **options)
        curve: list[float] = []
        for step in range(steps):
            curve.append(objective(tried, step))
            others = [statistics.fmean(c[: step + 1]) for c in curves if len(c) > step]
            if step + 1 < steps and len(others) >= 4 and statistics.fmean(curve) < statistics.median(others):
                break
        row = (trial, json.dumps(tried, sort_keys=True), statistics.fmean(curve), len(curve), len(curve) < steps)
        rows.append(row)
        curves.append(curve)
        if ledger:
            spark.createDataFrame([(*row, curve)], LEDGER + ", curve array<double>").coalesce(1).write.mode("append").json(ledger)
    return spark.createDataFrame(rows, LEDGER)


def best_trial(found: DataFrame) -> DataFrame:
    """The trial with the largest value among those that weren't pruned; the earliest of those that tie."""
    return found.where("not pruned").orderBy(*(c for c in (found["value"].desc(), found["trial"]))).limit(1)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
