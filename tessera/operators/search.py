"""Parameter search by Parzen densities, with a rule that stops poor trials between folds.

The trials so far are split into the best share and the rest; a candidate is drawn from the density of the good ones and
taken where their density exceeds that of the rest most.  A trial is judged fold by fold; after some completed trials, one
whose mean so far is worse than the median of the others at the same fold is given up.  The table of trials is all that a
search remembers, and equal seeds give equal tables.  What a fold costs is the objective's affair: it runs Spark jobs over
all rows, or works on sums that one pass has made.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, r: np.random.Generator):
        return self.values[int(r.integers(len(self.values)))]

    def draws(self, seen: list, r: np.random.Generator, n: int) -> list:
        return [self.values[int(k)] for k in r.choice(len(self.values), n, p=self._weights(seen))]

    def density(self, seen: list, at: list) -> np.ndarray:
        return self._weights(seen)[[self.values.index(x) for x in at]]

    def _weights(self, seen: list) -> np.ndarray:
        w = np.array([1.0 + seen.count(x) for x in self.values])
        return w / w.sum()


@dataclass(frozen=True)
class Between:
    """Numbers of a range, of its logarithm with log, whole ones with whole."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def _unit(self, x) -> np.ndarray:
        low, high, x = (np.log(np.asarray(v, float)) if self.log else np.asarray(v, float) for v in (self.low, self.high, x))
        return (x - low) / (high - low) if high > low else np.zeros_like(x)

    def _value(self, u: float):
        low, high = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        x = low + u * (high - low)
        x = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return int(round(x)) if self.whole else float(x)

    def draw(self, r: np.random.Generator):
        return self._value(float(r.random()))

    def _kernels(self, seen: list) -> tuple[np.ndarray, np.ndarray]:
        """Centres in the unit range and widths: the distance to the farther neighbour (or end of the range)."""
        u = np.sort(self._unit(seen))
        e = np.concatenate([[0.0], u, [1.0]])
        return u, np.clip(np.maximum(e[1:-1] - e[:-2], e[2:] - e[1:-1]), 1.0 / min(100, 2 + len(u)), 1.0)

    def draws(self, seen: list, r: np.random.Generator, n: int) -> list:
        u, width = self._kernels(seen)
        out = []
        while len(out) < n:
            k = int(r.integers(len(u) + 1))  # one kernel is flat
            x = float(r.random()) if k == len(u) else float(r.normal(u[k], width[k]))
            if 0 <= x <= 1:
                out.append(self._value(x))
        return out

    def density(self, seen: list, at: list) -> np.ndarray:
        x = self._unit(at)
        total = np.ones(len(x))
        for m, w in zip(*self._kernels(seen)):
            inside = 0.5 * (math.erf((1 - m) / (w * math.sqrt(2))) - math.erf(-m / (w * math.sqrt(2))))
            total += np.exp(-0.5 * ((x - m) / w) ** 2) / (w * math.sqrt(2 * math.pi) * inside)
        return total / (len(seen) + 1)


Space = dict[str, Choice | Between]


class Trial(NamedTuple):
    number: int
    params: dict
    folds: list[float]
    pruned: bool

    @property
    def value(self) -> float:
        return float(np.mean(self.folds))


def suggest(space: Space, done: list[Trial], r: np.random.Generator, startup: int = 10, candidates: int = 24) -> dict:
    """Parameters for the next trial; lower values are better.  Trials with fewer folds rank behind those with more."""
    if len(done) < startup:
        return {name: s.draw(r) for name, s in space.items()}
    ranked = sorted(done, key=lambda t: (-len(t.folds), t.value, t.number))
    n = max(2, min(math.ceil(0.1 * len(ranked)), 25))
    out = {}
    for name, s in space.items():
        good, rest = [t.params[name] for t in ranked[:n]], [t.params[name] for t in ranked[n:]]
        drawn = s.draws(good, r, candidates)
        out[name] = drawn[int(np.argmax(np.log(s.density(good, drawn)) - np.log(s.density(rest, drawn))))]
    return out


def hopeless(folds: list[float], done: list[Trial], startup: int = 10, warmup: int = 1) -> bool:
    """Whether a trial's mean so far is worse than the median of the completed trials at the same fold."""
    others = [float(np.mean(t.folds[: len(folds)])) for t in done if not t.pruned]
    return len(folds) > warmup and len(others) >= startup and float(np.mean(folds)) > float(np.median(others))


def search(objective: Callable[[dict, int], float], space: Space, trials: int, folds: int, seed: int = 0, startup: int = 10, warmup: int = 1, random_only: bool = False) -> list[Trial]:
    """All trials in order; objective(params, fold) is an error of that fold."""
    r = np.random.default_rng(seed)
    done: list[Trial] = []
    for number in range(trials):
        params = suggest(space, [] if random_only else done, r, startup)
        errors: list[float] = []
        while len(errors) < folds and not (errors and hopeless(errors, done, startup, warmup)):
            errors.append(float(objective(params, len(errors))))
        done.append(Trial(number, params, errors, len(errors) < folds))
    return done


def best(trials: list[Trial]) -> Trial:
    return min((t for t in trials if not t.pruned), key=lambda t: (t.value, t.number))


def trial_table(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    """trial, params (name -> text), n_folds, value, state and best, the best complete value so far."""
    rows, least = [], None
    for t in trials:
        least = t.value if not t.pruned and (least is None or t.value < least) else least
        rows.append((t.number, {k: str(v) for k, v in t.params.items()}, len(t.folds), t.value, "pruned" if t.pruned else "complete", least))
    return spark.createDataFrame(rows, "trial int, params map<string,string>, n_folds int, value double, state string, best double")


# ---------------------------------------------------------------- objectives


class RidgeFolds:
    """Held-out RMSE of ridge regression, from sums by fold that one pass over all rows has made.

    params: penalty, and `terms`, how many of the columns are used.
    """

    def __init__(self, df: DataFrame, columns: dict[str, Column], target: Column, fold: Column, folds: int):
        x = [F.lit(1.0), *[e.cast("double") for e in columns.values()]]
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        rows = df.where(target.isNotNull()).groupBy(fold.alias("_fold")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(target * target).alias("yy"), *[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(x[i] * target).alias(f"b{i}") for i in range(len(x))]
        ).collect()
        self.sums = {}
        for r in rows:
            a = np.zeros((len(x), len(x)))
            for i, j in pairs:
                a[i, j] = a[j, i] = r[f"a{i}_{j}"]
            self.sums[r["_fold"]] = (a, np.array([r[f"b{i}"] for i in range(len(x))]), r["yy"], r["n"])
        self.folds = folds

    def __call__(self, params: dict, fold: int) -> float:
        use = slice(0, 1 + params["terms"])
        a = sum(s[0] for k, s in self.sums.items() if k != fold)[use, use]
        b = sum(s[1] for k, s in self.sums.items() if k != fold)[use]
        scale = np.diag(a).copy()
        scale[0] = 0.0
        w = np.linalg.solve(a + np.diag(params["penalty"] * scale), b)
        own, cross, yy, n = self.sums[fold]
        return math.sqrt(max(yy - 2 * w @ cross[use] + w @ own[use, use] @ w, 0.0) / n)


def boosted_folds(df: DataFrame, features: list[str], target: str, fold: str) -> Callable[[dict, int], float]:
    """Held-out RMSE of boosted trees; params: trees, depth, rate, least."""
    from tessera.operators import boosting as B
    from tessera.session import stash

    rows = stash(df.dropna(subset=[target]).select(*features, target, fold), "folds")
    edges = B.bin_edges(rows, features, 32)

    def objective(params: dict, k: int) -> float:
        model = B.fit_boosted(rows, features, target, {"m": B.squared()}, edges=edges, where={"m": F.col(fold) != k}, **params)["m"]
        e = model.predict() - F.col(target)
        return rows.where(F.col(fold) == k).agg(F.sqrt(F.avg(e * e))).first()[0]

    return objective
