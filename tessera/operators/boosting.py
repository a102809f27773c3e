"""Gradient boosting from histograms: every level of every tree is one aggregate over binned rows.

Rows are binned once into a work table.  A level asks for the sum of gradients and the number of rows by model, node,
feature and bin (a partial aggregate of bounded size in every task); windows over these few rows give the best split of
each node, and only splits, leaf values and counts reach the driver: the model itself.  Several models (quantiles,
folds) are grown by the same passes.  Gradients are summed as whole numbers, so results don't depend on the order of rows.

The loss is a parameter.  Pinball loss has quantiles as leaf values, exact ones: by `percentile` while a leaf has few
rows, else by counted slices.  Missing features go to the right; rows without a target don't train.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quantiles import exact_quantiles, linear_spots
from tessera.session import stash, stash_evenly

#: Steps into which the range of gradients is divided; sums of 2^42 rows fit into 64 bits.
STEPS = 1 << 20
#: Rows of a leaf up to which all its distinct residuals may meet in one aggregate.
FEW = 1_000_000
#: Trees that are evaluated on the fly before the predictions are written down.
REFRESH = 8
#: Rows of a file of binned rows: a few bytes each, but every level walks the trees for them.
SHARE = 50_000
MOST_DEPTH = 10


@dataclass(frozen=True)
class Loss:
    """What boosting needs to know of a loss: gradients within [-1, 1] times their range, and the best constant of a leaf."""

    alpha: float | None = None  # of the pinball loss; None: squared error

    def gradient(self, y: Column, pred: Column, unit: float) -> Column:
        """The negative gradient in whole units."""
        g = (y - pred) / unit if self.alpha is None else F.when(y > pred, self.alpha).otherwise(self.alpha - 1)
        return F.floor(g * STEPS + 0.5)

    def value(self, y: Column, pred: Column) -> Column:
        d = y - pred
        return d * d if self.alpha is None else F.when(d > 0, d * self.alpha).otherwise(d * (self.alpha - 1))


def squared() -> Loss:
    return Loss()


def pinball(alpha: float) -> Loss:
    return Loss(alpha)


class Tree(NamedTuple):
    """Nodes in heap order (children of i: 2i + 1 and 2i + 2); a leaf has feature -1; a row goes left if its feature is at most the cut."""

    feature: list[int]
    cut: list[float]
    value: list[float]
    cover: list[int]


@dataclass(frozen=True)
class Boosted:
    features: list[str]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def upto(self, n: int) -> Boosted:
        """The model after its first n trees."""
        return Boosted(self.features, self.base, self.rate, self.trees[:n])

    def predict(self) -> Column:
        """The prediction as one expression over the features."""
        x = F.array(*[F.col(f).cast("double") for f in self.features])
        return F.lit(self.base) + self.rate * tree_sum(self.trees, x)


# ---------------------------------------------------------------- trees as expressions


def _literal(trees: list[Tree]) -> Column:
    """Trees as one constant, so that a plan has the same size for any number of them."""
    text = json.dumps([{"f": t.feature, "c": t.cut, "v": t.value} for t in trees])
    return F.from_json(F.lit(text), "array<struct<f:array<int>,c:array<double>,v:array<double>>>")


def _leaf(tree: Column, x: Column, depth: int) -> Column:
    """The node that a row reaches after so many levels."""

    def down(node: Column, _: Column) -> Column:
        f = F.get(tree["f"], node)
        right = F.when(F.get(x, f) <= F.get(tree["c"], node), 0).otherwise(1)
        return F.when(f < 0, node).otherwise(2 * node + 1 + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down) if depth else F.lit(0)


def _depth(t: Tree) -> int:
    return int(math.log2(len(t.feature) + 1)) - 1


def tree_sum(trees: list[Tree], x: Column) -> Column:
    """The sum of the leaf values that the array x reaches."""
    if not trees:
        return F.lit(0.0)
    deepest = max(map(_depth, trees))
    return F.aggregate(_literal(trees), F.lit(0.0), lambda total, t: total + F.get(t["v"], _leaf(t, x, deepest)))


# ---------------------------------------------------------------- training


def bin_edges(df: DataFrame, features: list[str], bins: int = 64) -> list[list[float]]:
    """Up to bins - 1 cut points of every feature, at its quantiles."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"e{k}") for k, f in enumerate(features)]).first()
    return [sorted({v for v in row[k] or [] if not math.isnan(v)}) for k in range(len(features))]


def _bins(features: list[str], edges: list[list[float]]) -> Column:
    """The number of edges below each feature; one more than there are edges + 1 for missing values."""

    def one(f: str, e: list[float]) -> Column:
        x = F.col(f).cast("double")
        below = F.size(F.filter(F.array(*map(F.lit, e)), lambda v: v < x)) if e else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), len(e) + 1).otherwise(below).cast("int")

    return F.array(*[one(f, e) for f, e in zip(features, edges)])


@dataclass
class _Growing:
    """A tree in bin numbers; `open` are the nodes that may split."""

    feature: list[int]
    cut: list[int]
    value: list[float]
    cover: list[int]
    open: set[int]

    @classmethod
    def root(cls, depth: int) -> _Growing:
        n = (2 << depth) - 1
        return cls([-1] * n, [0] * n, [0.0] * n, [0] * n, {0})

    def tree(self) -> Tree:
        return Tree(self.feature, self.cut, self.value, self.cover)


def best_splits(hist: DataFrame, least: int) -> DataFrame:
    """model, node, feature, bin, n, left: the split of each node that lowers the squared error of the gradients most; the first feature and bin if tied.

    hist has model, node, feature, bin, g, n.
    """
    own = Window.partitionBy("model", "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = hist.select("model", "node", "feature", "bin", F.sum("g").over(upto).cast("double").alias("gl"), F.sum("n").over(upto).alias("left"), F.sum("g").over(own).cast("double").alias("g"), F.sum("n").over(own).alias("n"))
    gl, g, left, n = (F.col(c) for c in ("gl", "g", "left", "n"))
    s = s.where((left >= least) & (n - left >= least)).withColumn("gain", gl * gl / left + (g - gl) * (g - gl) / (n - left) - g * g / n)
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "bin", "n", "left")).alias("b")
    return s.where("gain > 0").groupBy("model", "node").agg(best).select("model", "node", "b.feature", "b.bin", "b.n", "b.left")


def fit_boosted(
    df: DataFrame, features: list[str], target: str, losses: dict[str, Loss], *, trees: int = 50, depth: int = 3, rate: float = 0.1, least: int = 20, edges: list[list[float]] | None = None,
    bins: int = 64, where: dict[str, Column] | None = None, key: str | None = None, subsample: float = 1.0, seed: int = 0,
) -> dict[str, Boosted]:
    """A model for each named loss; `where` keeps the rows that train it.

    With subsample < 1 every tree sees the rows whose draw (of key and tree) is below it.
    """
    from tessera.operators.selection import draw

    if depth > MOST_DEPTH:
        raise ValueError(f"trees have at most {MOST_DEPTH} levels")
    names, where = list(losses), where or {}
    edges = edges or bin_edges(df, features, bins)
    known = df.where(F.col(target).isNotNull())
    mask = F.array(*[F.coalesce(where.get(m, F.lit(True)), F.lit(False)) for m in names])
    rows = stash_evenly(known.select(*([F.col(key).alias("_key")] if key else []), F.col(target).cast("double").alias("y"), _bins(features, edges).alias("bins"), mask.alias("use")), "binned", SHARE)

    # the constants to start from, and the range of the squared loss's gradients
    starts = _leaf_values(rows.select(F.posexplode("use").alias("model", "on"), "y").where("on").select("model", F.lit(0).alias("leaf"), F.col("y").alias("rest")), [losses[m] for m in names], rows.count())
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    unit = 2.0 ** math.ceil(math.log2(high - low)) if low is not None and high > low else 1.0
    base = [starts.get((k, 0), (0.0, 0))[0] for k in range(len(names))]
    rows = rows.withColumn("pred", F.array(*[F.lit(b) for b in base]))
    done: list[list[Tree]] = [[] for _ in names]
    fresh = 0  # trees that `pred` doesn't have yet

    for t in range(trees):
        pred = F.array(*[F.get("pred", F.lit(k)) + rate * tree_sum(done[k][len(done[k]) - fresh :], F.col("bins")) for k in range(len(names))]) if fresh else F.col("pred")
        now = rows.withColumn("pred", pred)
        if fresh >= REFRESH:
            now = rows = stash(now, "predicted")
            fresh = 0
        seen = now.where(draw(F.col("_key"), seed + t) < subsample) if key and subsample < 1 else now
        grow = [_Growing.root(depth) for _ in names]
        each = lambda level: F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.get("use", F.lit(k)).alias("on"), _leaf(_literal([grow[k].tree()])[0], F.col("bins"), level).alias("node"), _gradient(losses[m], k, unit).alias("g")) for k, m in enumerate(names)]))
        for level in range(depth):
            wanted = [(k, node) for k, g in enumerate(grow) for node in sorted(g.open)]
            if not wanted:
                break
            r = seen.select("bins", each(level).alias("r")).where("r.on").where(F.struct("r.model", "r.node").isin([F.struct(F.lit(a), F.lit(b)) for a, b in wanted]) if len(wanted) < sum(1 << level for _ in names) else F.lit(True))
            hist = r.select("r.model", "r.node", "r.g", F.posexplode("bins").alias("feature", "bin")).groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))
            for g in grow:
                g.open = set()
            for s in best_splits(hist, least).collect():
                g = grow[s.model]
                g.feature[s.node], g.cut[s.node], g.cover[s.node] = s.feature, s.bin, s.n
                g.cover[2 * s.node + 1], g.cover[2 * s.node + 2] = s.left, s.n - s.left
                g.open |= {2 * s.node + 1, 2 * s.node + 2}
        leaves = seen.select("y", "pred", each(depth).alias("r")).where("r.on").select("r.model", F.col("r.node").alias("leaf"), (F.col("y") - F.get("pred", F.col("r.model"))).alias("rest"))
        largest = max((g.cover[k] for g in grow for k in range(len(g.cover)) if g.feature[k] < 0 and g.cover[k]), default=FEW + 1)
        for (k, node), (value, n) in _leaf_values(leaves, [losses[m] for m in names], largest).items():
            grow[k].value[node], grow[k].cover[node] = value, n
        for k, g in enumerate(grow):
            done[k].append(g.tree())
        fresh += 1
    return {m: Boosted(list(features), base[k], rate, [_raw(t, edges) for t in done[k]]) for k, m in enumerate(names)}


def _gradient(loss: Loss, k: int, unit: float) -> Column:
    return loss.gradient(F.col("y"), F.get("pred", F.lit(k)), unit)


def _raw(t: Tree, edges: list[list[float]]) -> Tree:
    """A tree in bin numbers with the values at which it cuts; above all edges only missing values go right."""
    cut = [0.0 if f < 0 else edges[f][c] if c < len(edges[f]) else math.inf for f, c in zip(t.feature, t.cut)]
    return Tree(t.feature, [min(c, 1.7976931348623157e308) for c in cut], t.value, t.cover)


def _leaf_values(rows: DataFrame, losses: list[Loss], largest: int) -> dict[tuple[int, int], tuple[float, int]]:
    """The best constant and the rows of each (model, leaf); rows has model, leaf and rest."""
    alphas = sorted({x.alpha for x in losses if x.alpha is not None})
    exact = F.percentile("rest", F.array(*map(F.lit, alphas))) if alphas and largest <= FEW else F.lit(None)
    out = {(r.model, r.leaf): [r.mean, r.q, r.n] for r in rows.groupBy("model", "leaf").agg(F.avg("rest").alias("mean"), exact.alias("q"), F.count(F.lit(1)).alias("n")).collect()}
    if alphas and largest > FEW:
        for r in exact_quantiles(rows, ["model", "leaf"], F.col("rest"), linear_spots(alphas)).collect():
            out[r.model, r.leaf][1] = r.quantiles
    return {at: (mean if losses[at[0]].alpha is None else q[alphas.index(losses[at[0]].alpha)], n) for at, (mean, q, n) in out.items()}


def staged_losses(df: DataFrame, models: dict[str, Boosted], losses: dict[str, Loss], target: str, stages: list[int]) -> DataFrame:
    """model, trees, loss, n: the mean loss of each model after so many trees, all from one pass."""
    at = [F.struct(F.lit(m).alias("model"), F.lit(n).alias("trees"), losses[m].value(F.col(target), model.upto(n).predict()).alias("loss")) for m, model in models.items() for n in stages]
    return df.select(F.explode(F.array(*at)).alias("r")).groupBy("r.model", "r.trees").agg(F.avg("r.loss").alias("loss"), F.count("r.loss").alias("n"))


# ---------------------------------------------------------------- attribution


class _Path(NamedTuple):
    features: list[int]
    low: list[float]
    high: list[float]
    values: np.ndarray  # 2^m x m: the shares of the m features, by which of them let the row through


def leaf_paths(tree: Tree) -> list[tuple[dict[int, list[float]], float]]:
    """For every leaf: feature -> [low, high, share of rows that come through if the feature is unknown], and the leaf's value."""
    out = []

    def walk(node: int, seen: dict[int, list[float]]) -> None:
        f = tree.feature[node]
        if f < 0:
            out.append((seen, tree.value[node]))
            return
        for side, child in enumerate((2 * node + 1, 2 * node + 2)):
            low, high, z = seen.get(f, [-math.inf, math.inf, 1.0])
            low, high = (low, min(high, tree.cut[node])) if side == 0 else (max(low, tree.cut[node]), high)
            walk(child, seen | {f: [low, high, z * tree.cover[child] / tree.cover[node]]})

    walk(0, {})
    return out


def _shares(zero: list[float], value: float) -> np.ndarray:
    """Shapley values of the product game of one leaf, for every set of features that let the row through."""
    m = len(zero)
    weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    out = np.zeros((1 << m, m))
    for code in range(1 << m):
        one = [(code >> i) & 1 for i in range(m)]
        for i in range(m):
            sizes = np.ones(1)  # by the number of known features
            for j in range(m):
                if j != i:
                    sizes = np.append(sizes * zero[j], 0.0) + np.append(0.0, sizes * one[j])
            out[code, i] = value * (one[i] - zero[i]) * float(np.dot(weight, sizes))
    return out


def explain(df: DataFrame, model: Boosted, keep: list[str], prefix: str = "shap_") -> DataFrame:
    """keep, base, a column for each feature and the prediction: TreeSHAP with the training rows' shares where a feature is unknown.

    base and the features' values add up to the prediction.  Each leaf has a table of Shapley values by the set of its
    features that let a row through, so a batch costs a look-up for each leaf and feature.
    """
    import pyarrow as pa

    p = len(model.features)
    paths, base = [], model.base
    for t in model.trees:
        for seen, value in leaf_paths(t):
            base += model.rate * value * math.prod(z for _, _, z in seen.values())
            if seen and value:
                paths.append(_Path(list(seen), [s[0] for s in seen.values()], [s[1] for s in seen.values()], _shares([s[2] for s in seen.values()], model.rate * value)))
    kept = [f"_k{i}" for i in range(len(keep))]
    sent = df.sparkSession.sparkContext.broadcast(paths)

    def run(batches):
        for batch in batches:
            x = [batch.column(len(kept) + f).to_numpy(zero_copy_only=False).astype(float) for f in range(p)]
            phi = np.zeros((p, len(batch)))
            for path in sent.value:
                code = np.zeros(len(batch), np.int64)
                for i, (f, low, high) in enumerate(zip(path.features, path.low, path.high)):
                    # a missing value goes right
                    code |= (np.where(np.isnan(x[f]), high == math.inf, (x[f] > low) & (x[f] <= high))).astype(np.int64) << i
                for i, f in enumerate(path.features):
                    phi[f] += path.values[code, i]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(v) for v in phi)], names=[*kept, *(f"_s{f}" for f in range(p))])

    columns = [*(f"{k} {df.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep)), *(f"_s{f} double" for f in range(p))]
    rows = df.select(*[F.col(c).alias(k) for k, c in zip(kept, keep)], *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(model.features)])
    out = rows.mapInArrow(run, ", ".join(columns))
    total = F.lit(base)
    for f in range(p):
        total = total + F.col(f"_s{f}")
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], F.lit(base).alias("base"), *[F.col(f"_s{k}").alias(prefix + f) for k, f in enumerate(model.features)], total.alias("prediction"))
