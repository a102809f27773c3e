"""Folds, linear and boosted models, ensembles and distances from the training data."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import across, conformal_quantile, regression_metrics


class Distance(NamedTuple):
    columns: list[str]
    mean: list[float]
    inverse: list[list[float]]
    threshold: float
    shrinkage: float


def ledoit_wolf(n: int, cov: np.ndarray, fourth: float) -> tuple[np.ndarray, float]:
    """Shrinks a covariance to a multiple of the identity; fourth is the mean of |x|^4 of centred rows."""
    p = len(cov)
    if not n:
        return cov, 0.0
    mu = np.trace(cov) / p
    delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
    beta = min((fourth - (cov**2).sum()) / (n * p), delta)
    s = 0.0 if delta == 0 else max(beta / delta, 0.0)
    return (1 - s) * cov + s * mu * np.eye(p), s


def fit_mahalanobis(df: DataFrame, columns: list[str], percentile: float = 0.975) -> Distance:
    """Mean, inverse shrunk covariance and the threshold, an exact quantile of the training rows' distances; any number of columns."""
    from tessera.operators.gram import moments, squared_distance
    from tessera.operators.quantiles import exact_quantiles, linear_spots

    m = moments(df, columns)
    shrunk, s = ledoit_wolf(m.n, m.cov, m.fourth)
    inverse = np.linalg.pinv(shrunk)
    seen = squared_distance(df.dropna(subset=columns), columns, m.mean, inverse, "_d2")
    found = exact_quantiles(seen, [], F.sqrt("_d2"), linear_spots([percentile])).first()
    return Distance(columns, m.mean.tolist(), inverse.tolist(), found.quantiles[0] if found else float("nan"), s)


def mahalanobis(df: DataFrame, params: Distance) -> DataFrame:
    """distance and ood; a row with a missing value is out of the domain."""
    from tessera.operators.gram import squared_distance

    out = squared_distance(df, params.columns, np.array(params.mean), np.array(params.inverse), "distance").withColumn("distance", F.sqrt("distance"))
    return out.withColumn("ood", F.coalesce(F.col("distance") > params.threshold, F.lit(True)))


def decorrelated(names: list[str], corr: np.ndarray, limit: float) -> list[str]:
    """First come, first kept: a column is left out if it correlates above the limit with a kept one."""
    kept: list[int] = []
    for k in range(len(names)):
        if all(abs(corr[k, j]) <= limit for j in kept):
            kept.append(k)
    return [names[k] for k in kept]


def linear_folds(df: DataFrame, features: list[str], target: str, fold: str, folds: int) -> list[np.ndarray]:
    """Least squares without each fold, from one pass of sums by fold."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    rows = df.groupBy(fold).agg(*[F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(c * F.col(target)).alias(f"b{i}") for i, c in enumerate(cols)]).collect()
    grams = {}
    for r in rows:
        a, b = np.zeros((len(cols), len(cols))), np.array([r[f"b{i}"] for i in range(len(cols))])
        for i, j in pairs:
            a[i, j] = a[j, i] = r[f"a{i}_{j}"]
        grams[r[fold]] = (a, b)
    out = []
    for k in range(folds):
        a = sum(g[0] for f, g in grams.items() if f != k)
        b = sum(g[1] for f, g in grams.items() if f != k)
        out.append(np.linalg.lstsq(a, b, rcond=None)[0])
    return out


def _predict(features: list[str], w: np.ndarray) -> Column:
    out = F.lit(float(w[0]))
    for f, x in zip(features, w[1:]):
        out = out + F.col(f).cast("double") * float(x)
    return out


def ensemble(df: DataFrame, features: list[str], models: list[np.ndarray], target: str, fold: str, alpha: float) -> DataFrame:
    """Mean and deviation of the fold models, with a conformal interval from the out-of-fold residuals."""
    names = [f"_p{k}" for k in range(len(models))]
    df = df.withColumns({n: _predict(features, w) for n, w in zip(names, models)})
    own = F.element_at(F.array(*[F.col(n) for n in names]), F.col(fold) + 1)
    q = conformal_quantile(df, [], F.col(target) - own, alpha).first()["q"]
    x = across(names)
    return df.withColumns({"mean": x["mean"], "sd": x["sd"]}).withColumns({"low": F.col("mean") - q, "high": F.col("mean") + q}).drop(*names)


def boosted(df: DataFrame, features: list[str], target: str, fold: Column, folds: int, trees: int = 10, depth: int = 4) -> DataFrame:
    """Cross-validated metrics of gradient-boosted trees: fold, r2, rmse, ..."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumn("_fold", fold)).select("_x", "_fold", F.col(target).alias("_y"))
    out = None
    for k in range(folds):
        model = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=trees, maxDepth=depth, seed=1).fit(data.where(F.col("_fold") != k))
        m = regression_metrics(model.transform(data.where(F.col("_fold") == k)), [], "_y", "_p").withColumn("fold", F.lit(k))
        out = m if out is None else out.unionByName(m)
    return out


def out_of_fold(df: DataFrame, key: str, features: list[str], target: str, fold: Column, folds: int, trees: int = 10, depth: int = 4, classify: bool = False, depths: tuple[int, ...] = ()) -> DataFrame:
    """key, fold, y_true, y_pred (y_proba of class 1 with classify) for every row, each from the model that hasn't seen its fold.

    depths: nested validation; the depth of each outer model is that with the least error on the next fold when trained on the rest.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    from tessera.session import stash

    rows = df.dropna(subset=[*features, target]).withColumn("_fold", fold)
    data = stash(VectorAssembler(inputCols=features, outputCol="_x").transform(rows).select(key, "_x", "_fold", F.col(target).cast("double").alias("_y")), "folds")
    make = GBTClassifier if classify else GBTRegressor

    def fitted(train: DataFrame, deep: int):
        return make(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=trees, maxDepth=deep, seed=1).fit(train)

    def predicted(model, part: DataFrame) -> DataFrame:
        p = vector_to_array("probability")[1] if classify else F.col("_p")
        return model.transform(part).select(key, F.col("_fold").alias("fold"), F.col("_y").alias("y_true"), p.alias("y_proba" if classify else "y_pred"))

    out = None
    for k in range(folds):
        rest, deep = data.where(F.col("_fold") != k), depth
        if depths:
            inner = (k + 1) % folds
            p = "y_proba" if classify else "y_pred"
            errors = {d: predicted(fitted(rest.where(F.col("_fold") != inner), d), rest.where(F.col("_fold") == inner)).agg(F.avg(F.pow(F.col("y_true") - F.col(p), F.lit(2.0)))).first()[0] for d in depths}
            deep = min(errors, key=lambda d: (errors[d] is None, errors[d], d))
        part = predicted(fitted(rest, deep), data.where(F.col("_fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def quantile_leaves(train: DataFrame, features: list[str], target: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9), depth: int = 4):
    """A function that adds the target's quantiles in each row's leaf of a regression tree: a quantile model whose leaves are exact."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from tessera.operators.quantiles import exact_quantiles, linear_spots

    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    data = assembler.transform(train.dropna(subset=[*features, target])).select("_x", F.col(target).cast("double").alias("_y"))
    tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_y", predictionCol="_leaf", maxDepth=depth, seed=1).fit(data)
    leaves = exact_quantiles(tree.transform(data), ["_leaf"], F.col("_y"), linear_spots(list(shares)))
    names = [f"q{int(round(100 * s))}" for s in shares]
    table = leaves.select("_leaf", *[F.col("quantiles")[k].alias(n) for k, n in enumerate(names)])  # 2^depth rows

    def predict(df: DataFrame) -> DataFrame:
        return tree.transform(assembler.transform(df.dropna(subset=features))).join(F.broadcast(table), "_leaf").drop("_x", "_leaf")

    return predict


def interval_coverage(df: DataFrame, truth: str, low: str, high: str) -> DataFrame:
    """The share of rows inside their interval, and its mean width."""
    return df.agg(F.avg(((F.col(truth) >= F.col(low)) & (F.col(truth) <= F.col(high))).cast("double")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- selection and search


def _assembled(df: DataFrame, features: list[str], target: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df.dropna(subset=[*features, target])).select("_x", F.col(target).cast("double").alias("_y"), *features)


def _gbt(trees: int = 10, depth: int = 4, rate: float = 0.1, seed: int = 1):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)


def select_features(df: DataFrame, features: list[str], target: str, limit: float = 0.95, elbow: float = 0.005, most: int = 50) -> list[str]:
    """Varying columns, then one of each strongly correlated pair (the one closer to the target stays), then the most important ones
    as long as each adds at least `elbow` of the importance."""
    from tessera.operators.gates import prune_columns
    from tessera.operators.gram import correlations, moments

    kept = prune_columns(df, features)
    both = correlations(moments(df, [*kept, target]))
    corr, strength = both[:-1, :-1], np.abs(both[-1, :-1])
    order = sorted(range(len(kept)), key=lambda i: (-strength[i], kept[i]))
    kept = decorrelated([kept[i] for i in order], corr[np.ix_(order, order)], limit)
    model = _gbt().fit(_assembled(df, kept, target))
    ranked = sorted(zip(model.featureImportances.toArray(), kept), key=lambda p: (-p[0], p[1]))
    return [name for k, (share, name) in enumerate(ranked) if k == 0 or share >= elbow][:most]


def eliminate(df: DataFrame, features: list[str], target: str, fold: Column, step: int = 1, least: int = 1) -> list[tuple[int, float, list[str]]]:
    """Recursive elimination: (features, held-out RMSE, names) as the least important are dropped step by step."""
    data, out, kept = df.withColumn("_fold", fold), [], list(features)
    while len(kept) >= least:
        train, test = (_assembled(data.where(p), kept, target) for p in (F.col("_fold") != 0, F.col("_fold") == 0))
        model = _gbt().fit(train)
        out.append((len(kept), regression_metrics(model.transform(test), [], "_y", "_p", median=False).first()["rmse"], kept))
        if len(kept) == least:
            break
        ranked = sorted(zip(model.featureImportances.toArray(), kept), key=lambda p: (-p[0], p[1]))
        kept = [n for _, n in ranked][: max(least, len(kept) - step)]
    return out


def random_search(df: DataFrame, features: list[str], target: str, fold: Column, trials: int, seed: int = 0) -> list[tuple[float, dict]]:
    """Held-out RMSE of randomly drawn tree settings, best first."""
    r, data = np.random.default_rng(seed), df.withColumn("_fold", fold)
    train, test = (_assembled(data.where(p), features, target).cache() for p in (F.col("_fold") != 0, F.col("_fold") == 0))
    out = []
    for _ in range(trials):
        s = {"trees": int(r.integers(3, 15)), "depth": int(r.integers(2, 6)), "rate": float(r.uniform(0.05, 0.3))}
        out.append((regression_metrics(_gbt(**s).fit(train).transform(test), [], "_y", "_p", median=False).first()["rmse"], s))
    train.unpersist()
    test.unpersist()
    return sorted(out, key=lambda p: p[0])


def permutation_importance(model, df: DataFrame, features: list[str], target: str, key: str, seed: int = 0) -> list[tuple[str, float]]:
    """How much the RMSE rises when a column's values change rows; rows swap within hash parts, so nothing meets in one task."""
    from pyspark.sql.window import Window

    base = regression_metrics(model.transform(_assembled(df, features, target)), [], "_y", "_p", median=False).first()["rmse"]
    out = []
    for c in features:
        part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(64))
        mixed = Window.partitionBy(part).orderBy(F.xxhash64(key, F.lit(seed + 1)))
        n = F.count(F.lit(1)).over(Window.partitionBy(part))
        first = F.first(c).over(mixed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        moved = df.withColumn("_m", F.when(n > 1, F.coalesce(F.lead(c).over(mixed), first)).otherwise(F.col(c))).drop(c).withColumnRenamed("_m", c)
        out.append((c, regression_metrics(model.transform(_assembled(moved, features, target)), [], "_y", "_p", median=False).first()["rmse"] - base))
    return sorted(out, key=lambda p: (-p[1], p[0]))


def embed(df: DataFrame, vector: str, dims: int = 2) -> DataFrame:
    """A linear embedding of vectors: the first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=dims, inputCol="_v", outputCol="_e").fit(data).transform(data).withColumn("embedding_low", vector_to_array("_e")).drop("_v", "_e")


def out_of_domain_curve(df: DataFrame, distance: str, truth: str, pred: str, bins: int = 10) -> DataFrame:
    """Metrics of the predictions by decile of the distance."""
    from tessera.operators.windows import qcut

    return regression_metrics(qcut(df, distance, bins, "decile").where(F.col("decile").isNotNull()), ["decile"], truth, pred)


def decile_holdout(df: DataFrame, distance: str, features: list[str], target: str, bins: int = 10, tail: tuple[float, ...] = (0.925, 0.95, 0.975)) -> DataFrame:
    """kind, bin, n_train, n_test, distance_mean, distance_min, distance_max, r2, rmse, mae: each bin of the distance predicted by a model trained without it.

    kind is decile, or tail for the shares of the highest bin, which its own model predicts.  Bins are quantile bins, fewer
    where edges coincide; a missing distance is in the lowest bin.  Least squares: all models come from one pass of sums.
    """
    from tessera.operators.quantiles import exact_quantiles, linear_spots
    from tessera.operators.windows import digitize, right_closed
    from tessera.session import stash

    rows = stash(df.dropna(subset=[*features, target]), "rows")
    cuts = exact_quantiles(rows, [], F.col(distance), linear_spots([k / bins for k in range(bins + 1)] + list(tail))).first().quantiles
    edges = sorted(set(cuts[: bins + 1]))
    n = max(len(edges) - 1, 1)
    binned = rows.withColumn("bin", F.coalesce(right_closed(F.col(distance), edges), F.lit(0)))
    models = linear_folds(binned, features, target, "bin", n)
    own = F.get(F.array(*[_predict(features, w) for w in models]), F.col("bin"))
    kinds = F.array(F.struct(F.lit("decile").alias("kind"), F.col("bin")), F.when(F.col("bin") == n - 1, F.struct(F.lit("tail").alias("kind"), digitize(F.col(distance), cuts[bins + 1 :]).alias("bin"))))
    seen = binned.withColumn("_p", own).select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("_k"), F.col(distance).alias("_d"), F.col(target).cast("double").alias("_y"), "_p")
    e = F.col("_p") - F.col("_y")
    out = seen.groupBy("_k.kind", "_k.bin").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg("_d").alias("distance_mean"), F.min("_d").alias("distance_min"), F.max("_d").alias("distance_max"),
        (1 - F.sum(e * e) / (F.var_pop("_y") * F.count("_y"))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
    )
    total = rows.count()
    top = F.lit(binned.where(F.col("bin") == n - 1).count())
    return out.withColumn("n_train", F.lit(total) - F.when(F.col("kind") == "tail", top).otherwise(F.col("n_test")))
