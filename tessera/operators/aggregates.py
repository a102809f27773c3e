"""Summaries, marginals, variance shares, metrics and pivots."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quantiles import exact_quantiles, linear_spots, with_group_values
from tessera.operators.windows import running_total


def group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def many_stats(df: DataFrame, keys: list[str], values: list[str], stats: tuple[str, ...] = ("avg", "stddev_samp", "min", "max")) -> DataFrame:
    return df.groupBy(*keys).agg(*[getattr(F, s)(v).alias(f"{v}_{s}") for v in values for s in stats])


def marginals(df: DataFrame, parameters: list[str], value: str) -> DataFrame:
    """One row for each level of each parameter, in one pass (grouping sets)."""
    as_text = df.select(*[F.col(p).cast("string").alias(p) for p in parameters], F.col(value).alias("_v"))
    g = as_text.groupingSets([[F.col(p)] for p in parameters], *[F.col(p) for p in parameters]).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"), F.grouping_id().alias("_gid"))
    full = (1 << len(parameters)) - 1
    which = reduce(lambda out, k: F.when(F.col("_gid") == full ^ (1 << (len(parameters) - 1 - k)), F.lit(parameters[k])).otherwise(out), range(len(parameters)), F.lit(None))
    return g.select(which.alias("parameter"), F.coalesce(*parameters).alias("level"), "mean", "n")


def ci95(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def eta_squared(df: DataFrame, parameters: list[str], value: str) -> DataFrame:
    """The share of the variance that each parameter's level means carry, and the rest."""
    m = marginals(df.where(F.col(value).isNotNull()), parameters, value)
    total = df.agg(F.avg(value).alias("grand"), (F.var_pop(value) * F.count(value)).alias("ss"))
    share = m.join(F.broadcast(total)).groupBy("parameter").agg((F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)) / F.max("ss")).alias("eta2"))
    rest = share.agg(F.lit("residual").alias("parameter"), (1 - F.sum("eta2")).alias("eta2"))
    return share.union(rest)


def between_within(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The deviation of the group means and the mean deviation inside groups."""
    return group_stats(df, keys, value).agg(F.stddev_samp("mean").alias("between_sd"), F.avg("sd").alias("within_sd"))


def median_if_steady(df: DataFrame, keys: list[str], value: str, max_sd: float) -> DataFrame:
    """The median of groups that have one row or a small deviation."""
    g = df.groupBy(*keys).agg(F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).where((F.col("n") == 1) | (F.coalesce("sd", F.lit(0.0)) <= max_sd))
    medians = exact_quantiles(df, keys, F.col(value), linear_spots([0.5])).select(*keys, F.col("quantiles")[0].alias("median"))
    return with_group_values(g.drop("sd"), keys, medians).select(*keys, "median", "n")


def two_level(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean and deviation over the means of inner groups."""
    first = df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m"))
    return first.groupBy(*outer).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("sd"), F.count("_m").alias("n"))


def pivot(df: DataFrame, keys: list[str], column: str, values: list, agg: Column, prefix: str = "") -> DataFrame:
    """One column for each of the given values, in one aggregation."""
    out = df.groupBy(*keys).pivot(column, values).agg(agg)
    return out.select(*keys, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def across(columns: list[str]) -> dict[str, Column]:
    """mean, sd, max and sum of each row's non-null values."""
    held = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    n = F.size(held)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.when(n > 0, add(held) / n)
    sd = F.when(n > 1, F.sqrt(add(F.transform(held, lambda x: F.pow(x - mean, 2))) / (n - 1)))
    return {"mean": mean, "sd": sd, "max": F.array_max(held), "sum": add(held)}


def conformal_quantile(df: DataFrame, keys: list[str], residual: Column, alpha: float) -> DataFrame:
    """The residual quantile at the level min((1 - alpha)(n + 1) / n, 1) of every group; without keys, of the whole table."""
    spot = lambda n: [F.least((1 - alpha) * (n + 1) / n, F.lit(1.0)) * (n - 1)]
    return exact_quantiles(df, keys, F.abs(residual), spot).select(*keys, F.col("quantiles")[0].alias("q"), "n")


def regression_metrics(df: DataFrame, keys: list[str], truth: str, pred: str, least: int = 1, median: bool = True) -> DataFrame:
    """r2, rmse, mae, medae (if asked for), bias and n of every group of at least so many rows."""
    e = F.col(pred) - F.col(truth)
    out = df.groupBy(*keys).agg(
        (1 - F.sum(e * e) / (F.var_pop(truth) * F.count(truth))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.count(e).alias("n")
    ).where(F.col("n") >= least)
    if not median:
        return out
    medians = exact_quantiles(df, keys, F.abs(e), linear_spots([0.5])).select(*keys, F.col("quantiles")[0].alias("medae"))
    return with_group_values(out, keys, medians).select(*keys, "r2", "rmse", "mae", "medae", "bias", "n")


def classification_metrics(df: DataFrame, truth: Column, pred: Column, keys: list[str] = ()) -> DataFrame:
    c = df.groupBy(*keys).agg(
        F.count_if(truth & pred).cast("double").alias("tp"), F.count_if(~truth & pred).cast("double").alias("fp"), F.count_if(~truth & ~pred).cast("double").alias("tn"), F.count_if(truth & ~pred).cast("double").alias("fn")
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall, spec = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return c.select(
        *keys, ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), ((recall + spec) / 2).alias("balanced_accuracy"), F.coalesce(precision, F.lit(0.0)).alias("precision"), F.coalesce(recall, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)).alias("mcc"),
    )


def _by_score(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Positives and negatives of every distinct score: what the curves need, after a partial sum."""
    return df.select(truth.alias("_t"), score.alias("score")).groupBy("score").agg(F.count_if("_t").alias("pos"), F.count_if(~F.col("_t")).alias("neg"))


def roc_auc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties counting half."""
    s = running_total(_by_score(df, truth, score), "score", {"neg": "below"}, inclusive=False)
    return s.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """The sum of precision times the step in recall, from the highest score down."""
    s = _by_score(df, truth, score).withColumn("down", -F.col("score"))
    s = running_total(running_total(s, "down", {"pos": "tp"}), "down", {"neg": "fp"})
    return s.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"))


def best_f1(df: DataFrame, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """The threshold of a fixed grid with the best F1, the first if tied; one pass."""
    row = df.agg(*[e for k, t in enumerate(thresholds) for e in (F.count_if(truth & (score >= t)).alias(f"tp{k}"), F.count_if(score >= t).alias(f"p{k}"))], F.count_if(truth).alias("pos"))
    f1 = lambda k: F.when(F.col(f"p{k}") + F.col("pos") > 0, 2.0 * F.col(f"tp{k}") / (F.col(f"p{k}") + F.col("pos"))).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(f1(k).alias("f1"), F.lit(-t).alias("t")) for k, t in enumerate(thresholds)]))
    return row.select((-best["t"]).alias("threshold"), best["f1"].alias("f1"))


def minmax(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Each column scaled to [0, 1] over its finite values (inverted if asked); constant 0.5, not finite 0."""
    fine = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")) for c in columns}
    ends = df.agg(*[f(x).alias(f"_{n}_{c}") for c, x in fine.items() for n, f in (("lo", F.min), ("hi", F.max))])
    df = df.join(F.broadcast(ends))  # one row
    for c, invert in columns.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        x = F.try_divide(fine[c] - lo, hi - lo)
        df = df.withColumn(f"{c}_scaled", F.when(fine[c].isNull(), 0.0).when(hi == lo, 0.5).otherwise(1 - x if invert else x))
    return df.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def weighted_sum(weights: dict[str, float]) -> Column:
    return reduce(operator.add, [F.col(c) * w for c, w in weights.items()])


def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return pivot(df, [row], column, values, F.count(F.lit(1))).fillna(0)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every pair of a fixed few columns, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = ", ".join(f"'{a}', '{b}', r{k}" for k, (a, b) in enumerate(pairs))
    return row.selectExpr(f"stack({len(pairs)}, {rows}) as (a, b, r)")


def bin_rates(df: DataFrame, value: str, flags: list[str], bins: int, low: float, high: float) -> DataFrame:
    """The mean of each flag in equal bins [lo, hi) of the value; rows at the upper end fall out."""
    width = (high - low) / bins
    b = F.floor((F.col(value) - low) / width).cast("int")
    return df.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
