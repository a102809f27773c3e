"""Gates, filters, funnels and tiers over candidate tables.

A missing value fails every gate: predicates that are null count as false.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt, "==": operator.eq}


def no_nan(c: str | Column) -> Column:
    """NaN as null: comparisons with NaN are true in Spark and must not be."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def holds(*preds: Column) -> Column:
    return F.coalesce(reduce(operator.and_, preds), F.lit(False)) if preds else F.lit(True)


def rule(column: str, compare: str, limit: float) -> Column:
    return _COMPARE[compare](F.col(column), F.lit(limit))


def gate(df: DataFrame, rules: list[tuple[str, str, float]], optional: set[str] = frozenset(), name: str = "is_valid") -> DataFrame:
    """A 0/1 flag: all rules hold. Rules on optional columns that df lacks are passed over."""
    used = [rule(*r) for r in rules if r[0] in df.columns or r[0] not in optional]
    return df.withColumn(name, holds(*used).cast("int"))


def first_failure(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason", passed: str = "ok") -> DataFrame:
    """The name of the first rule that doesn't hold."""
    out = F.lit(passed)
    for reason, pred in reversed(rules):
        out = F.when(~holds(pred), F.lit(reason)).otherwise(out)
    return df.withColumn(name, out)


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, n, n_alone: rows left after each step in turn and rows that hold the step alone, in one pass."""
    aggs, upto = [], []
    for k, (_, pred) in enumerate(steps):
        upto.append(holds(pred))
        aggs += [F.count_if(reduce(operator.and_, upto)).alias(f"n{k}"), F.count_if(holds(pred)).alias(f"a{k}")]
    rows = ", ".join(f"{k}, '{name}', n{k}, a{k}" for k, (name, _) in enumerate(steps))
    return df.agg(*aggs).selectExpr(f"stack({len(steps)}, {rows}) as (step_no, step, n, n_alone)")


def without_outliers(df: DataFrame, columns: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Drops a row if any of its values is out of bounds; missing values are in bounds."""
    bad = lambda c: (c < low if low is not None else F.lit(False)) | (c > high if high is not None else F.lit(False))
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return df.where(~F.coalesce(F.exists(values, lambda c: F.coalesce(bad(c), F.lit(False))), F.lit(False)))


def at_most_or_missing(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) <= limit))


def any_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.coalesce(*columns).isNotNull())


def all_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(holds(*[F.abs(F.col(c)) < float("inf") for c in columns]))


def prune_columns(df: DataFrame, columns: list[str], max_null: float = 0.5) -> list[str]:
    """The columns that are null in at most max_null of the rows and not constant, from one pass."""
    row = df.agg(*[x for k, c in enumerate(columns) for x in (F.avg(F.col(c).isNull().cast("int")).alias(f"n{k}"), F.var_samp(no_nan(F.col(c).cast("double"))).alias(f"v{k}"))]).first()
    return [c for k, c in enumerate(columns) if row[f"n{k}"] is not None and row[f"n{k}"] <= max_null and (row[f"v{k}"] or 0) > 0]


def categorise(cases: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for pred, label in reversed(cases):
        out = F.when(holds(pred), F.lit(label)).otherwise(out)
    return out


def zone(value: Column, p90: Column | float, p95: Column | float) -> Column:
    """green up to p90, amber up to p95, else red; a missing value is red."""
    return categorise([(value <= p90, "green"), (value <= p95, "amber")], "red")


def tier(good: list[Column], steps: list[int]) -> Column:
    """The first k such that at least steps[k] of the conditions hold, counted from 1; one more if none."""
    n = reduce(operator.add, [holds(g).cast("int") for g in good])
    return reduce(lambda out, k: F.when(n >= steps[k], F.lit(k + 1)).otherwise(out), reversed(range(len(steps))), F.lit(len(steps) + 1))


def gate_margins(means: DataFrame, gates: DataFrame, key: list[str]) -> DataFrame:
    """passed and marginal (the limit is within one deviation) for every (key, prop, mean, sd).

    gates: prop, sense ('max' or 'min'), threshold; a fixed few rows.
    """
    j = means.join(F.broadcast(gates), "prop")
    ok = F.when(F.col("sense") == "max", F.col("mean") <= F.col("threshold")).otherwise(F.col("mean") >= F.col("threshold"))
    near = F.abs(F.col("mean") - F.col("threshold")) <= F.col("sd")
    return j.select(*key, "prop", holds(ok).alias("passed"), holds(near).alias("marginal"))
