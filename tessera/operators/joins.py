"""Lookups, semi and anti joins, interpolation and threshold grids."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; a larger side is joined by a shuffle.
SMALL = 1_000_000


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcasts a side whose counted size is small."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL else df


def left_chain(base: DataFrame, others: list[tuple[DataFrame, str | list[str]]]) -> DataFrame:
    """base left-joined with each table on its key, in turn."""
    return reduce(lambda acc, other: acc.join(other[0], other[1], "left"), others, base)


def overlap(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join in which the columns of both sides but the key get a suffix."""
    both = set(left.columns) & set(right.columns) - {key}
    name = lambda df, s: df.select(*[F.col(c).alias(c + s if c in both else c) for c in df.columns])
    return name(left, suffixes[0]).join(name(right, suffixes[1]), key)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default, name: str) -> DataFrame:
    """The value of the key in the table (one row for each key), or the default."""
    found = table.select(key, F.col(value).alias("_v"))
    return df.join(found, key, "left").withColumn(name, F.coalesce("_v", F.lit(default))).drop("_v")


def lookup_first(df: DataFrame, tables: list[tuple[DataFrame, str]], key: str, name: str, otherwise: Column) -> DataFrame:
    """The first table that has the key gives the value; where none has, it is computed."""
    for k, (table, value) in enumerate(tables):
        df = df.join(table.select(key, F.col(value).alias(f"_v{k}")), key, "left")
    held = [f"_v{k}" for k in range(len(tables))]
    return df.withColumn(name, F.coalesce(*held, otherwise)).drop(*held)


def seen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_semi")


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")


def novelty(df: DataFrame, known: DataFrame, key: str, name: str = "is_novel") -> DataFrame:
    marked = known.select(key).distinct().withColumn("_k", F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.col("_k").isNull()).drop("_k")


def merge_keep_existing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(unseen(new, existing, key))


def bracket(df: DataFrame, key: list[str], x: str, y: str, at: float, widest: float) -> DataFrame:
    """Per key: y at x = at, from a direct value or from the nearest values on both sides if they are close enough.

    One aggregation: no range join is needed.
    """
    low, high = F.when(F.col(x) < at, F.col(x)), F.when(F.col(x) > at, F.col(x))
    order = lambda v, sign: F.when(v.isNotNull(), F.struct(v * sign, F.col(y)))
    g = df.groupBy(*key).agg(
        F.avg(F.when(F.col(x) == at, F.col(y))).alias("direct"),
        F.max(order(low, 1.0)).alias("lo"),
        F.min(order(high, 1.0)).alias("hi"),
        F.count(F.lit(1)).alias("n"),
    )
    x0, x1, y0, y1 = F.col("lo")["col1"], F.col("hi")["col1"], F.col("lo")[y], F.col("hi")[y]
    usable = x0.isNotNull() & x1.isNotNull() & (x1 - x0 <= widest)
    value = F.when(F.col("direct").isNotNull(), F.col("direct")).when(usable, y0 + (y1 - y0) * (F.lit(at) - x0) / (x1 - x0))
    method = F.when(F.col("direct").isNotNull(), "direct").when(usable, "interpolated").otherwise("none")
    return g.select(*key, value.alias("value"), method.alias("method"), "n")


def interpolate(value: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear, constant outside the knots."""
    knots = sorted(knots)
    out = F.when(value <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(value <= x1, F.lit(y0) + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(value.isNotNull(), F.lit(knots[-1][1]))


def threshold_grid(df: DataFrame, a: str, a_limits: list[float], b: str, b_limits: list[float], value: str) -> DataFrame:
    """For every pair of limits: rows with a >= and b <= them, and their best value; one pass over df.

    The grid is a fixed few cells, so each row is counted in the cells by conditional aggregates, without a join.
    """
    cells = [(x, y) for x in a_limits for y in b_limits]
    inside = lambda c: (F.col(a) >= c[0]) & (F.col(b) <= c[1])
    row = df.agg(*[e for k, c in enumerate(cells) for e in (F.count_if(inside(c)).alias(f"n{k}"), F.max(F.when(inside(c), F.col(value))).alias(f"v{k}"))])
    rows = ", ".join(f"cast({x} as double), cast({y} as double), n{k}, v{k}" for k, (x, y) in enumerate(cells))
    return row.selectExpr(f"stack({len(cells)}, {rows}) as (a_min, b_max, n, best)")


def aligned(curves: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of curves on their step."""
    return reduce(lambda l, r: l.join(r, key, "full"), curves)


def every(preds: list[Column]) -> Column:
    return reduce(operator.and_, preds)
