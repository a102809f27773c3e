"""Running values, fills, bins, crowding and hypervolume."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quantiles import exact_quantiles, linear_spots, slice_of, with_group_values

#: Slices of about equal size over which a global order is dealt.
SLICES = 1024


def _upto(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_best(df: DataFrame, keys: list[str], order: list, value: str, name: str = "best") -> DataFrame:
    return df.withColumn(name, F.max(value).over(_upto(keys, order)))


def forward_fill(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_upto(keys, order)))


def fill_both(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """The last value so far, or the next one where there is none yet."""
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(_upto(keys, order)), F.first(value, ignorenulls=True).over(after)))


def arrival_index(df: DataFrame, keys: list[str], order: list, name: str = "arrival") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def with_group_mean(df: DataFrame, keys: list[str], value: str, name: str = "group_mean") -> DataFrame:
    """The mean of each row's group, from a partial sum and a join: no group's rows meet in one task."""
    return with_group_values(df, keys, df.groupBy(*keys).agg(F.avg(value).alias(name)))


def progress(df: DataFrame, value: str, name: str = "progress") -> DataFrame:
    """(x - min) / (max - min) over the whole table; the ends come from one row, not from a global window."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(F.broadcast(ends)).withColumn(name, F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")


def running_total(df: DataFrame, order: str, sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Running sums over the whole table in the order of a number that is distinct in it.

    Rows are dealt into slices of about equal size, whose edges a sketch names; a window over the slice totals carries the
    sums across.
    """
    marks = df.agg(F.percentile_approx(F.col(order).cast("double"), [k / SLICES for k in range(1, SLICES)], 10 * SLICES)).first()[0]
    dealt = df.withColumn("_slice", slice_of(F.col(order).cast("double"), sorted({x for x in marks or [] if math.isfinite(x)})))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_slice").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    totals = totals.select("_slice", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    inside = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = dealt.join(F.broadcast(totals), "_slice")
    for c, name in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_before_{c}"))
    return out.drop("_slice", *[f"_before_{c}" for c in sums])


def quantile_edges(df: DataFrame, value: str, q: int) -> list[float]:
    """The distinct q-quantile edges (linear interpolation): q + 1 numbers at most."""
    row = exact_quantiles(df, [], F.col(value), linear_spots([k / q for k in range(q + 1)])).first()
    return sorted(set(row.quantiles)) if row else []


def right_closed(value: Column, edges: list[float]) -> Column:
    """The index of the bin (lo, hi] that holds the value, the first bin closed on both sides."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when(value <= edges[k + 1], F.lit(k)).otherwise(out)
    return F.when(value >= edges[0], out) if edges else out


def qcut(df: DataFrame, value: str, q: int, name: str = "bin") -> DataFrame:
    return df.withColumn(name, right_closed(F.col(value), quantile_edges(df, value, q)))


def cut(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Equal-width bins, closed on the right; the smallest value is in the first."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = F.greatest(F.ceil((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) - 1, F.lit(0)).cast("int")
    return df.join(F.broadcast(ends)).withColumn(name, F.when(F.col("_hi") > F.col("_lo"), b).otherwise(F.lit(0))).drop("_lo", "_hi")


def digitize(value: Column, edges: list[float]) -> Column:
    """The number of edges that are at most the value."""
    return reduce(lambda out, e: out + (value >= e).cast("int"), edges, F.lit(0))


def crowding(df: DataFrame, front: list[str], objectives: list[str], key: str, far: float = 1e308) -> DataFrame:
    """The sum over objectives of the gap between neighbours by the front's range; `far` at the ends and in fronts of two or less."""
    whole = Window.partitionBy(*front)
    parts, ends = [], []
    for c in objectives:
        w = whole.orderBy(F.col(c), F.col(key))
        spread = F.max(c).over(whole) - F.min(c).over(whole)
        parts.append(F.when(spread > 0, (F.lead(c).over(w) - F.lag(c).over(w)) / spread).otherwise(0.0))
        ends += [F.lead(c).over(w).isNull(), F.lag(c).over(w).isNull()]
    at_end = reduce(lambda a, b: a | b, ends) | (F.count(F.lit(1)).over(whole) <= 2)
    return df.withColumn("crowding", F.when(at_end, F.lit(far)).otherwise(reduce(lambda a, b: a + b, parts)))


def hypervolume(df: DataFrame, keys: list[str], x: str, y: str, ref: tuple[float, float]) -> DataFrame:
    """The area that points dominate over the reference (both maximised): a staircase from the largest x down."""
    inside = df.where((F.col(x) > ref[0]) & (F.col(y) > ref[1]))
    steps = inside.groupBy(*keys, x).agg(F.max(y).alias("_y"))
    w = Window.partitionBy(*keys).orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1)
    rise = F.greatest(F.col("_y") - F.coalesce(F.max("_y").over(w), F.lit(ref[1])), F.lit(0.0))
    return steps.withColumn("_a", rise * (F.col(x) - ref[0])).groupBy(*keys).agg(F.sum("_a").alias("hypervolume"))


def stagnation(df: DataFrame, keys: list[str], order: str, value: str, eps: float) -> DataFrame:
    """Steps since the best value last rose by more than eps (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rose = df.withColumn("_rose", (best.isNull() | (F.col(value) > best + eps)).cast("int"))
    rose = rose.withColumn("island", F.sum("_rose").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rose.withColumn("stagnant", (F.row_number().over(Window.partitionBy(*keys, "island").orderBy(order)) - 1).cast("int")).drop("_rose")
