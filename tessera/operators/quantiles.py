"""Exact quantiles of groups of any size, whatever the distribution.

Values are written down once.  In groups of bounded size they are counted by value and ranks are located among them.  For
larger ones a sketch names values around each wanted rank; the values below are counted, those between are kept, and so
on until few are left: what is ordered in one task is bounded, and the sketch decides only where to look.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stash

#: Rows of a group that may be ordered in one task.
FEW = 1 << 20
#: Equal shares of the rows between which a sketch tells, and its relative precision (1 / 10,000 of the rows).
SHARES, PRECISION = 256, 10_000


def linear_spots(shares: list[float]) -> Callable[[Column], list[Column]]:
    """Ranks (from 0, with fractions) of shares of the rows, as linear interpolation has them."""
    return lambda n: [(n - 1) * F.lit(float(p)) for p in shares]


def _located(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """_key, _i and q: the interpolated value at rank _a of each group; rows has _key and _v, wanted _key, _i and _a."""
    each = rows.groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_key").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_first", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    spots = wanted.groupBy("_key").agg(F.collect_list(F.struct("_i", "_a")).alias("_at"))
    inside = lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_c"))
    held = each.join(spots, "_key").withColumn("_at", F.filter("_at", lambda s: inside(F.floor(s["_a"])) | inside(F.ceil(s["_a"])))).where(F.size("_at") > 0)
    found = held.select("_key", "_v", "_first", "_c", F.explode("_at").alias("_s")).select("_key", "_v", "_first", "_c", F.col("_s._i").alias("_i"), F.col("_s._a").alias("_a"))
    ends = found.groupBy("_key", "_i", "_a").agg(F.max(F.when(inside(F.floor("_a")), F.col("_v"))).alias("_low"), F.max(F.when(inside(F.ceil("_a")), F.col("_v"))).alias("_high"))
    share = F.col("_a") - F.floor("_a")
    return ends.select("_key", "_i", F.when((share == 0) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("q"))


def _nearer(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows around each wanted rank, as groups of their own, and the ranks among them."""
    marks = rows.groupBy("_key").agg(F.percentile_approx("_v", [k / SHARES for k in range(SHARES + 1)], PRECISION).alias("_e"), F.count(F.lit(1)).alias("_n"))
    share = lambda rank: rank / F.col("_n") * SHARES
    # a share and a rank further out than the rank itself
    down, up = (F.floor(share(F.col("_a") - 1)) - 1).cast("int"), (F.ceil(share(F.col("_a") + 2)) + 1).cast("int")
    low = F.when(down >= 1, F.get("_e", down)).otherwise(F.lit(float("-inf")))
    high = F.when(up <= SHARES - 1, F.get("_e", up)).otherwise(F.lit(float("inf")))
    sought = stash(wanted.join(marks, "_key").select("_key", "_i", "_a", low.alias("_low"), high.alias("_high")), "sought")
    by_key = sought.groupBy("_key").agg(F.collect_list(F.struct("_i", "_low", "_high")).alias("_s"))
    near = rows.join(by_key, "_key").select("_key", "_v", F.explode("_s").alias("_s")).where(F.col("_v") <= F.col("_s._high"))
    below = near.where(F.col("_v") < F.col("_s._low")).groupBy("_key", F.col("_s._i").alias("_i")).agg(F.count(F.lit(1)).alias("_below"))
    kept = stash(near.where(F.col("_v") >= F.col("_s._low")).select(F.struct("_key", F.col("_s._i").alias("i")).alias("_key"), "_v"), "near")
    left = sought.join(below, ["_key", "_i"], "left").select(F.struct("_key", F.col("_i").alias("i")).alias("_key"), F.lit(0).alias("_i"), (F.col("_a") - F.coalesce("_below", F.lit(0))).alias("_a"))
    return kept, stash(left, "sought")


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, spots: Callable[[Column], list[Column]]) -> DataFrame:
    """keys, n and the array `quantiles`: the values at the ranks spots(n) of every group, interpolated; missing values don't count."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = stash(df.select(key.alias("_key"), value.cast("double").alias("_v")).where("_v is not null"), "values")
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    wanted = sizes.select("_key", F.posexplode(F.array(*[a.cast("double") for a in spots(F.col("_n"))])).alias("_i", "_a"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    depth = 0
    while most > FEW:
        rows, wanted = _nearer(rows, wanted)
        depth += 1
        before, most = most, rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
        if most > before // 2:  # few values that come very often: they are counted by value
            break
    found = _located(rows, wanted)
    if depth:
        # groups are (group, rank) now, one level for each round
        inner = F.col("_key")
        for _ in range(depth - 1):
            inner = inner["_key"]
        found = found.select(inner["_key"].alias("_key"), inner["i"].alias("_i"), "q")
    out = found.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_i", "q")))["q"].alias("quantiles")).join(sizes, "_key")
    return out.select(*[F.col("_key")[k].alias(k) for k in keys], F.col("_n").alias("n"), "quantiles")


def slice_of(value: Column, edges: list[float]) -> Column:
    """How many of the rising edges lie below the value, by halving."""
    if not edges:
        return F.lit(0)
    text = F.from_json(F.lit(json.dumps(edges)), "array<double>")
    steps = [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(text, at + step - 1) < value, at + step).otherwise(at))


def with_group_values(df: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """df with the row of values of its group; null keys are a group."""
    if not keys:
        return df.join(F.broadcast(values))
    names = [f"_k{i}" for i in range(len(keys))]
    right = values.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in values.columns if c not in keys])
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & df[k].eqNullSafe(right[n])
    return df.join(right, same, "left").drop(*names)
