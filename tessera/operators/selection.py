"""Deduplication, top-k, elites, caps and samples, all with a total order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quantiles import with_group_values


def _ranked(df: DataFrame, keys: list, order: list[Column], name: str = "_rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return _ranked(df, keys, order).where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: list[str], priority: Column, ties: list[Column]) -> DataFrame:
    """The row of the highest source priority for each key."""
    return keep_best(df, keys, [priority.desc(), *ties])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def numbered(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows with their rank; only k rows meet in one task."""
    return top_k(df, order, k).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("int"))


def hybrid_elite(df: DataFrame, first: list[Column], n: int, second: list[Column], m: int, key: str) -> DataFrame:
    """The best n by one order and the best m of the rest by another."""
    best = top_k(df, first, n).withColumn("pick", F.lit("first"))
    rest = top_k(df.join(best.select(key), key, "left_anti"), second, m).withColumn("pick", F.lit("second"))
    return best.unionByName(rest)


def groupwise_top(df: DataFrame, keys: list[str], orders: list[list[Column]], k: int) -> DataFrame:
    """Rows among the first k of their group in any of the orders."""
    names = [f"_r{i}" for i in range(len(orders))]
    for name, order in zip(names, orders):
        df = _ranked(df, keys, order, name)
    return df.where(F.least(*names) <= k if len(names) > 1 else F.col(names[0]) <= k).drop(*names)


def capped(df: DataFrame, keys: list[str], arrival: list[Column], cap: int) -> DataFrame:
    """The first cap arrivals of each key."""
    return _ranked(df, keys, arrival).where(F.col("_rn") <= cap).drop("_rn")


def draw(key: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that depends on the key and the seed only."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def random_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return top_k(df, [draw(F.col(key), seed), F.col(key)], n)


#: Equal slices of the draws; only one of them is ordered in each stratum.
SLICES = 16384


def stratified(df: DataFrame, strata: list[str], key: str, fraction: float, seed: int = 0) -> DataFrame:
    """floor(fraction * size) rows of every stratum, one at least: those of the smallest draws.

    Draws are counted by slice, which tells the slice of the last place; rows of earlier slices are taken unordered, and
    only those of that slice are ranked.
    """
    dealt = df.withColumn("_draw", draw(F.col(key), seed)).withColumn("_slice", F.floor(F.col("_draw") * SLICES).cast("int"))
    counts = dealt.groupBy(*strata, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*strata)  # at most SLICES rows
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).withColumn("_take", F.greatest(F.lit(1), F.floor(F.sum("_c").over(whole) * fraction)))
    last = counts.where((F.col("_before") < F.col("_take")) & (F.col("_take") <= F.col("_before") + F.col("_c"))).select(*strata, F.col("_slice").alias("_last"), (F.col("_take") - F.col("_before")).alias("_rest"))
    near = with_group_values(dealt, strata, last).where(F.col("_slice") <= F.col("_last"))
    ranked = _ranked(near.where(F.col("_slice") == F.col("_last")), strata, [F.col("_draw"), F.col(key)]).where(F.col("_rn") <= F.col("_rest"))
    return near.where(F.col("_slice") < F.col("_last")).select(*df.columns).unionByName(ranked.select(*df.columns))


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: int = 0, floor: float = 0.01) -> DataFrame:
    """n rows without replacement, with chances by weight (exponential keys)."""
    arrival = -F.log(draw(F.col(key), seed)) / F.greatest(weight, F.lit(floor))
    return top_k(df.withColumn("_key", arrival), [F.col("_key"), F.col(key)], n).drop("_key")


def fine_draw(text: Column) -> Column:
    """A uniform number in [0, 1) of 52 bits that depends on the text only."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Parts of the range of draws that are numbered by themselves; their counts are broadcast.
PARTS = 65_536


def row_numbers(df: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """df with the numbers 0 .. n - 1 in the order of (draw, key): counted parts of the draws' range, numbered inside each."""
    parts = min(PARTS, 1 + df.count() // 1000)
    dealt = df.withColumn("_draw", F.coalesce(draw(F.col(key), seed), F.lit(0.0))).withColumn("_part", F.floor(F.col("_draw") * parts).cast("int"))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # PARTS rows at most
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_draw", key))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside - 1).drop("_part", "_draw", "_before")


def tournaments(df: DataFrame, key: str, score: list[Column], rounds: int, k: int, seed: int = 0) -> DataFrame:
    """The winner of each of `rounds` tournaments of k different entrants (all rows if there are fewer), every set of k equally likely.

    A tournament draws k row numbers: the j-th among those not drawn yet, shifted past the drawn ones in order.  The
    numbers meet their rows in one equi-join.
    """
    rows = row_numbers(df, key, seed, "_number")
    n = df.count()
    k = min(k, n)

    def drawn(t: Column) -> Column:
        """k different numbers below n, in rising order."""

        def add(have: Column, j: Column) -> Column:
            u = F.floor(fine_draw(F.concat_ws("#", t.cast("string"), j.cast("string"), F.lit(str(seed)))) * (F.lit(n) - j))
            return F.array_sort(F.concat(have, F.array(F.aggregate(have, u, lambda x, taken: x + F.when(x >= taken, 1).otherwise(0)))))

        return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), add) if k else F.array().cast("array<bigint>")

    entrants = df.sparkSession.range(rounds).select(F.col("id").cast("int").alias("tournament"), F.explode(drawn(F.col("id"))).alias("_number"))
    return keep_best(rows.join(entrants, "_number").drop("_number"), ["tournament"], [*score, F.col(key)])


def multinomial(df: DataFrame, key: str, n: int, seed: int = 0, weight: Column | None = None, heavy: int = 4096) -> DataFrame:
    """df with `copies`: how often each row is drawn in exactly n draws with replacement, by weight; rows never drawn are left out.

    Weights become whole units (2^-52 of their sum) on a line.  Rows of a heavy-th of all weight or more lie first, each a
    slice of its own; the others are dealt into slices by their draws.  A draw looks its slice up in the broadcast slice
    starts; draws of heavy rows are only counted, the others are merged with the rows of their slice in the line's order.
    Missing and negative weights count as 0.
    """
    w = F.greatest(F.coalesce((weight if weight is not None else F.lit(1.0)).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumn("_w", w).where("_w > 0")
    total, count = rows.agg(F.sum("_w"), F.count(F.lit(1))).first()
    if not total or n <= 0:
        return df.limit(0).withColumn("copies", F.lit(0).cast("long"))
    scale = 2.0 ** math.floor(52 - math.log2(total))
    parts = min(PARTS, 1 + count // 1000)
    rows = rows.withColumn("_w", F.greatest(F.floor(F.col("_w") * scale + 0.5), F.lit(1)))
    units = rows.agg(F.sum("_w")).first()[0]
    rows = rows.withColumn("_draw", F.coalesce(draw(F.col(key), seed), F.lit(0.0))).withColumn("_heavy", F.col("_w") >= F.lit(units / heavy))

    few = rows.where("_heavy").withColumn("_start", F.sum("_w").over(Window.orderBy("_draw", key)) - F.col("_w"))  # `heavy` rows at most
    many = rows.where("not _heavy").withColumn("_part", F.floor(F.col("_draw") * parts).cast("int"))
    sums = many.groupBy("_part").agg(F.sum("_w").alias("_w"))
    first = units - (sums.agg(F.sum("_w")).first()[0] or 0)
    starts = sums.withColumn("_start", first + F.sum("_w").over(Window.orderBy("_part")) - F.col("_w"))  # PARTS rows at most
    slices = sorted([(r._start, -1 - k) for k, r in enumerate(few.select("_start").orderBy("_start").collect())] + [(r._start, r._part) for r in starts.select("_start", "_part").collect()])
    edges, ids = np.array([x for x, _ in slices]), np.array([x for _, x in slices])

    @F.pandas_udf("int")
    def slice_of(at: pd.Series) -> pd.Series:
        return pd.Series(ids[np.searchsorted(edges, at.to_numpy(), "right") - 1])

    at = F.floor(fine_draw(F.concat_ws("#", F.col("id").cast("string"), F.lit(str(seed)))) * units)
    draws = df.sparkSession.range(n).select(at.alias("_at")).withColumn("_part", slice_of("_at"))

    counted = draws.where("_part < 0").groupBy((-1 - F.col("_part")).alias("_k")).agg(F.count(F.lit(1)).alias("copies"))
    numbered = few.withColumn("_k", F.row_number().over(Window.orderBy("_start")) - 1)
    hit = numbered.join(F.broadcast(counted), "_k").select(*df.columns, "copies")

    inside = Window.partitionBy("_part").orderBy("_draw", key)
    line = many.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn("_at", F.col("_start") + F.sum("_w").over(inside) - F.col("_w"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    both = line.select("_part", "_at", row, F.lit(0).alias("_kind")).unionByName(draws.where("_part >= 0").select("_part", "_at", F.lit(1).alias("_kind")), allowMissingColumns=True)
    owner = F.last("_at_row", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at", "_kind"))
    found = both.withColumn("_at_row", F.when(F.col("_kind") == 0, F.col("_at"))).withColumn("_owner", owner)
    each = found.groupBy("_part", "_owner").agg(F.first("_row", ignorenulls=True).alias("_row"), F.sum("_kind").cast("long").alias("copies")).where("copies > 0")
    return hit.unionByName(each.select("_row.*", "copies"))


def oversample(df: DataFrame, label: str, minority, times: int) -> DataFrame:
    copies = F.when(F.col(label) == minority, F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy", F.explode(copies))


def replay_buffer(df: DataFrame, group: str, order: list[Column], per_group: int, size: int) -> DataFrame:
    """The best `size` rows after each group is cut to its best per_group."""
    return top_k(capped(df, [group], order, per_group), order, size)
