"""Skylines, front ranks and survivor selection; all objectives are maximised (negate one to minimise).

Equal points do not dominate each other, so all of them stay; rows with a missing objective are dropped first.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.quantiles import slice_of
from tessera.operators.windows import crowding
from tessera.session import stash

#: Hash parts that are thinned on their own before the whole: the skyline of a union is that of the parts' skylines.
PARTS = 64
#: Points that one round compares with all others.
BLOCK = 512


def _known(df: DataFrame, objectives: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in objectives]))


def _front2(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Kept: the best y of its x, and above every y of a larger x."""
    beyond = Window.partitionBy(*keys).orderBy(F.col(x).desc())
    tops = df.groupBy(*keys, x).agg(F.max(y).alias("_top")) if keys else df.groupBy(x).agg(F.max(y).alias("_top"))
    above = F.max("_top").over(beyond.rowsBetween(Window.unboundedPreceding, -1))
    kept = tops.withColumn("_above", above).where(F.col("_above").isNull() | (F.col("_top") > F.col("_above"))).drop("_above")
    return df.join(kept, [*keys, x]).where(F.col(y) == F.col("_top")).drop("_top")


def skyline2(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    keys = list(keys)
    df = _known(df, [x, y])
    parts = df.withColumn("_part", F.pmod(F.xxhash64(x, y), F.lit(PARTS)))
    return _front2(_front2(parts, [*keys, "_part"], x, y).drop("_part"), keys, x, y)


def dominates(a: Column, b: Column, objectives: list[str]) -> Column:
    """Whether the point (a struct) a is as good as b everywhere and better somewhere."""
    return reduce(lambda p, q: p & q, [a[c] >= b[c] for c in objectives]) & reduce(lambda p, q: p | q, [a[c] > b[c] for c in objectives])


def skyline(df: DataFrame, objectives: list[str], block: int = BLOCK) -> DataFrame:
    """Rows that no other row dominates, for any number of objectives.

    Distinct points are taken in blocks of fixed size by falling sum: whatever dominates a point has a larger sum, or the same
    and a larger first objective, so a block's own skyline is final.  It filters all points after the block, as one
    row of an array; the rounds end when no point is left.  No two unbounded sides are compared.
    """
    df = _known(df, objectives)
    bounded = lambda c: F.greatest(F.least(F.col(c).cast("double"), F.lit(1e300)), F.lit(-1e300))
    points = df.select(*objectives).distinct().withColumn("_sum", reduce(lambda a, b: a + b, [bounded(c) for c in objectives]))
    fields = ["_sum", *objectives]
    rest, fronts = stash(points, "points"), []
    while True:
        top = rest.orderBy(*[F.col(c).desc() for c in fields]).limit(block).agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("t"))
        own = F.filter("t", lambda p: ~F.exists("t", lambda q: dominates(q, p, objectives)))
        held = stash(top.select(own.alias("front"), F.try_element_at("t", F.lit(-1)).alias("last")).where("last is not null"), "front")
        if held.isEmpty():
            break
        fronts.append(held.select(F.explode("front").alias("p")).select(*[F.col("p")[c].alias(c) for c in objectives]))
        point = F.struct(*fields)
        after = rest.withColumn("_front", held.select("front").scalar()).where(point < held.select("last").scalar())
        rest = stash(after.where(~F.exists("_front", lambda q: dominates(q, point, objectives))).drop("_front"), "points")
    if not fronts:
        return df
    best = reduce(DataFrame.union, fronts)
    return df.join(best, objectives, "left_semi")


def front_ranks(df: DataFrame, objectives: list[str], key: str, depth: int | None = None) -> DataFrame:
    """All fronts (or the first `depth`), numbered from 0, by peeling; each front is written down, so the plan doesn't grow."""
    rest, out = stash(_known(df, objectives), "front"), []
    while depth is None or len(out) < depth:
        front = stash(skyline(rest, objectives).withColumn("front", F.lit(len(out))), "front")
        if front.isEmpty():
            break
        out.append(front)
        rest = stash(rest.join(front.select(*objectives).distinct(), objectives, "left_anti"), "front")
    return reduce(DataFrame.unionByName, out) if out else rest.withColumn("front", F.lit(0))


#: Distinct points of a cell of the plane in `all_fronts`.
CELL = 200_000


def _sweep(x: np.ndarray, y: np.ndarray, tops: np.ndarray, rights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The front of each point of a cell, and what the cells beyond need to know.

    tops[r]: the largest y of a point of this row of cells, further right, in front r or later; rights[r]: the largest x
    of such a point in the rows above.  Both fall with r.  A point's front is the number of r for which either reaches it.
    """
    order = np.lexsort((-y, -x))
    front = np.zeros(len(x), np.int64)
    reached = -np.asarray(tops, float)  # rises, for searchsorted
    held = len(reached)
    reached = np.append(reached, np.full(len(x) + len(rights) + 1, np.inf))
    above = np.searchsorted(-np.asarray(rights, float), -x, "right")
    for k in order.tolist():
        here = int(np.searchsorted(reached[:held], -y[k], "right"))
        front[k] = f = max(here, int(above[k]))
        reached[here : f + 1] = -y[k]  # those that didn't reach y yet
        held = max(held, f + 1)
    own = np.full(int(front.max(initial=-1)) + 1, -np.inf)
    np.maximum.at(own, front, x)
    own = np.maximum.accumulate(own[::-1])[::-1]  # in front r or later
    out = np.full(max(len(own), len(rights), len(tops)), -np.inf)
    out[: len(own)] = own
    out[: len(rights)] = np.maximum(out[: len(rights)], rights)
    out[: len(tops)] = np.inf  # points further right are right of all that lies below this cell
    return front, -reached[:held], out


def all_fronts(df: DataFrame, x: str, y: str, cell: int = CELL) -> DataFrame:
    """df with `front`, from 0, for every front of two objectives: as many jobs as the plane has diagonals of cells, however many fronts there are.

    A point's front is the length of the longest chain of points that dominate each other down to it.  The plane is cut
    into rows and columns of about equal numbers of points; a cell needs its neighbours to the right and above, so the
    cells of a diagonal are done together.
    """
    df = _known(df, [x, y])
    points = stash(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct(), "points")
    parts = max(1, math.ceil(math.sqrt(points.count() / cell)))
    shares = [k / parts for k in range(1, parts)]
    marks = points.agg(*[F.percentile_approx(c, shares, 10_000) for c in ("x", "y")]).first() if shares else ([], [])
    # numbered from the right and from above
    place = {c: F.lit(parts - 1) - F.least(slice_of(F.col(c), sorted(set(m or []))), F.lit(parts - 1)) for c, m in zip(("x", "y"), marks)}
    cells = stash(points.select(place["x"].cast("int").alias("i"), place["y"].cast("int").alias("j"), "x", "y"), "cells")
    schema = "i int, j int, x double, y double, front long, tops array<double>, rights array<double>"

    def solve(own: pa.Table, known: pa.Table) -> pa.Table:
        t = own if len(own) else known
        i, j = t[0][0].as_py(), t[1][0].as_py()
        state = {k: next((v for v in known[k].to_pylist() if v is not None), []) for k in ("tops", "rights")}
        px, py = own["x"].to_numpy().astype(float), own["y"].to_numpy().astype(float)
        front, tops, rights = _sweep(px, py, np.array(state["tops"]), np.array(state["rights"]))
        n = len(px)
        none = [None] * n
        cols = [[i] * n + [i + 1, i], [j] * n + [j, j + 1], [*px, None, None], [*py, None, None], [*front.tolist(), None, None], [*none, tops.tolist(), None], [*none, None, rights.tolist()]]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["i", "j", "x", "y", "front", "tops", "rights"])

    state, out = cells.sparkSession.createDataFrame([], "a int, b int, tops array<double>, rights array<double>"), []
    for wave in range(2 * parts - 1):
        here = cells.where(F.col("i") + F.col("j") == wave)
        done = stash(here.groupBy("i", "j").cogroup(state.groupBy("a", "b")).applyInArrow(solve, schema), "wave")
        out.append(done.where("front is not null").select("x", "y", "front"))
        state = done.where(f"front is null and i < {parts} and j < {parts}").select(F.col("i").alias("a"), F.col("j").alias("b"), "tops", "rights")
    ranks = reduce(DataFrame.union, out).select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("front").cast("int").alias("front"))
    return df.join(ranks, (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y"))).drop("_x", "_y")


def survivors(df: DataFrame, objectives: list[str], key: str, n: int, depth: int | None = None) -> DataFrame:
    """n rows by front, then by crowding within the front; fronts are peeled until they hold n rows."""
    rest, out, held = stash(_known(df, objectives), "front"), [], 0
    while held < n and (depth is None or len(out) < depth):
        front = stash(skyline(rest, objectives).withColumn("front", F.lit(len(out))), "front")
        if not (size := front.count()):
            break
        held += size
        out.append(front)
        rest = stash(rest.join(front.select(*objectives).distinct(), objectives, "left_anti"), "front")
    ranked = crowding(reduce(DataFrame.unionByName, out) if out else rest.withColumn("front", F.lit(0)), ["front"], objectives, key)
    return ranked.orderBy("front", F.col("crowding").desc(), key).limit(n)


def objectives_of(value: Column, valid: Column, bad: float) -> Column:
    return F.when(F.coalesce(valid, F.lit(False)), value).otherwise(F.lit(bad))


def merged_front(fronts: list[DataFrame], x: str, y: str) -> DataFrame:
    return skyline2(reduce(DataFrame.unionByName, fronts).distinct(), x, y)
