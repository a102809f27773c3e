"""Similarity of fingerprints and vectors; pairs are compared inside tiles and only sums or the nearest leave a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import stash

#: Rows in a tile, at least and at most: a task holds two tiles and compares a block of them at a time.
TILE = (1024, 16384)
STEP = 512
#: Rows of the other tile in a block of words: what is held besides the tiles is a few megabytes, however long they are.
BLOCK = 1024
#: Rows of a group that one round of leader clustering takes in order.
HEAD = 2048


def sign_word(vector: Column, first: int = 1, bits: int = 64) -> Column:
    """The signs of 64 entries, from `first`, as the bits of a long; longer vectors take one word for each 64 entries."""
    bit = lambda a, k: F.shiftleft(a, 1).bitwiseOR((F.get(vector, k - 1) > 0).cast("long"))
    return F.aggregate(F.sequence(F.lit(first), F.lit(first + bits - 1)), F.lit(0).cast("long"), lambda a, k: F.coalesce(bit(a, k), F.shiftleft(a, 1)))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits by all bits of two words; 0 if neither has a bit."""
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either > 0, F.bit_count(a.bitwiseAND(b)) / either).otherwise(0.0)


def _tile_count(n: int) -> int:
    return max(1, -(-n // min(max(n // 8, TILE[0]), TILE[1])))


def _dealt(df: DataFrame, columns: list[str], tile_by: Column, mine: int, theirs: int, side: int) -> DataFrame:
    """Each row once for every tile of the other side: columns, i, j, side."""
    tile = F.pmod(F.xxhash64(tile_by), F.lit(mine)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(theirs - 1)))
    i, j = (tile, other) if side == 0 else (other, tile)
    return df.select(*columns, i.alias("i"), j.alias("j"), F.lit(side).alias("side"))


def _bits(words: np.ndarray) -> np.ndarray:
    return ((words[:, None].view(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def _similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = a @ b.T  # whole numbers up to 64
    either = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    return np.divide(both, np.maximum(either, 1), dtype=np.float64)


def _blocks(mine: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """The similarities of all words of two tiles, block by block."""
    for k in range(0, len(mine), STEP):
        a = _bits(mine[k : k + STEP].copy())
        for j in range(0, len(theirs), BLOCK):
            yield slice(k, k + STEP), slice(j, j + BLOCK), _similarities(a, _bits(theirs[j : j + BLOCK].copy()))


def mean_tanimoto(df: DataFrame, key: str, word: str) -> DataFrame:
    """key, mean_similarity: each row's mean similarity with all other rows, exact.

    Rows of equal words are one counted word.  Every pair of tiles of distinct words is one task that returns a sum for each
    word, so no pair is ever a row.
    """
    rows = df.select(F.col(key).alias(key), F.col(word).alias("w"))
    words = stash(rows.groupBy("w").agg(F.count(F.lit(1)).alias("c")), "words")
    size = words.agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("n")).first()
    n, tiles = size.n or 0, _tile_count(size.d)
    left, right = (_dealt(words, ["w", "c"], F.col("w"), tiles, tiles, side) for side in (0, 1))

    def sums(t: pa.Table) -> pa.Table:
        w, c, side = (t[x].to_numpy() for x in ("w", "c", "side"))
        mine, weight = w[side == 0], c[side == 1].astype(np.float64)
        out = np.zeros(len(mine))
        for rows, others, sim in _blocks(mine, w[side == 1]):
            out[rows] += sim @ weight[others]
        return pa.table({"w": mine, "s": out})

    each = left.union(right).groupBy("i", "j").applyInArrow(sums, "w long, s double").groupBy("w").agg(F.sum("s").alias("s"))
    own = F.when(F.col("w") != 0, 1.0).otherwise(0.0)
    return rows.join(each, "w").select(key, ((F.col("s") - own) / max(n - 1, 1)).alias("mean_similarity"))


def niched(fitness: Column, similarity: Column, tau: float, alpha: float = 1000.0, p: float = 2.0) -> Column:
    return fitness * F.exp(-alpha * F.pow(F.greatest(similarity - tau, F.lit(0.0)), p)) * (1 - similarity)


def nearest(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, rank, neighbour, distance: the k nearest other rows (Euclid), exact; a task compares two tiles."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    tiles = _tile_count(rows.count())
    left, right = (_dealt(rows, ["k", "v"], F.col("k"), tiles, tiles, side) for side in (0, 1))

    def best(t: pa.Table) -> pa.Table:
        key_, side = t["k"].to_numpy(), t["side"].to_numpy()
        v = np.array(t["v"].to_pylist(), np.float64)
        a, b, ka, kb = v[side == 0], v[side == 1], key_[side == 0], key_[side == 1]
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        most = min(k + 1, len(b))
        squares = (b * b).sum(1) if len(b) else None
        step = max(STEP * BLOCK // max(len(b), 1), 32)
        for at in range(0, len(a) if len(b) else 0, step):
            x, who = a[at : at + step], ka[at : at + step]
            rough = squares[None, :] - 2 * (x @ b.T) + (x * x).sum(1)[:, None]
            # candidates by the product form, with room for its rounding; then exact distances
            limit = np.partition(rough, most - 1, axis=1)[:, most - 1 : most]
            r, c = np.nonzero(rough <= limit + 1e-9 * (1 + np.abs(limit) + squares[None, :]))
            exact = np.sqrt(((b[c] - x[r]) ** 2).sum(1))
            other = kb[c] != who[r]
            r, c, exact = r[other], c[other], exact[other]
            order = np.lexsort((kb[c], exact, r))
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            first = place < k
            for part, x_ in zip(out, (who[r[first]], kb[c[first]], exact[first])):
                part.append(x_)
        who, other, distance = (np.concatenate(x) for x in out)
        return pa.table({"k": pa.array(who, pa.int64()), "neighbour": pa.array(other, pa.int64()), "distance": pa.array(distance, pa.float64())})

    each = left.union(right).groupBy("i", "j").applyInArrow(best, "k long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("k").orderBy("distance", "neighbour"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("k").alias(key), "rank", "neighbour", "distance")


def against(queries: DataFrame, df: DataFrame, key: str, word: str, name: str = "best_similarity") -> DataFrame:
    """key, best_similarity: the greatest similarity of each query with any other row of df, exact.

    Distinct words of both sides meet in tiles; a word that two rows of df hold is its own best match.
    """
    words = stash(df.groupBy(F.col(word).alias("w")).agg(F.count(F.lit(1)).alias("c")), "words")
    asked = stash(queries.select(F.col(key).alias(key), F.col(word).alias("w")), "queries")
    distinct = asked.select("w").distinct().withColumn("c", F.lit(0).cast("long"))
    mine, theirs = _tile_count(distinct.count()), _tile_count(words.count())
    both = _dealt(distinct, ["w", "c"], F.col("w"), mine, theirs, 0).union(_dealt(words, ["w", "c"], F.col("w"), theirs, mine, 1))

    def best(t: pa.Table) -> pa.Table:
        w, c, side = (t[x].to_numpy() for x in ("w", "c", "side"))
        mine, theirs, twice = w[side == 0], w[side == 1], c[side == 1] > 1
        out = np.full(len(mine), -1.0)
        for rows, others, sim in _blocks(mine, theirs):
            sim[(mine[rows][:, None] == theirs[others][None, :]) & ~twice[others][None, :]] = -1
            out[rows] = np.maximum(out[rows], sim.max(1))
        return pa.table({"w": mine, "s": out})

    each = both.groupBy("i", "j").applyInArrow(best, "w long, s double").groupBy("w").agg(F.max("s").alias("s"))
    return asked.join(each.where("s >= 0"), "w", "left").select(key, F.col("s").alias(name))


def mean_pairwise(df: DataFrame, key: str, word: str) -> DataFrame:
    """One row: the mean similarity over all pairs."""
    return mean_tanimoto(df, key, word).agg(F.avg("mean_similarity").alias("mean_pairwise"))


def leaders(df: DataFrame, group: str, key: str, word: str, order: str, threshold: float, head: int = HEAD) -> DataFrame:
    """Sphere exclusion within each group: a row joins the first leader at or above the threshold or becomes one.

    Each round takes the first `head` unassigned rows of every group, walks them in order, and gives all later rows that
    one of the new leaders covers to the first of them, inside an expression.  Leaders of earlier rounds cover none
    of the rows left, so the result is that of one walk over the whole group, and no task holds a group.
    """

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by([("o", "ascending"), ("k", "ascending")])
        heads: list[int] = []
        out = []
        for w in t["w"].to_pylist():
            w &= 0xFFFFFFFFFFFFFFFF
            for n, h in enumerate(heads):
                either = (w | h).bit_count()
                if either and (w & h).bit_count() / either >= threshold:
                    out.append(n)
                    break
            else:
                heads.append(w)
                out.append(len(heads) - 1)
        return pa.table({"g": t["g"], "k": t["k"], "w": t["w"], "n": pa.array(out, pa.int32())})

    rest = stash(df.select(F.col(group).cast("long").alias("g"), F.col(key).cast("long").alias("k"), F.col(word).alias("w"), F.col(order).cast("double").alias("o")), "rest")
    before, out = None, []
    while not rest.isEmpty():
        # the first rows of hash parts of a group, then of the group: no part of a large group is ordered whole
        part = F.pmod(F.xxhash64("k"), F.lit(64))
        first = rest.withColumn("p", part).withColumn("r", F.row_number().over(Window.partitionBy("g", "p").orderBy("o", "k"))).where(F.col("r") <= head)
        first = first.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("o", "k"))).where(F.col("r") <= head).select("g", "k", "w", "o")
        walked = stash(first.groupBy("g").applyInArrow(walk, "g long, k long, w long, n int"), "walked")
        taken = walked.groupBy("g").agg((F.max("n") + 1).alias("made"))
        taken = taken.withColumn("start", F.lit(0)) if before is None else taken.join(before, "g", "left").withColumn("start", F.coalesce("total", F.lit(0))).drop("total")
        taken = stash(taken, "taken")
        # a leader is the first row of its number; those rows are listed by number
        names = walked.join(rest.select("k", "o"), "k").groupBy("g", "n").agg(F.min_by("w", F.struct("o", "k")).alias("w"))
        heads = names.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("n", "w")))["w"].alias("heads"))
        out.append(walked.join(taken, "g").select("g", "k", (F.col("start") + F.col("n")).alias("cluster")))
        later = rest.join(walked.select("k"), "k", "left_anti").join(heads, "g").join(taken, "g")
        hit = F.array_position(F.transform("heads", lambda h: tanimoto(F.col("w"), h) >= threshold), True)
        later = stash(later.select("g", "k", "w", "o", "start", hit.alias("hit")), "later")
        out.append(later.where("hit > 0").select("g", "k", (F.col("start") + F.col("hit") - 1).cast("int").alias("cluster")))
        total = taken.select("g", (F.col("start") + F.col("made")).alias("total"))
        before = stash(total if before is None else total.unionByName(before.join(total, "g", "left_anti")), "before")
        rest = later.where("hit = 0").select("g", "k", "w", "o")
    if not out:
        return df.sparkSession.createDataFrame([], f"{group} long, {key} long, cluster int")
    done = reduce(DataFrame.union, out)
    return done.select(F.col("g").alias(group), F.col("k").alias(key), "cluster")
