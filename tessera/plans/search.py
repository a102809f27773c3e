"""Evolutionary search: each generation is a chain of DataFrame jobs, and elites and history are written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import chem as C
from tessera.operators import pareto as P
from tessera.operators import selection as T
from tessera.plans.registry import query
from tessera.session import stash

Score = Callable[[DataFrame], DataFrame]


def crossed(parents: DataFrame, seed: int, high: int) -> DataFrame:
    """Children of parents paired by rank in a seeded order; every pair is fixed by its two strings."""
    order = Window.orderBy(F.xxhash64("smiles", F.lit(seed)), "smiles")
    pairs = parents.select("smiles", (F.row_number().over(order) - 1).alias("n")).groupBy(F.floor(F.col("n") / 2).alias("pair")).agg(F.min("smiles").alias("a"), F.max("smiles").alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kids = [k for a, b in zip(f["a"], f["b"]) for k in C.crossover(a, b, xxhash.xxh3_64_intdigest(f"{a}|{b}|{seed}"), high)]
            yield pd.DataFrame({"smiles": pd.Series(kids, dtype="object")})

    return pairs.select("a", "b").mapInPandas(run, "smiles string")


def evolve(initial: DataFrame, score: Score, generations: int, size: int, seed: int = 0, low: int = 4, high: int = 30, patience: int = 5, eps: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(elites, history): keeps the best `size` of elites and new valid molecules; a stale search takes in fresh mutants.

    score adds fitness (higher is better) and is_valid; initial has canonical smiles.
    """
    order = [F.col("fitness").desc(), F.col("smiles")]
    history = stash(score(initial.select("smiles").distinct()).withColumn("generation", F.lit(0)), "history")
    elites = stash(T.top_k(history.where("is_valid = 1"), order, size), "elites")
    best, stale = None, 0
    for g in range(1, generations + 1):
        top = elites.agg(F.max("fitness")).first()[0]
        stale = 0 if best is None or (top is not None and top > best + eps) else stale + 1
        best = top if best is None or (top is not None and top > best) else best
        rounds = 2 if stale >= patience else 1
        kids = C.next_generation(elites, "smiles", history, g, seed, low, high, rounds).union(crossed(elites, seed * 1000 + g, high))
        fresh = kids.distinct().join(history.select("smiles"), "smiles", "left_anti")
        scored = stash(score(fresh).withColumn("generation", F.lit(g)), "scored")
        history = stash(history.unionByName(scored), "history")
        elites = stash(T.top_k(elites.unionByName(scored.where("is_valid = 1")), order, size), "elites")
    return elites, history


def evolve_fronts(initial: DataFrame, score: Score, objectives: list[str], generations: int, size: int, seed: int = 0, low: int = 4, high: int = 30) -> DataFrame:
    """Survivors by front and crowding; score adds the objectives, with invalid molecules at a bad value."""
    pool = stash(score(initial.select("smiles").distinct()), "pool")
    seen = pool.select("smiles")
    for g in range(1, generations + 1):
        kids = stash(score(C.next_generation(pool, "smiles", seen, g, seed, low, high, 1)), "kids")
        seen = stash(seen.union(kids.select("smiles")), "seen")
        both = pool.select("smiles", *objectives).unionByName(kids.select("smiles", *objectives))
        pool = stash(P.survivors(both, objectives, "smiles", size).select("smiles", *objectives), "pool")
    return pool


def describe(df: DataFrame) -> DataFrame:
    """A worked score: heavier molecules with more ether links and fewer rings are fitter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s in f["smiles"]:
                d = C.descriptors(s)
                ok = d is not None and not C.banned(s)
                ether = C.group_counts(s)["ether"] if d else 0
                rows.append((s, float(ether) - 0.5 * d[4] - abs(d[1] - 14) / 14 if d else -9.0, -d[0] if d else -1e6, float(ether) if ok else 0.0, int(ok)))
            yield pd.DataFrame(rows, columns=["smiles", "fitness", "light", "ethers", "is_valid"])

    return df.select("smiles").mapInPandas(run, "smiles string, fitness double, light double, ethers double, is_valid int")


START = ["CCCCO", "CCOCC", "CCCCCC", "COCCOC", "CC(C)CO", "c1ccccc1C", "CCCC(=O)OC"]


@query()
def evolve_run(spark, d):
    first = spark.createDataFrame([(C.canonical_smiles(s),) for s in START], "smiles string")
    return evolve(first, describe, 2, 10)[0].select("smiles", "fitness", "generation")


@query()
def evolve_fronts_run(spark, d):
    first = spark.createDataFrame([(C.canonical_smiles(s),) for s in START], "smiles string")
    return evolve_fronts(first, describe, ["light", "ethers"], 2, 8)


@query()
def measurement_records(spark, d):
    from tessera.sources.measurements import at_25c, records, valid

    text = ["12 CH4O methanol [67-56-1]", "T/K 293.2 298.2 303.2", "eps 33.6 32.6 31.7 51AB", "13 C2H6O ethanol [64-17-5]", "T/K 290.0 310.0", "eps 25.0 23.0"]
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "file string, line int, value string")
    return at_25c(valid(records(lines, ["file"], "line", "value")))
