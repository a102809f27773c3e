"""Neural regressors trained by gradients that are summed over all tasks.

Rows are standardised, dealt into slices by their key's hash and written once, a folder for each slice.  A step reads one
slice; every task returns the summed gradient of its rows for all models that are trained together (folds), sums are
merged in a second level when there are many tasks, and the driver makes one Adam step on a few thousand weights.
Weights are kept as a Parquet table.  Rows with a missing value neither train nor get a prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stash

#: Tasks whose sums the driver merges by itself.
FAN_IN = 64


@dataclass(frozen=True)
class Network:
    """Layers of tanh units and a linear output, on standardised values."""

    features: list[str]
    sizes: list[int]  # inputs, hidden layers, 1
    weights: np.ndarray  # all layers: matrix (row by row), then biases
    centre: np.ndarray  # of the features and the target
    spread: np.ndarray


def _layers(sizes: list[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(sizes: list[int], seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    return np.concatenate([np.append(r.normal(0, 1 / math.sqrt(a), a * b), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])


def forward(sizes: list[int], flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    layers = _layers(sizes, flat)
    for w, b in layers[:-1]:
        x = np.tanh(x @ w + b)
    return (x @ layers[-1][0] + layers[-1][1])[:, 0]


def gradient(sizes: list[int], flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the summed squared error and its gradient."""
    layers, seen = _layers(sizes, flat), [x]
    for w, b in layers[:-1]:
        seen.append(np.tanh(seen[-1] @ w + b))
    back = (seen[-1] @ layers[-1][0] + layers[-1][1]) - y[:, None]
    loss, parts = 0.5 * float((back**2).sum()), []
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.append((seen[k].T @ back).ravel(), back.sum(axis=0)))
        if k:
            back = (back @ layers[k][0].T) * (1 - seen[k] ** 2)
    return loss, np.concatenate(parts[::-1])


class Adam:
    def __init__(self, n: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(n), np.zeros(n), 0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


_SUMS = "model int, part int, n long, loss double, g binary"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for model, _, n, loss, g in zip(*(c.to_pylist() for c in batch.columns)):
            old = total.setdefault(model, [0, 0.0, 0.0])
            total[model] = [old[0] + n, old[1] + loss, old[2] + np.frombuffer(g)]
    yield _sums(total)


def _sums(total: dict[int, list]) -> pa.RecordBatch:
    rows = [(m, TaskContext.get().partitionId(), n, loss, np.asarray(g, float).tobytes()) for m, (n, loss, g) in sorted(total.items())]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary()]
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["model", "part", "n", "loss", "g"])


def summed(rows: DataFrame, sizes: list[int], weights: list[np.ndarray]) -> list[tuple[int, float, np.ndarray]]:
    """Rows, loss and gradient of each model over the rows that it uses; rows has x, y and use (a flag for each model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(0).values.to_numpy().reshape(len(batch), -1)[:, : sizes[0]]
            y = batch.column(1).to_numpy()
            use = batch.column(2).values.to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for k, flat in enumerate(weights):
                loss, g = gradient(sizes, flat, x[use[:, k]], y[use[:, k]])
                old = total.setdefault(k, [0, 0.0, 0.0])
                total[k] = [old[0] + int(use[:, k].sum()), old[1] + loss, old[2] + g]
        yield _sums(total)

    parts = rows.select("x", "y", "use").mapInArrow(run, _SUMS)
    if (tasks := rows.rdd.getNumPartitions()) > FAN_IN:
        parts = parts.repartition(math.ceil(math.sqrt(tasks))).mapInArrow(_merged, _SUMS)
    out = [[0, 0.0, np.zeros(len(weights[0]))] for _ in weights]
    for r in sorted(parts.collect(), key=lambda r: (r.model, r.part)):
        o = out[r.model]
        out[r.model] = [o[0] + r.n, o[1] + r.loss, o[2] + np.frombuffer(r.g)]
    return [tuple(o) for o in out]


def fit_networks(
    df: DataFrame, key: str, features: list[str], target: str, use: dict[str, Column], hidden: tuple[int, ...] = (16,), steps: int = 100, rate: float = 0.02, decay: float = 1e-4, slices: int = 4, seed: int = 0
) -> tuple[dict[str, Network], list[list[float]]]:
    """A network for each name in use (a condition on the rows that train it), and the mean loss of every step by name."""
    known = df.dropna(subset=[*features, target])
    columns = [*features, target]
    row = known.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    centre = np.array([row[f"m{k}"] or 0.0 for k in range(len(columns))], float)
    spread = np.array([row[f"s{k}"] or 1.0 for k in range(len(columns))], float)
    scaled = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(columns, centre, spread)]
    flags = F.array(*[F.coalesce(u, F.lit(False)) for u in use.values()])
    rows = stash(known.select(F.array(*scaled[:-1]).alias("x"), scaled[-1].alias("y"), flags.alias("use"), F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice")), "slices", by=["slice"])

    sizes = [len(features), *hidden, 1]
    weights = [start(sizes, seed + k) for k in range(len(use))]
    adams, curves = [Adam(len(w), rate) for w in weights], []
    for t in range(steps):
        sums = summed(rows.where(F.col("slice") == t % slices), sizes, weights)
        curves.append([loss / max(n, 1) for n, loss, _ in sums])
        weights = [w + adam.step(g / n + decay * w) if n else w for w, adam, (n, _, g) in zip(weights, adams, sums)]
    return {name: Network(list(features), sizes, w, centre, spread) for name, w in zip(use, weights)}, curves


def predict(df: DataFrame, networks: dict[str, Network], keep: list[str]) -> DataFrame:
    """keep and a prediction for each network, all of the same features."""
    first = next(iter(networks.values()))
    kept = [f"_k{k}" for k in range(len(keep))]
    fields = [f"{k} {df.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep)] + [f"_p{k} double" for k in range(len(networks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(kept) :]])
            out = []
            for net in networks.values():
                y = forward(net.sizes, net.weights, (x - net.centre[:-1]) / net.spread[:-1]) * net.spread[-1] + net.centre[-1]
                out.append(pa.array(y, mask=np.isnan(y)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *out], names=[f.split()[0] for f in fields])

    rows = df.select(*[F.col(c).alias(k) for k, c in zip(kept, keep)], *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(first.features)])
    return rows.mapInArrow(run, ", ".join(fields)).select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *[F.col(f"_p{k}").alias(n) for k, n in enumerate(networks)])


def out_of_fold(df: DataFrame, key: str, features: list[str], target: str, fold: str, folds: int, **settings) -> DataFrame:
    """key, fold, y_true and y_pred of every row, from the network that hasn't seen its fold; all folds are trained together."""
    networks, _ = fit_networks(df, key, features, target, {f"f{k}": F.col(fold) != k for k in range(folds)}, **settings)
    seen = predict(df.dropna(subset=[*features, target]), networks, [key, fold, target])
    own = F.get(F.array(*[F.col(n) for n in networks]), F.col(fold))
    return seen.select(key, fold, F.col(target).cast("double").alias("y_true"), own.alias("y_pred"))


def save(spark: SparkSession, networks: dict[str, Network], path: str) -> None:
    """The weights as a Parquet table."""
    rows = [(name, n.features, n.sizes, n.weights.tolist(), n.centre.tolist(), n.spread.tolist()) for name, n in networks.items()]
    schema = "name string, features array<string>, sizes array<int>, weights array<double>, centre array<double>, spread array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, Network]:
    return {r.name: Network(r.features, r.sizes, *(np.array(x) for x in (r.weights, r.centre, r.spread))) for r in spark.read.parquet(path).collect()}
