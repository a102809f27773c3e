"""Means, covariances and correlations of many columns: every task multiplies its rows as matrices, blocks are summed where they meet.

Columns travel as one array, so a plan has the same size for ten columns or for thousands.  A task keeps one matrix; it
hands it over in blocks, each block's sums run through one task as a stream, and the driver puts the blocks together:
as many numbers as the covariance has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a block.
BLOCK = 256


class Moments(NamedTuple):
    n: int
    mean: np.ndarray
    cov: np.ndarray  # by n
    fourth: float  # mean of |x|^4 of centred rows


def _matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return batch.column(0).values.to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), p)


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """x: the values of the rows that have all of them, as numbers."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def block_sums(blocks: DataFrame) -> DataFrame:
    """i, j, v: the sum of the blocks (arrays of doubles as bytes) of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, j, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (i, j) != at:
                    if at is not None:
                        yield _block(*at, total)
                    at, total = (i, j), np.frombuffer(v).copy()
                else:
                    total += np.frombuffer(v)
        if at is not None:
            yield _block(*at, total)

    return blocks.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "i int, j int, v binary")


def _block(i: int, j: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())], names=["i", "j", "v"])


def moments(df: DataFrame, columns: list[str], block: int = BLOCK) -> Moments:
    """From two passes: the means, then products of centred rows.  Rows with a missing value are left out."""
    p, rows = len(columns), _vectors(df, columns)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p + 1)
        for batch in batches:
            x = _matrix(batch, p)
            total += np.append(x.sum(axis=0), len(x))
        yield _block(0, 0, total)

    first = np.frombuffer(block_sums(rows.mapInArrow(means, "i int, j int, v binary")).first().v)
    n = int(first[p])
    mean = first[:p] / max(n, 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fourth = np.zeros((p, p)), 0.0
        for batch in batches:
            x = _matrix(batch, p) - mean
            total += x.T @ x
            fourth += float(((x * x).sum(axis=1) ** 2).sum())
        yield _block(-1, -1, np.array([fourth]))
        for i in range(0, p, block):
            for j in range(i, p, block):
                yield _block(i, j, total[i : i + block, j : j + block])

    cov, fourth = np.zeros((p, p)), 0.0
    for r in block_sums(rows.mapInArrow(products, "i int, j int, v binary")).toLocalIterator():
        v = np.frombuffer(r.v)
        if r.i < 0:
            fourth = float(v[0])
            continue
        wide = min(block, p - r.j)
        part = v.reshape(-1, wide)
        cov[r.i : r.i + len(part), r.j : r.j + wide] = part
        cov[r.j : r.j + wide, r.i : r.i + len(part)] = part.T
    return Moments(n, mean, cov / max(n, 1), fourth / max(n, 1))


def correlations(m: Moments) -> np.ndarray:
    """0 where a column doesn't vary, 1 on the diagonal."""
    sd = np.sqrt(np.diag(m.cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where((sd[:, None] > 0) & (sd[None, :] > 0), m.cov / np.outer(sd, sd), 0.0)
    np.fill_diagonal(out, 1.0)
    return out


def squared_distance(df: DataFrame, columns: list[str], mean: np.ndarray, inverse: np.ndarray, name: str) -> DataFrame:
    """df with (x - mean)' inverse (x - mean); null where a value is missing."""
    @F.pandas_udf("double")
    def distance(x: pd.Series) -> pd.Series:
        d = (np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(mean)))) - mean
        out = pd.Series(np.einsum("ij,jk,ik->i", d, inverse, d, optimize=True))
        return out.where(out.notna(), None)

    return df.withColumn(name, distance(F.array(*[F.col(c).cast("double") for c in columns])))
