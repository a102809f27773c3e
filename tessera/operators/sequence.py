"""A recurrent language model of strings, trained by gradients summed over all tasks, and its policy step towards a score.

Strings are lists of character numbers between a start and an end mark.  One gated recurrent cell; the gradient of a weighted
sum of log-probabilities serves both losses: the likelihood of all strings, and the squared gap between the agent's
log-probability and the prior's plus a multiple of the score.  Samples are fixed by their seeds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import encode
from tessera.operators.network import _SUMS, FAN_IN, Adam, _merged, _sums
from tessera.session import stash_evenly

#: Strings that one matrix holds, and distinct strings of a file.
ROWS = 256
SHARE = 8192
START, END = 0, 1


@dataclass(frozen=True)
class Sequences:
    alphabet: list[str]  # numbered from 2
    wide: int  # of a character's vector
    hidden: int
    weights: np.ndarray

    @property
    def codes(self) -> dict[str, int]:
        return {x: k + 2 for k, x in enumerate(self.alphabet)}

    def shapes(self) -> list[tuple[int, ...]]:
        v, d, h = len(self.alphabet) + 2, self.wide, self.hidden
        return [(v, d), *[(d, h)] * 3, *[(h, h)] * 3, *[(h,)] * 3, (h, v), (v,)]


def new(alphabet: list[str], wide: int = 8, hidden: int = 16, seed: int = 0) -> Sequences:
    shapes = Sequences(alphabet, wide, hidden, np.zeros(0)).shapes()
    r = np.random.default_rng(seed)
    return Sequences(alphabet, wide, hidden, np.concatenate([(r.normal(0, 1 / math.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s)).ravel() for s in shapes]))


def _parts(m: Sequences) -> list[np.ndarray]:
    out, at = [], 0
    for s in m.shapes():
        out.append(m.weights[at : at + math.prod(s)].reshape(s))
        at += math.prod(s)
    return out


def _gate(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _step(p: list[np.ndarray], token: np.ndarray, h: np.ndarray):
    e, wz, wr, wn, uz, ur, un, bz, br, bn = p[:10]
    x = e[token]
    z, r, hu = _gate(x @ wz + h @ uz + bz), _gate(x @ wr + h @ ur + br), h @ un
    n = np.tanh(x @ wn + r * hu + bn)
    return (1 - z) * n + z * h, (token, x, h, z, r, hu, n)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def log_probability(m: Sequences, tokens: np.ndarray, size: np.ndarray, weigh=None) -> tuple[np.ndarray, np.ndarray | None]:
    """The log-probability of each string (tokens from START to END, padded to one length), and the gradient of their sum weighted by weigh(log-probabilities)."""
    p = _parts(m)
    h, total, seen = np.zeros((len(tokens), m.hidden)), np.zeros(len(tokens)), []
    rows = np.arange(len(tokens))
    for t in range(tokens.shape[1] - 1):
        h, kept = _step(p, tokens[:, t], h)
        logp = _log_softmax(h @ p[10] + p[11])
        live = (t + 1 < size).astype(float)
        total += live * logp[rows, tokens[:, t + 1]]
        seen.append((kept, h, logp, live))
    if weigh is None:
        return total, None
    w = weigh(total)
    g = [np.zeros_like(x) for x in p]
    back = np.zeros_like(h)
    for t in range(len(seen) - 1, -1, -1):
        (token, x, before, z, r, hu, n), after, logp, live = seen[t]
        out = -np.exp(logp)
        out[rows, tokens[:, t + 1]] += 1
        out *= (w * live)[:, None]
        g[10] += after.T @ out
        g[11] += out.sum(axis=0)
        d = back + out @ p[10].T
        dz, dn = d * (before - n) * z * (1 - z), d * (1 - z) * (1 - n * n)
        dr, dhu = dn * hu * r * (1 - r), dn * r
        for k, (dx, dh) in enumerate(((dz, dz), (dr, dr), (dn, dhu))):
            g[1 + k] += x.T @ dx
            g[4 + k] += before.T @ dh
            g[7 + k] += dx.sum(axis=0)
        np.add.at(g[0], token, dz @ p[1].T + dr @ p[2].T + dn @ p[3].T)
        back = d * z + dz @ p[4].T + dr @ p[5].T + dhu @ p[6].T
    return total, np.concatenate([x.ravel() for x in g])


def _padded(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(c) + 2 for c in codes])
    out = np.full((len(codes), int(size.max())), END)
    out[:, 0] = START
    for k, c in enumerate(codes):
        out[k, 1 : len(c) + 1] = c
    return out, size


def known_strings(df: DataFrame, text: str, m: Sequences, *more: str) -> DataFrame:
    """codes and more: the strings whose characters are all in the alphabet."""
    return df.where(F.col(text).isNotNull()).select(encode(F.col(text), m.codes, -1).alias("codes"), *more).where(~F.array_contains("codes", -1))


def _summed(rows: DataFrame, m: Sequences, policy: tuple[np.ndarray, float] | None) -> tuple[int, float, np.ndarray]:
    """Tokens or strings, loss and gradient over all rows (codes, how often they occur, and score with a policy: the prior's weights and the score's multiple)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, g = 0, 0.0, np.zeros(len(m.weights))
        for batch in batches:
            codes, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a in range(0, len(codes), ROWS):
                tokens, size = _padded(codes[a : a + ROWS])
                c = times[a : a + ROWS]
                if policy is None:
                    logp, d = log_probability(m, tokens, size, lambda x: -c.astype(float))
                    n, loss, g = n + int(c @ (size - 1)), loss - float(c @ logp), g + d
                    continue
                prior, multiple = policy
                aim = log_probability(Sequences(m.alphabet, m.wide, m.hidden, prior), tokens, size)[0] + multiple * batch.column(2).to_numpy()[a : a + ROWS]
                logp, d = log_probability(m, tokens, size, lambda x: -2 * c * (aim - x))
                n, loss, g = n + int(c.sum()), loss + float(c @ (aim - logp) ** 2), g + d
        yield _sums({0: [n, loss, g]})

    columns = ["codes", "times"] if policy is None else ["codes", "times", "score"]
    parts = rows.select(*columns).mapInArrow(run, _SUMS)
    if (tasks := rows.rdd.getNumPartitions()) > FAN_IN:
        parts = parts.repartition(math.ceil(math.sqrt(tasks))).mapInArrow(_merged, _SUMS)
    n, loss, g = 0, 0.0, np.zeros(len(m.weights))
    for r in sorted(parts.collect(), key=lambda r: r.part):
        n, loss, g = n + r.n, loss + r.loss, g + np.frombuffer(r.g)
    return n, loss, g


def _counted(df: DataFrame, text: str, m: Sequences, **more: Column) -> DataFrame:
    """codes, times and more, written down in even parts: equal strings are one row that counts for all of them."""
    each = df.groupBy(F.col(text).alias("text"), *[c.alias(n) for n, c in more.items()]).agg(F.count(F.lit(1)).alias("times"))
    return stash_evenly(known_strings(each, "text", m, "times", *more), "strings", SHARE)


def _trained(rows: DataFrame, m: Sequences, steps: int, rate: float, policy: tuple[np.ndarray, float] | None) -> tuple[Sequences, list[float]]:
    adam, curve = Adam(len(m.weights), rate), []
    for _ in range(steps):
        n, loss, g = _summed(rows, m, policy)
        curve.append(loss / max(n, 1))
        m = Sequences(m.alphabet, m.wide, m.hidden, m.weights + adam.step(g / max(n, 1)))
    return m, curve


def fit(df: DataFrame, text: str, m: Sequences, steps: int = 50, rate: float = 0.02) -> tuple[Sequences, list[float]]:
    """The model after so many steps over all strings, and the mean loss of a character at every step."""
    return _trained(_counted(df, text, m), m, steps, rate, None)


def policy_steps(df: DataFrame, text: str, score: str, agent: Sequences, prior: Sequences, multiple: float, steps: int = 1, rate: float = 0.005) -> tuple[Sequences, list[float]]:
    """The agent after steps on (log p_prior + multiple * score - log p_agent)^2 over all strings, and the mean loss of a string."""
    rows = _counted(df.where(F.col(score).isNotNull()), text, agent, score=F.col(score).cast("double"))
    return _trained(rows, agent, steps, rate, (prior.weights, multiple))


def sample(seeds: DataFrame, m: Sequences, longest: int = 100) -> DataFrame:
    """seed, text and log_p: a string for each seed, the same whatever batch it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _parts(m)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a in range(0, len(keys), ROWS):
                part = keys[a : a + ROWS]
                u = np.array([np.random.default_rng(k % (1 << 63)).random(longest) for k in part])
                token, h = np.full(len(part), START), np.zeros((len(part), m.hidden))
                live, total, texts = np.ones(len(part), bool), np.zeros(len(part)), [""] * len(part)
                for t in range(longest):
                    h, _ = _step(p, token, h)
                    logits = h @ p[10] + p[11]
                    logits[:, START] = -np.inf
                    logp = _log_softmax(logits)
                    token = np.minimum((np.exp(logp).cumsum(axis=1) < u[:, t : t + 1]).sum(axis=1), logp.shape[1] - 1)
                    total += live * logp[np.arange(len(part)), token]
                    live &= token != END
                    for k in np.flatnonzero(live).tolist():
                        texts[k] += m.alphabet[token[k] - 2]
                    if not live.any():
                        break
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(texts), pa.array(total)], names=["seed", "text", "log_p"])

    return seeds.select(F.col("seed").cast("long").alias("seed")).mapInArrow(run, "seed long, text string, log_p double")
