"""Stateful logic of long runs as Structured Streaming, with batch twins in tessera.operators.

Processors with state in the checkpoint (`patience`, `arrivals_within`) need the store in STORE.  The windowed aggregates
at the end are additions that the tables' event times invite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.selection import replay_buffer


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """Each key once over the whole stream."""
    return stream.dropDuplicates([key])


def first_seen_within(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once within the watermark: the state stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def capped(stream: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """The first cap arrivals of each key; the state is one count for each key."""
    schema = stream.schema

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        take = rows.head(max(cap - n, 0))
        state.update((n + len(rows),))
        yield take

    return stream.groupBy(key).applyInPandasWithState(run, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def online_leaders(stream: DataFrame, group: str, key: str, word: str, threshold: float) -> DataFrame:
    """Leader clustering in arrival order; the state holds each group's leaders."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heads = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(key)
        out = []
        for w in rows[word].astype("int64"):
            w = int(w) & 0xFFFFFFFFFFFFFFFF
            spot = next((n for n, h in enumerate(heads) if (w | h) and (w & h).bit_count() / (w | h).bit_count() >= threshold), None)
            if spot is None:
                heads.append(w)
                spot = len(heads) - 1
            out.append(spot)
        state.update((heads,))
        yield pd.DataFrame({group: rows[group].astype("int64"), key: rows[key].astype("int64"), "cluster": pd.Series(out, dtype="int32", index=rows.index)})

    return stream.groupBy(group).applyInPandasWithState(run, f"{group} long, {key} long, cluster int", "heads array<long>", "append", GroupStateTimeout.NoTimeout)


def keep_top(path: str, order: list, k: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the best k rows in a table with a version for each batch; a replayed batch writes the same version."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = _version(spark, path, epoch - 1, batch)
        old.unionByName(batch).orderBy(*order).limit(k).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return sink


def keep_replay(path: str, group: str, order: list, per_group: int, size: int) -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, epoch: int) -> None:
        old = _version(batch.sparkSession, path, epoch - 1, batch)
        replay_buffer(old.unionByName(batch), group, order, per_group, size).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return sink


def _version(spark, path: str, epoch: int, like: DataFrame) -> DataFrame:
    if epoch < 0:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(f"{path}/v={epoch}")


def patience(stream: DataFrame, key: str, order: str, value: str, eps: float, limit: int) -> DataFrame:
    """key, order, best, stale and exhausted for every row: the best value so far and the rows since it rose by more than eps.

    The state is two numbers for each key and lies in the checkpoint, so a restart goes on where the run stopped.
    """
    k, o = stream.schema[key], stream.schema[order]
    out = T.StructType([k, o, T.StructField("best", T.DoubleType()), T.StructField("stale", T.LongType()), T.StructField("exhausted", T.BooleanType())])
    return stream.groupBy(key).transformWithStateInPandas(_Patience(key, order, value, eps, limit), out, "append", "none")


class _Patience(StatefulProcessor):
    def __init__(self, key: str, order: str, value: str, eps: float, limit: int):
        self.key, self.order, self.value, self.eps, self.limit = key, order, value, eps, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "best double, stale long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, stale = self.state.get() if self.state.exists() else (None, 0)
        frame = pd.concat(list(rows)).sort_values(self.order)
        bests, stales = [], []
        for v in frame[self.value]:
            if pd.notna(v) and (best is None or v > best + self.eps):
                best, stale = float(v), 0
            else:
                stale += 1
            bests.append(best)
            stales.append(stale)
        self.state.update((best, stale))
        yield pd.DataFrame({self.key: frame[self.key], self.order: frame[self.order], "best": pd.Series(bests, index=frame.index, dtype="float64"), "stale": stales, "exhausted": [x >= self.limit for x in stales]})

    def close(self) -> None:
        pass


def arrivals_within(stream: DataFrame, group: str, member: str, ts: str, idle: str, cap: int) -> DataFrame:
    """Rows of members that are new to their group, `cap` a group at most; a group that is idle for so long is forgotten.

    A group's members are a map in the state and a timer drops them all, so the state holds the active groups only.
    """
    late = stream.withWatermark(ts, idle)
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return late.groupBy(group).transformWithStateInPandas(_Arrivals(group, member, ts, ms, cap), stream.schema, "append", "eventTime")


class _Arrivals(StatefulProcessor):
    def __init__(self, group: str, member: str, ts: str, idle_ms: int, cap: int):
        self.group, self.member, self.ts, self.idle_ms, self.cap = group, member, ts, idle_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", "member string", "seen boolean")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values([self.ts, self.member])
        n, keep = (self.count.get()[0] if self.count.exists() else 0), []
        for m in frame[self.member].astype(str):
            new = n < self.cap and not self.members.containsKey((m,))
            keep.append(new)
            if new:
                self.members.updateValue((m,), (True,))
                n += 1
        self.count.update((n,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last = int(frame[self.ts].max().timestamp() * 1000)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield frame[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.members.clear()
        self.count.clear()
        return iter([])

    def close(self) -> None:
        pass


#: The state store that these processors need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def log_to(stream: DataFrame, path: str, checkpoint: str, partition: list[str] = ()):
    """An append log with a checkpoint: exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition).outputMode("append")


# additions: event-time windows


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
