"""Keyed state with entries of its own per id, kept by RocksDB (``transformWithState``).

State never is one row that grows: ids are map entries, pending rows list entries. A source's ids are dealt to ``BUCKETS``
keys, so a large source is no task's alone. Time is event time: rows later than the watermark are dropped, and timers end
what nothing has touched for its lifetime.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessaria.streaming.jobs import LATE, MISSES

BUCKETS = 16
DAY_MS = 86_400_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that does not have to fit the executors' heap; has to be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Misses(StatefulProcessor):
    """id -> sweeps missed in a row, for one source and bucket."""

    def __init__(self, misses: int):
        self.misses = misses

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missed = handle.getMapState("missed", "id long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values("sweep").itertuples():
            found = {int(x) for x in row.found}
            for (known,), (n,) in list(self.missed.iterator()):
                if known in found:
                    continue
                if n + 1 >= self.misses:
                    out.append((int(key[0]), int(row.sweep), int(known)))
                    self.missed.removeKey((known,))
                else:
                    self.missed.updateValue((known,), (n + 1,))
            for x in found:
                self.missed.updateValue((x,), (0,))
        yield pd.DataFrame(out, columns=["source", "sweep", "id"], dtype="int64")

    def close(self) -> None:
        pass


def missed_sweeps(sweeps: DataFrame, misses: int = MISSES, buckets: int = BUCKETS) -> DataFrame:
    """source, sweep, id of ids that ``misses`` sweeps of their source in a row have not found; one that comes back starts
    anew. Input: one row (source, sweep, found: array of ids) per sweep, in order of sweeps between triggers."""
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(buckets))
    rows = sweeps.select("source", "sweep", "found", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    own = rows.select("source", "bucket", "sweep", F.filter("found", lambda x: bucket(x) == F.col("bucket")).alias("found"))
    return own.groupBy("source", "bucket").transformWithStateInPandas(_Misses(misses), "source long, sweep long, id long", "append", "none")


class _Failures(StatefulProcessor):
    """Failures in a row, forgotten by a timer of event time."""

    def __init__(self, key: str, lifetime: int):
        self.key, self.lifetime = key, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, ends = self.count.get() if self.count.exists() else (0, 0)
        before, out = ends, []
        for row in pd.concat(list(rows)).sort_values(["at", "tie"]).itertuples():
            at = int(row.at.timestamp() * 1000)
            if ends and at >= ends:  # forgotten before this row came, wherever the trigger's bounds are
                out.append((key[0], n, True))
                n = 0
            n = n + 1 if row.failed else 0
            ends = max(ends, at + self.lifetime)
        if ends != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)
        self.count.update((n, ends))
        out.append((key[0], n, False))
        yield pd.DataFrame(out, columns=[self.key, "failures", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _ = self.count.get()
        self.count.clear()
        yield pd.DataFrame({self.key: [key[0]], "failures": [n], "gone": [True]})

    def close(self) -> None:
        pass


def failures(stream: DataFrame, key: str, failed: str, tie: str, days: int) -> DataFrame:
    """key, failures in a row in order of time and ``tie``, gone (``days`` of event time passed without a row)."""
    second = F.unix_micros("at") if tie == "at" else F.col(tie)  # the event time itself may stand once alone
    rows = stream.withWatermark("at", LATE).select(key, "at", second.alias("tie"), F.col(failed).alias("failed"))
    return rows.groupBy(key).transformWithStateInPandas(_Failures(key, days * DAY_MS), f"{key} long, failures long, gone boolean", "update", "eventTime")


class _Visits(StatefulProcessor):
    """Starts of the last two visits. Rows that the watermark has passed are folded; younger ones wait in a list, as rows
    between them may still come."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.folded = handle.getValueState("folded", "current long, previous long, last long")
        self.waiting = handle.getListState("waiting", "at long")

    def fold(self, state: tuple, times: list[int]) -> tuple:
        current, previous, last = state
        for at in times:
            if last is None or at - last > self.gap:
                current, previous = at, current
            last = at
        return current, previous, last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.folded.get() if self.folded.exists() else (None, None, None)
        times = sorted([at for (at,) in self.waiting.get()] + [int(x) for frame in rows for x in frame["micros"]])
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        done = [at for at in times if at <= passed]
        if done:
            state = self.fold(tuple(state), done)
            self.folded.update(state)
        rest = times[len(done) :]
        self.waiting.clear()
        if rest:
            self.waiting.put([(at,) for at in rest])
        current, previous, last = self.fold(tuple(state), rest)
        yield pd.DataFrame({self.key: [key[0]], "current": [current], "previous": [previous], "seen": [last]}).astype({"previous": "Int64"})

    def close(self) -> None:
        pass


def visits(stream: DataFrame, key: str, minutes: int, late: str = LATE) -> DataFrame:
    """key, current and previous (starts of the last two visits) and seen (last row) in microseconds, at every trigger with
    rows of the key. Rows within ``minutes`` of the one before belong to its visit; rows may come ``late``, in any order."""
    rows = stream.withWatermark("at", late).select(key, "at", F.unix_micros("at").alias("micros"))
    return rows.groupBy(key).transformWithStateInPandas(_Visits(key, minutes * 60_000_000), f"{key} long, current long, previous long, seen long", "update", "eventTime")
