"""Count-or-time grouping on Spark's keyed state (G4 / T8, streaming form).

``transformWithStateInPandas`` keeps for each (topic, partition) the open group (first offset,
first timestamp, size) and the next offset as values, and the records that arrived ahead of a
gap as a list. Each micro-batch continues the open group with the new records in offset order,
emits every group that closed, and keeps the last one open. A group is emitted as soon as it is
full (n records), or when a record at or after its first timestamp + d arrives. An open group is
also flushed by a timer, depending on ``timeout``:

* ``"processing"`` - d of processing time after its first record was taken (the reference's
  wall-clock grouping). Spark then keeps running no-data batches to check timers, so such a query
  never ends by itself: run it on a processing-time trigger and stop it (``drain`` / ``shutdown``);
* ``"event"`` - once the watermark passes first timestamp + d (at once when it already has);
* ``None`` - never: closed groups are exactly those of the batch definition.

Order across micro-batches: the Kafka source delivers each partition in order, with gaps where
records were compacted or belong to transactions; a batch that goes back raises. File streams
promise no order, but a topic log's offsets start at 0 and have no gaps: with ``dense`` a record
that arrives ahead waits in the list state until all before it have come, and a record that
comes again (files of an attempt that failed) is left out. The list holds as many records as the
file order departs from the offsets'.

A key's new records of one micro-batch are handled by one call: the batch size
(``maxFilesPerTrigger`` on the source) bounds that work. State lives in RocksDB, which Spark
checkpoints with the query's progress; nothing is kept on the driver.

Defined cases: a record without a timestamp raises; no records, no groups; a null topic or
partition is a key like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillet.model import GROUP_LIMIT, GROUP_WINDOW_SECONDS
from rillet.operators.grouped_within import _next_starts
from rillet.session import configure

GROUP_SCHEMA = "topic string, partition int, first_offset long, next_offset long, n_records long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME_MODES = {"processing": "ProcessingTime", "event": "EventTime", None: "None"}

Group = tuple[int, int, int]  # first offset, next offset, size
Open = tuple[int, int, int]  # first offset, first timestamp, size


def fold(
    open_: Open | None, taken: int | None, offsets: np.ndarray, ts: np.ndarray, n: int, d: int
) -> tuple[list[Group], Open | None]:
    """The groups that records (in order) close, and the group they leave open; ``taken``: the offset after the last one before."""
    closed: list[Group] = []
    pos, m = 0, len(offsets)
    if m == 0:
        return closed, open_
    if open_ is not None:
        start, first_ts, size = open_
        late = np.flatnonzero(ts >= first_ts + d)
        pos = min(n - size, int(late[0]) if len(late) else m)
        size += min(pos, m)
        if pos >= m and size < n:
            return closed, (start, first_ts, size)
        closed.append((start, int(offsets[pos - 1]) + 1 if pos else taken, size))
    nxt = _next_starts(ts, n, d)
    while pos < m:
        end = int(nxt[pos])
        if end == m and end - pos < n:
            return closed, (int(offsets[pos]), int(ts[pos]), m - pos)
        closed.append((int(offsets[pos]), int(offsets[end - 1]) + 1, end - pos))
        pos = end
    return closed, None


class CountOrTime(StatefulProcessor):
    """The state of one (topic, partition)."""

    def __init__(self, n: int, d: int, timeout: str | None, dense: bool):
        self.n, self.d, self.timeout, self.dense = n, d, timeout, dense

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "start long, first_ts long, n long, due long")
        self.next = handle.getValueState("next", "offset long")
        self.early = handle.getListState("early", "offset long, ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        if pdf["micros"].isna().any():
            raise ValueError("count-or-time grouping needs a timestamp on every record")
        offsets, ts = self._in_order(key, pdf["offset"].to_numpy(np.int64), pdf["micros"].to_numpy(np.int64))
        if not len(offsets):
            return
        taken = self.next.get()[0] if self.next.exists() else None
        self.next.update((int(offsets[-1]) + 1,))
        *was, due = self.group.get() if self.group.exists() else (None,)
        closed, open_ = fold(tuple(was) or None, taken, offsets, ts, self.n, self.d)
        if due is not None and (open_ is None or open_[0] != was[0]):
            self.handle.deleteTimer(due)
            due = None
        if open_ is not None and due is None:
            due = self._due(open_, timerValues)
            if due is not None and due <= self._now(timerValues):
                closed.append((open_[0], int(offsets[-1]) + 1, open_[2]))
                open_ = None
            elif due is not None:
                self.handle.registerTimer(due)
        if open_ is None:
            self.group.clear()
        else:
            self.group.update((*open_, due))
        if closed:
            yield self._emitted(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.group.exists():
            return
        start, _, size, due = self.group.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.group.clear()
        yield self._emitted(key, [(start, self.next.get()[0], size)])

    def close(self) -> None:
        pass

    def _in_order(self, key, offsets: np.ndarray, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The records to take now, in offset order."""
        expected = self.next.get()[0] if self.next.exists() else None
        if not self.dense:
            order = np.argsort(offsets, kind="stable")
            if expected is not None and offsets[order[0]] < expected:
                raise ValueError(f"{key}: offset {offsets[order[0]]} arrived when {expected} was next")
            return offsets[order], ts[order]
        waiting = list(self.early.get()) if self.early.exists() else []
        if waiting:
            held = np.array(waiting, np.int64).reshape(-1, 2)
            offsets, ts = np.concatenate([held[:, 0], offsets]), np.concatenate([held[:, 1], ts])
        offsets, first = np.unique(offsets, return_index=True)
        ts = ts[first]
        fresh = offsets >= (expected or 0)
        offsets, ts = offsets[fresh], ts[fresh]
        ahead = offsets != (expected or 0) + np.arange(len(offsets))
        if ahead.any():
            self.early.put([(int(o), int(t)) for o, t in zip(offsets[ahead], ts[ahead])])
        elif waiting:
            self.early.clear()
        return offsets[~ahead], ts[~ahead]

    def _due(self, open_: Open, timerValues) -> int | None:
        if self.timeout == "processing":
            return timerValues.getCurrentProcessingTimeInMs() + max(1, self.d // 1000)
        return (open_[1] + self.d) // 1000 if self.timeout == "event" else None

    def _now(self, timerValues) -> int:
        if self.timeout == "processing":
            return timerValues.getCurrentProcessingTimeInMs()
        return timerValues.getCurrentWatermarkInMs()

    @staticmethod
    def _emitted(key, groups: list[Group]) -> pd.DataFrame:
        rows = [(key[0], key[1], *group) for group in groups]
        return pd.DataFrame(rows, columns=["topic", "partition", "first_offset", "next_offset", "n_records"])


def grouped_within_stream(
    records: DataFrame,
    n: int = GROUP_LIMIT,
    seconds: float = GROUP_WINDOW_SECONDS,
    timeout: str | None = "processing",
    watermark_delay: str = "0 seconds",
    dense: bool = False,
) -> DataFrame:
    """Closed count-or-time groups of a streaming record frame, in append mode.

    Sets the session's state store to RocksDB, which ``transformWithStateInPandas`` needs.
    """
    spark = configure(records.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    d = int(round(seconds * 1_000_000))
    columns = ["topic", "partition", "offset"]
    if timeout == "event":
        records = records.withWatermark("timestamp", watermark_delay)
        columns.append("timestamp")
    keyed = records.select(*columns, F.unix_micros("timestamp").alias("micros"))
    return keyed.groupBy("topic", "partition").transformWithStateInPandas(
        CountOrTime(n, d, timeout, dense), GROUP_SCHEMA, "Append", TIME_MODES[timeout]
    )
