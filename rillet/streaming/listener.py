"""Per-batch progress of streaming flows, collected by a ``StreamingQueryListener`` (O1 / O2).

Keeps only progress metadata (batch id, input rows, durations, observed metrics),
never records.
"""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    def __init__(self, names: set[str] | None = None):
        self.names = names
        self.rows: list[dict] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        return None

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        observed = {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}
        with self._lock:
            self.rows.append(
                {
                    "name": p.name,
                    "batch_id": p.batchId,
                    "input_rows": p.numInputRows,
                    "duration_ms": dict(p.durationMs or {}),
                    "observed": observed,
                }
            )

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        return None

    def snapshot(self) -> list[dict]:
        with self._lock:
            return list(self.rows)


def attach(spark: SparkSession, names: set[str] | None = None) -> ProgressLog:
    listener = ProgressLog(names)
    spark.streams.addListener(listener)
    return listener


def detach(spark: SparkSession, listener: ProgressLog) -> None:
    spark.streams.removeListener(listener)
