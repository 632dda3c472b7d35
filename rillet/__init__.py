"""rillet: partitioned topic logs as Spark DataFrames.

Records live in a Parquet-backed topic log (``TopicLog``); every shaping step is
a ``DataFrame -> DataFrame`` function so the same code serves batch reads and
Structured Streaming micro-batches.
"""

from rillet.model import (
    CATALOG_SCHEMA,
    COMMIT_SCHEMA,
    METRICS_SCHEMA,
    PRODUCED_SCHEMA,
    RECORD_SCHEMA,
)
from rillet.operators.batching import commit_batches, commit_positions
from rillet.operators.copy import fan_out, produce_numbers, replicate, route_conditional
from rillet.operators.grouped_within import grouped_within
from rillet.operators.observe import consumer_lag, consumer_metrics, pending_gauge, producer_metrics
from rillet.session import get_session, scratch_dir
from rillet.sources.log import TopicLog
from rillet.streaming.external import process_from_stored_offset
from rillet.streaming.flows import (
    drain,
    envelope_stream,
    produce_stream,
    replicate_stream,
    run_with_restart,
    shutdown,
)

__all__ = [
    "CATALOG_SCHEMA",
    "COMMIT_SCHEMA",
    "METRICS_SCHEMA",
    "PRODUCED_SCHEMA",
    "RECORD_SCHEMA",
    "TopicLog",
    "commit_batches",
    "commit_positions",
    "consumer_lag",
    "consumer_metrics",
    "drain",
    "envelope_stream",
    "fan_out",
    "get_session",
    "grouped_within",
    "pending_gauge",
    "process_from_stored_offset",
    "produce_numbers",
    "produce_stream",
    "producer_metrics",
    "replicate",
    "replicate_stream",
    "route_conditional",
    "run_with_restart",
    "scratch_dir",
    "shutdown",
]
