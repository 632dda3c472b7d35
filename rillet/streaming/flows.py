"""Streaming flows over topic logs, one per delivery guarantee.

Source (S1, S9): a stream over the log's segment index. Index rows appear only
when a segment is committed, so a flow reads committed records only
(read-committed), and a micro-batch is a set of whole segments whose records are
then read with directory pruning. Spark's checkpoint holds the progress; the
``commits`` table of the destination log mirrors it as (group, topic,
partition, next_offset) for lag and for restarts from stored offsets.

Each micro-batch runs the batch operators (offsets, routing, writes) through
``foreachBatch``. The guarantee is decided by what is written when:

* exactly-once - the segment id is (flow, batch id), so a replayed batch
  recomputes the same offsets and overwrites its own segment; a batch whose
  segment is already committed is skipped. Data, positions and index are
  written in that order; the index row is the commit point.
* at-least-once - output first (a fresh segment per attempt), positions after;
  a failure in between replays the batch and duplicates its output.
* at-most-once - the (flow, batch id) claim and the positions are written
  first; a failure after the claim loses the batch on replay, never duplicates it.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillet.functions.records import business, readdress
from rillet.model import (
    DEFAULT_GROUP,
    RESTART_MAX_SECONDS,
    RESTART_MIN_SECONDS,
    RESTART_RANDOM_FACTOR,
    SEGMENT_SCHEMA,
    TP,
)
from rillet.operators.batching import grouped_commits_carrying, positions as commit_rows
from rillet.operators.offsets import number, offsets_from_source, staging_area
from rillet.operators.routing import explode_envelopes
from rillet.session import scratch_dir
from rillet.sources.log import TopicLog, new_segment_id

GUARANTEES = ("exactly_once", "at_least_once", "at_most_once")
# Default bound on committed segments per micro-batch: a backlog is worked off in bounded
# batches, and the segment names a batch takes to the driver stay a short list.
SEGMENTS_PER_BATCH = 1000

Hook = Callable[[str, int], None]
Handler = Callable[[DataFrame, int], None]


def _no_hook(stage: str, batch_id: int) -> None:
    return None


def segment_stream(
    log: TopicLog,
    topics: list[str] | None = None,
    max_segments: int | None = None,
    observe: str | None = "consumed",
) -> DataFrame:
    """The committed-segment stream of ``log`` (one row per (topic, partition, segment)).

    ``max_segments`` bounds each micro-batch (back-pressure); O1 metrics
    (records, highest offset) are observed under ``observe``.
    """
    reader = log.spark.readStream.schema(SEGMENT_SCHEMA).option(
        "maxFilesPerTrigger", int(max_segments or SEGMENTS_PER_BATCH)
    )
    idx = reader.parquet(log.index_path)
    if topics is not None:
        idx = idx.where(F.col("topic").isin(list(topics)))
    if observe:
        idx = idx.observe(
            observe,
            F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"),
            F.max(F.col("end_offset") - 1).alias("max_offset"),
        )
    return idx


def batch_records(log: TopicLog, index_batch: DataFrame, topics: list[str] | None) -> DataFrame | None:
    """Records of the segments listed in one micro-batch of the index stream.

    The micro-batch holds index rows only (bounded by ``max_segments``); they name
    the exact (topic, partition, segment) folders to read, so nothing else is listed.
    """
    parts = [(r.topic, r.partition, r.seg) for r in index_batch.select("topic", "partition", "seg").collect()]
    if topics is not None:
        parts = [p for p in parts if p[0] in set(topics)]
    if not parts:
        return None
    return log.read_segments(parts)


def start_flow(
    src: TopicLog,
    topics: list[str] | str,
    handler: Handler,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    max_segments: int | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Run ``handler(records, batch_id)`` for every micro-batch of committed records."""
    topics = [topics] if isinstance(topics, str) else list(topics)
    checkpoint = checkpoint or scratch_dir(src.spark, "flow-checkpoint")

    def on_batch(index_batch: DataFrame, batch_id: int) -> None:
        records = batch_records(src, index_batch, topics)
        if records is not None:
            handler(records, batch_id)

    writer = (
        segment_stream(src, topics, max_segments)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
    )
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def deliver(
    dst: TopicLog,
    copies: DataFrame,
    positions: DataFrame,
    flow: str,
    batch_id: int,
    guarantee: str,
    hook: Hook = _no_hook,
    tiebreak: list[str] | None = None,
    order_by: list | None = None,
    changed: bool = False,
    topics: list[str] | None = None,
    source: str | None = None,
) -> None:
    """Write one micro-batch of copies and its consumed positions under ``guarantee``.

    Offsets follow the source position of each copy, or ``order_by`` for records
    that have no source offset (ingested files). ``changed``: a hook may have dropped or
    repeated records, so positions don't follow from the source offsets by arithmetic.
    ``topics``: the target topics, where known, so that only their end offsets are read.
    ``source``: the root of the log that the positions belong to.
    """
    if guarantee not in GUARANTEES:
        raise ValueError(f"guarantee must be one of {GUARANTEES}")

    def with_offsets(staging: str):
        """(records with offsets, their index rows when known without a read-back)."""
        if order_by is not None:
            return number(copies, order_by, dst.end_offsets(topics), staging)
        if changed:
            order = ["src_topic", "src_partition", "src_offset"]
            return number(copies, [*order, *(tiebreak or []), "key", "value"], dst.end_offsets(topics), staging, order)
        return offsets_from_source(
            copies, dst.end_offsets(topics), tiebreak=tiebreak, staging=staging, with_index=True
        )

    if guarantee == "exactly_once":
        seg = f"{flow}-b{batch_id:012d}"
        if dst.is_committed(seg):
            return
        with staging_area(dst.spark) as staging:
            out, index = with_offsets(staging)
            hook("before_write", batch_id)
            dst.write_segment(out, seg, commits=positions, index=index, source=source)
        hook("after_write", batch_id)
    elif guarantee == "at_least_once":
        seg = new_segment_id(f"{flow}-b{batch_id:012d}")
        with staging_area(dst.spark) as staging:
            out, index = with_offsets(staging)
            hook("before_write", batch_id)
            dst.write_segment(out, seg, index=index)
        hook("after_write", batch_id)
        if positions is not None:
            dst.write_commits(positions, seg, alone=True, source=source)
    else:
        if not dst.claim(flow, batch_id):
            return
        seg = new_segment_id(f"{flow}-b{batch_id:012d}")
        if positions is not None:
            dst.write_commits(positions, seg, alone=True, source=source)
        hook("after_claim", batch_id)
        with staging_area(dst.spark) as staging:
            out, index = with_offsets(staging)
            dst.write_segment(out, seg, index=index)
        hook("after_write", batch_id)


def replicate_stream(
    src: TopicLog,
    topics: list[str] | str,
    dst_topic: str,
    dst: TopicLog | None = None,
    guarantee: str = "exactly_once",
    keep_key: bool = False,
    fn: Callable[[DataFrame], DataFrame] | None = None,
    group_id: str = DEFAULT_GROUP,
    flow: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    max_segments: int | None = None,
    hook: Hook = _no_hook,
    commit_grouping: tuple | None = None,
) -> StreamingQuery:
    """Copy topics to ``dst_topic`` as a stream.

    ``fn`` is the P11 transform hook. Positions are committed for ``group_id``:
    one per partition and micro-batch, or per batch of n (``("batch", n)``, T3 /
    T7) or per count-or-time group (``("within", n, seconds)``, T8). Count-or-time
    groups span micro-batches: the open group's range is a position of the flow, written with
    the others, from which the next batch reads its records again (at most n per partition). A
    group is committed once it closes, or when the stream ends (``await_end``, ``drain``). ``flow`` names the flow within ``dst``; it is
    bound to the source, topics, guarantee and checkpoint, and resumes with the same ones.
    Positions are those of the records consumed, whatever ``fn`` makes of them.
    """
    dst = dst or src
    checkpoint = checkpoint or flow_checkpoint(dst, flow)
    topics = [topics] if isinstance(topics, str) else list(topics)
    dst.bind_flow(
        flow, kind="replicate", source=src.root, topics=",".join(sorted(topics)), to=dst_topic,
        guarantee=guarantee, checkpoint=checkpoint,
    )

    within = commit_grouping[1:] if commit_grouping and commit_grouping[0] == "within" else None

    def handler(consumed: DataFrame, batch_id: int) -> None:
        copies = readdress(business(consumed, fn), dst_topic, keep_key)
        with staging_area(dst.spark) as groups:
            if within:
                at = consumed.groupBy(*TP).agg(F.min("offset").alias("offset"))
                carried = src.read_ranges(dst.last_ranges(open_groups(flow), src.root, at))
                positions = grouped_commits_carrying(consumed, carried, *within, group_id, open_groups(flow), f"{groups}/groups")
            else:
                positions = commit_rows(consumed, group_id, commit_grouping)
            deliver(
                dst, copies, positions, flow, batch_id, guarantee, hook,
                changed=fn is not None, topics=[dst_topic], source=src.root,
            )

    query = start_flow(src, topics, handler, checkpoint, trigger, max_segments, flow)
    if within:
        query._rillet_end = lambda: commit_open_groups(dst, flow, group_id, src.root)
    return query


def flow_checkpoint(dst: TopicLog, flow: str | None) -> str:
    """Where a flow keeps its progress unless told otherwise: one folder for each name."""
    if not flow:
        raise ValueError("a flow needs a name of its own")
    return f"{dst.root}/checkpoints/{dst._dir('flow', flow)}"


def open_groups(flow: str) -> str:
    """The group whose positions are the ranges of a flow's open count-or-time groups."""
    return f"{flow}.open"


def commit_open_groups(dst: TopicLog, flow: str, group_id: str = DEFAULT_GROUP, source: str | None = None) -> None:
    """Commit what is left in a flow's open groups; a later run starts new groups."""
    left = dst.last_ranges(open_groups(flow), source).where("begin_offset < next_offset")
    if left.isEmpty():
        return
    closed = left.withColumn("group_id", F.lit(group_id))
    none_open = left.withColumns({"group_id": F.lit(open_groups(flow)), "begin_offset": F.col("next_offset")})
    dst.write_commits(closed.unionByName(none_open), new_segment_id(f"{flow}-end"), alone=True, source=source)


def produce_stream(
    stream: DataFrame,
    log: TopicLog,
    to_records: Callable[[DataFrame], DataFrame],
    order_by: list,
    flow: str | None = None,
    guarantee: str = "exactly_once",
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """K1 / K5 for any streaming DataFrame: each micro-batch becomes records on the log.

    ``to_records`` maps a batch to (topic, partition, key, value, timestamp, order columns);
    the log assigns offsets in ``order_by`` order after the committed end offsets. ``flow``
    names the flow within ``log`` and is bound to its checkpoint.
    """
    checkpoint = checkpoint or flow_checkpoint(log, flow)
    log.bind_flow(flow, kind="produce", guarantee=guarantee, checkpoint=checkpoint)

    def handler(batch: DataFrame, batch_id: int) -> None:
        deliver(log, to_records(batch), None, flow, batch_id, guarantee, order_by=order_by)

    return (
        stream.writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def envelope_stream(
    src: TopicLog,
    topics: list[str] | str,
    to_envelopes: Callable[[DataFrame], DataFrame],
    dst: TopicLog | None = None,
    guarantee: str = "at_least_once",
    flow: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    max_segments: int | None = None,
    hook: Hook = _no_hook,
    targets: list[str] | None = None,
) -> StreamingQuery:
    """F4 / F5 as a stream: envelopes -> produced records; positions from every envelope.

    Envelopes may leave out or repeat records, so copies are numbered in their splits.
    ``targets``: the topics they go to, where known, so that only their end offsets are read.
    """
    dst = dst or src
    checkpoint = checkpoint or flow_checkpoint(dst, flow)
    topics = [topics] if isinstance(topics, str) else list(topics)
    dst.bind_flow(
        flow, kind="envelopes", source=src.root, topics=",".join(sorted(topics)), guarantee=guarantee, checkpoint=checkpoint
    )

    def handler(records: DataFrame, batch_id: int) -> None:
        envelopes = to_envelopes(records)
        consumed = envelopes.select("pass_through.*")
        ranges = [F.min("offset").alias("begin_offset"), (F.max("offset") + 1).alias("next_offset")]
        positions = consumed.groupBy("group_id", "topic", "partition").agg(*ranges)
        copies = explode_envelopes(envelopes)
        deliver(dst, copies, positions, flow, batch_id, guarantee, hook, ["part"], changed=True, topics=targets, source=src.root)

    return start_flow(src, topics, handler, checkpoint, trigger, max_segments, flow)


def drain(query: StreamingQuery) -> None:
    """Finish what is available, including commits and open groups, then stop."""
    query.processAllAvailable()
    query.stop()
    _end(query)


def await_end(query: StreamingQuery) -> None:
    """Wait for a stream that ends by itself, then commit what its open groups hold."""
    query.awaitTermination()
    _end(query)


def _end(query: StreamingQuery) -> None:
    end = getattr(query, "_rillet_end", None)
    if end is not None:
        end()


def shutdown(query: StreamingQuery) -> None:
    """Stop now; the checkpoint keeps the last committed progress."""
    query.stop()


def backoff_delays(
    min_seconds: float = RESTART_MIN_SECONDS,
    max_seconds: float = RESTART_MAX_SECONDS,
    random_factor: float = RESTART_RANDOM_FACTOR,
    rand: Callable[[], float] = random.random,
):
    """Delays between restarts: doubling from the minimum, capped, stretched by up to the factor."""
    k = 0
    while True:
        yield min(max_seconds, min_seconds * 2.0 ** min(k, 60)) * (1.0 + random_factor * rand())
        k += 1


def run_with_restart(
    start: Callable[[], StreamingQuery],
    max_restarts: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    delays=None,
) -> int:
    """Run a flow to the end; on failure only, wait and restart on the same checkpoint.

    Returns the number of restarts used. Restarts without a limit, unless ``max_restarts``
    is given; then the failure after them is raised.
    """
    delays = delays or backoff_delays()
    restarts = 0
    while True:
        try:
            query = start()
            await_end(query)
            return restarts
        except Exception:
            if max_restarts is not None and restarts >= max_restarts:
                raise
            sleep(next(delays))
            restarts += 1
