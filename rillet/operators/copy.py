"""Produce, replicate, fan-out and routing as whole operations on a topic log.

Each function reads committed records, shapes them with the column functions,
lets the log assign offsets, writes one segment and returns the produce results
(the written records, with the source position each came from).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.functions.records import business, readdress
from rillet.functions.report import result_text
from rillet.model import DEFAULT_GROUP, PRODUCE_KEY, PRODUCE_PARTITION
from rillet.operators.batching import positions as commit_rows
from rillet.operators.offsets import number, offsets_from_source, staging_area
from rillet.operators.routing import explode_envelopes, multi_envelope, route
from rillet.sources.generate import number_range
from rillet.sources.log import TopicLog, new_segment_id



def _write_copies(
    dst: TopicLog,
    copies: DataFrame,
    seg: str,
    tiebreak: list[str] | None = None,
    commits: DataFrame | None = None,
    subsets: bool = False,
    topics: list[str] | None = None,
    source: str | None = None,
) -> None:
    """Assign offsets by source position (after the committed end) and write one segment.

    ``subsets``: targets receive a part of each source range, or some records twice
    (routing, a hook), so the arithmetic path cannot apply and they are numbered in their
    splits. ``topics``: the target topics, so that only their end offsets are read.
    """
    with staging_area(dst.spark) as staging:
        index = None
        if subsets:
            order = ["src_topic", "src_partition", "src_offset"]
            with_offsets, index = number(copies, [*order, *(tiebreak or [])], dst.end_offsets(topics), staging, order)
        else:
            with_offsets, index = offsets_from_source(
                copies, dst.end_offsets(topics), tiebreak=tiebreak, staging=staging, with_index=True
            )
        dst.write_segment(with_offsets, seg, commits, index=index, source=source)


def _unread(
    src: TopicLog, dst: TopicLog, topics: list[str] | str, targets: list[str], group_id: str, resume: bool, **bounds
) -> DataFrame:
    """The records that the group has not consumed yet, as its positions in ``dst`` have it."""
    of = [topics] if isinstance(topics, str) else list(topics)
    consumed = dst.consumed(group_id, src.root, of) if resume else None
    records = src.read(topics, consumed=consumed, **bounds)
    if consumed is not None and getattr(consumed, "_rillet_rows", 1) and records.isEmpty():
        known = {r.topic for r in dst.catalog(targets).select("topic").collect()}
        if not known.issuperset(targets):
            warnings.warn(
                f"group {group_id!r} has consumed all of {topics!r} for another target: nothing goes to {targets!r}; "
                "give the copy a group of its own",
                stacklevel=3,
            )
    return records


def produce_numbers(
    log: TopicLog,
    numbers: int | DataFrame,
    topic: str,
    partition: int = PRODUCE_PARTITION,
    key: str = PRODUCE_KEY,
    seg: str | None = None,
) -> DataFrame:
    """Produce numbers as text to ``topic`` (fixed partition and key) and report each write.

    ``numbers``: n for 1..n, whose offsets follow with no sort, or a table with a column
    ``number`` (distinct), produced in its order.
    Returns (topic, partition, offset, value, pass_through, report).
    """
    seg = seg or new_segment_id("produce")
    given = isinstance(numbers, DataFrame)
    numbers = numbers if given else number_range(log.spark, numbers)
    produced = numbers.select(
        F.lit(topic).alias("topic"),
        F.lit(partition).cast("int").alias("partition"),
        F.lit(key).cast("string").alias("key"),
        F.col("number").cast("string").cast("binary").alias("value"),
        F.current_timestamp().alias("timestamp"),
        F.lit("range").alias("src_topic"),
        F.lit(0).cast("int").alias("src_partition"),
        F.col("number").alias("src_offset"),
    )
    _write_copies(log, produced, seg, subsets=given, topics=[topic])
    written = log.read(segments=[seg])
    return written.select(
        "topic",
        "partition",
        "offset",
        F.col("value").cast("string").alias("value"),
        # the pass-through is the number itself: the value read back as an int
        F.col("value").cast("string").cast("int").alias("pass_through"),
    ).withColumn("report", result_text())


def replicate(
    src: TopicLog,
    topics: list[str] | str,
    dst_topic: str,
    dst: TopicLog | None = None,
    keep_key: bool = False,
    fn: Callable[[DataFrame], DataFrame] | None = None,
    group_id: str = DEFAULT_GROUP,
    seg: str | None = None,
    from_offset: int | None = None,
    partitions: list[int] | None = None,
    commit_grouping: tuple | None = None,
    to_positions: DataFrame | None = None,
    resume: bool = True,
) -> DataFrame:
    """T5 / T6 (batch form): copy committed records of ``topics`` to ``dst_topic``.

    The group reads what it has not consumed of this source yet (``resume=False`` or a
    ``from_offset``: whatever it has consumed), and stops before ``to_positions`` where given.
    What it consumed is a set of ranges, so that reads of selected partitions or from an
    offset on leave the rest to a later call. Positions are those of the records read, whatever
    ``fn`` makes of them. As consumers of one group do, copies of one group to several targets
    share the records; a copy that finds all taken by another target warns.

    Keys are dropped unless ``keep_key`` (the reference's flows differ here). The
    copy keeps the partition number; within a partition the order is (source
    topic, source partition, source offset). Positions are committed for
    ``group_id`` with the output segment. Map-only over the records.
    """
    dst = dst or src
    seg = seg or new_segment_id("copy")
    consumed = _unread(
        src, dst, topics, [dst_topic], group_id, resume and from_offset is None,
        partitions=partitions, from_offset=from_offset, to_positions=to_positions,
    )
    positions = commit_rows(consumed, group_id, commit_grouping)
    copies = readdress(business(consumed, fn), dst_topic, keep_key)
    order = ["key", "value"] if fn else None
    _write_copies(dst, copies, seg, order, positions, subsets=fn is not None, topics=[dst_topic], source=src.root)
    return dst.read(segments=[seg], with_source=True)


def fan_out(
    src: TopicLog,
    topic: str,
    topics: tuple[str, ...] = ("topic2", "topic3"),
    dst: TopicLog | None = None,
    keep_key: bool = False,
    group_id: str = DEFAULT_GROUP,
    seg: str | None = None,
    commit_grouping: tuple | None = None,
    to_positions: DataFrame | None = None,
    resume: bool = True,
) -> DataFrame:
    """every record of ``topic`` to each of ``topics``; one position per envelope, in batches if asked.

    The group resumes as in ``replicate``.
    """
    dst = dst or src
    seg = seg or new_segment_id("fanout")
    consumed = _unread(src, dst, topic, list(topics), group_id, resume, to_positions=to_positions)
    envelopes = multi_envelope(consumed, list(topics), keep_key, group_id)
    positions = commit_rows(envelopes.select("pass_through.*"), group_id, commit_grouping)
    _write_copies(dst, explode_envelopes(envelopes), seg, tiebreak=["part"], commits=positions, topics=list(topics), source=src.root)
    return dst.read(segments=[seg], with_source=True)


def route_conditional(
    src: TopicLog,
    topic: str,
    duplicate: Column,
    ignore: Column,
    duplicate_topics: tuple[str, ...] = ("topic2", "topic3"),
    single_topic: str = "topic2",
    dst: TopicLog | None = None,
    group_id: str = DEFAULT_GROUP,
    seg: str | None = None,
    commit_grouping: tuple | None = None,
    to_positions: DataFrame | None = None,
    resume: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """route each record by predicates; commits cover ignored records too.

    The group resumes as in ``replicate``. Returns (written records with source coordinates,
    envelopes of the records read).
    """
    dst = dst or src
    seg = seg or new_segment_id("route")
    targets = sorted({*duplicate_topics, single_topic})
    consumed = _unread(src, dst, topic, targets, group_id, resume, to_positions=to_positions)
    envelopes = route(consumed, duplicate, ignore, duplicate_topics, single_topic, False, group_id)
    positions = commit_rows(envelopes.select("pass_through.*"), group_id, commit_grouping)
    _write_copies(dst, explode_envelopes(envelopes), seg, ["part"], positions, True, targets, src.root)
    return dst.read(segments=[seg], with_source=True), envelopes
