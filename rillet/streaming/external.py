"""Processing with the position kept in external storage (T4, S3).

The position is stored in the output log's ``commits`` table, written in the
same segment as the processed output, so output and position commit together.
A restart reads the stored position (0 when none: a first run reads from the
start) and continues from there.

The reference stores the offset of the last processed record, not the next
one, and restarts inclusively, so that record is processed again;
``inclusive=True`` reproduces this, the default stores the next offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.functions.records import business, readdress
from rillet.model import DEFAULT_GROUP, TP
from rillet.operators.offsets import number, offsets_from_source, staging_area
from rillet.sources.log import TopicLog, new_segment_id


def stop_positions(records: DataFrame, until: Column) -> DataFrame:
    """Per partition, the offset of the first record that doesn't match ``until`` (null: all do)."""
    past = F.when(~F.coalesce(until, F.lit(False)), F.col("offset"))
    return records.groupBy(*TP).agg(F.min(past).alias("next_offset"))


def process_from_stored_offset(
    src: TopicLog,
    topic: str,
    out: TopicLog,
    out_topic: str = "processed",
    group_id: str = DEFAULT_GROUP,
    partitions: list[int] | None = None,
    fn: Callable[[DataFrame], DataFrame] | None = None,
    until: Column | None = None,
    inclusive: bool = False,
) -> str:
    """One run: read ``topic`` from the stored positions, process, store output and position.

    ``until`` stops each partition before its first record that doesn't match, standing in
    for a consumer that is shut down part-way. Positions are those of the records read,
    whatever ``fn`` makes of them. Returns the segment written.
    """
    seg = new_segment_id("ext")
    start = out.committed_positions(group_id, src.root).where(F.col("topic") == topic)
    to = None if until is None else stop_positions(src.read(topic, partitions=partitions), until)
    records = src.read(topic, partitions=partitions, from_positions=start, to_positions=to)
    processed = business(records, fn)
    step = 0 if inclusive else 1
    positions = records.groupBy(*TP).agg(F.min("offset").alias("begin_offset"), (F.max("offset") + step).alias("next_offset")).select(
        F.lit(group_id).alias("group_id"), *TP, "begin_offset", "next_offset"
    )
    copies = readdress(processed, out_topic, keep_key=True)
    with staging_area(out.spark) as staging:
        if fn is None:
            written, index = offsets_from_source(copies, out.end_offsets([out_topic]), staging=staging, with_index=True)
        else:  # the hook may drop or repeat records
            order = ["src_topic", "src_partition", "src_offset"]
            written, index = number(copies, [*order, "key", "value"], out.end_offsets([out_topic]), staging, order)
        out.write_segment(written, seg, commits=positions, index=index, source=src.root)
    return seg
