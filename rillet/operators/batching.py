"""Commit folds and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.model import COMMIT_BATCH, DEFAULT_GROUP


def _with_group(df: DataFrame, group_id: str | None) -> DataFrame:
    if "group_id" in df.columns and group_id is None:
        return df
    return df.withColumn("group_id", F.lit(group_id or DEFAULT_GROUP))


def commit_positions(df: DataFrame, group_id: str | None = None, offset: str = "offset") -> DataFrame:
    """G1: fold positions to the next offset per (group, topic, partition).

    A partial + final hash aggregate over three small columns; Parquet reads only those.
    """
    return (
        _with_group(df, group_id)
        .groupBy("group_id", "topic", "partition")
        .agg((F.max(offset) + 1).cast("long").alias("next_offset"))
    )


def commit_batches(
    df: DataFrame, size: int = COMMIT_BATCH, group_id: str | None = None, offset: str = "offset"
) -> DataFrame:
    """Commit batches of at most ``size`` positions per partition.

    Deterministic form: batch = floor(offset / size) within (group, topic, partition);
    one commit (next offset) per batch, with its first offset and size.
    """
    return (
        _with_group(df, group_id)
        .withColumn("batch", F.floor(F.col(offset) / F.lit(size)).cast("long"))
        .groupBy("group_id", "topic", "partition", "batch")
        .agg(
            F.min(offset).alias("first_offset"),
            (F.max(offset) + 1).cast("long").alias("next_offset"),
            F.count(F.lit(1)).alias("n_records"),
        )
    )


def positions(
    consumed: DataFrame,
    group_id: str = DEFAULT_GROUP,
    grouping: tuple | None = None,
) -> DataFrame:
    """Positions to commit for consumed records (group_id, topic, partition, begin_offset, next_offset).

    ``grouping``: None - one position per partition (G1); ``("batch", n)`` - one per
    batch of n offsets (G2 / G3); ``("within", n, seconds)`` - one per count-or-time
    group (G4). The latest position is the same either way; the commit log differs.
    """
    cols = ["group_id", "topic", "partition", "begin_offset", "next_offset"]
    if grouping is None:
        return consumed.groupBy("topic", "partition").agg(
            F.min("offset").alias("begin_offset"), (F.max("offset") + 1).alias("next_offset")
        ).select(F.lit(group_id).alias("group_id"), *cols[1:])
    kind = grouping[0]
    if kind == "batch":
        batches = commit_batches(consumed.select("topic", "partition", "offset"), grouping[1], group_id)
        return batches.withColumnRenamed("first_offset", "begin_offset").select(*cols)
    if kind == "within":
        from rillet.operators.grouped_within import grouped_within

        groups = grouped_within(consumed, grouping[1], grouping[2])
        groups = groups.withColumnRenamed("first_offset", "begin_offset")
        return groups.select(F.lit(group_id).alias("group_id"), *cols[1:])
    raise ValueError(f"unknown grouping {grouping!r}")


def grouped_commits_carrying(
    consumed: DataFrame,
    carried: DataFrame,
    n: int,
    seconds: float,
    group_id: str,
    open_id: str,
    path: str,
) -> DataFrame:
    """G4 across micro-batches: positions of the groups that closed, and of those still open.

    ``carried`` holds the records of each partition's open group (at most n per partition);
    they are put in front of this batch's records, so a group may span batches and closed groups
    equal the batch definition. The last group of a partition stays open unless it is full: its
    range is a position of ``open_id`` (an empty range at the end of what was read, if none is
    open). The groups are written once, to ``path``.
    """
    from rillet.operators.grouped_within import grouped_within
    from rillet.operators.offsets import join_small

    rows = consumed.select("topic", "partition", "offset", F.col("timestamp").cast("timestamp")).unionByName(
        carried.select("topic", "partition", "offset", "timestamp")
    )
    grouped_within(rows, n, seconds).write.parquet(path)
    groups = rows.sparkSession.read.parquet(path)
    last = groups.groupBy("topic", "partition").agg(F.max("first_offset").alias("_last"))
    tagged = join_small(groups, last, ["topic", "partition"])
    is_last = F.col("first_offset") == F.col("_last")
    is_open = is_last & (F.col("n_records") < n)
    closed = tagged.where(~is_open).select(
        F.lit(group_id).alias("group_id"), "topic", "partition", F.col("first_offset").alias("begin_offset"), "next_offset"
    )
    begin = F.when(is_open, F.col("first_offset")).otherwise(F.col("next_offset"))
    still_open = tagged.where(is_last).select(
        F.lit(open_id).alias("group_id"), "topic", "partition", begin.alias("begin_offset"), "next_offset"
    )
    return closed.unionByName(still_open)
