"""Per-partition processing in offset order.

A partitioned source in the reference is one sub-stream a partition, each consumed in order by
one consumer, its positions committed in batches. A function of a partition that needs order
can't be split, but it need not see the partition at once: it gets a slice at a time, in offset
order, and what it carried from the slice before. ``process_partitions`` takes up to ``ROUND``
records of every partition in a round (one Spark job): a task reads its partition's records as
sorted by the shuffle and holds one slice. Partitions run in parallel and end independently of
each other. So the number of jobs follows the records, however short the slices are.

A partition's output goes to the same partition of the output topic, from one task and in order.
So the task numbers its records as it makes them, from the committed end offset on, and the
round's output is written once, in place: it is not staged, counted and read again.

What is carried is a record of a topic of its own in the output log, one for each slice, written
in the round's segment together with its output and positions. So a run that ends anywhere is
resumed where it was: output, positions and carried state are committed together or not at all.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.model import DEFAULT_GROUP, MERGED_COMMIT_BATCH, TP
from rillet.operators.offsets import join_small, local_table
from rillet.sources.log import TopicLog, new_segment_id

#: Records of a partition that the function gets at a time.
SLICE = 1_000_000
#: Records of a partition that one task takes in a round (one slice, where that is longer).
ROUND = 1_000_000
#: Records whose output a task hands over at once.
HAND_OVER = 10_000

#: fn(records in offset order, carry or None) -> (one value (text) or None for each record, carry)
SliceFn = Callable[[pd.DataFrame, object], tuple[list, object]]

_IN = ["partition", "offset", "key", "value", "timestamp"]
_OUT = "partition int, offset long, key string, value binary, timestamp timestamp, src_offset long, _carried boolean"
#: The offset of what was carried, before a partition's records.
_CARRY = -1


def carry_topic(out_topic: str, group_id: str) -> str:
    return f"{out_topic}-carry-{group_id}"


def _run(fn: SliceFn, topic: str, slice_records: int, starts: dict[int, int], ends: dict[int, tuple[int, int]]):
    """``starts``: where each partition begins. ``ends``: the end offsets of its output and of its carries."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
        """(partition, slice, records) of each slice; what was carried comes as slice -1."""
        held, of, partition = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.unique(batch.column("partition").to_numpy())
            partition = int(found[0]) if partition is None else partition
            if found.tolist() != [partition]:
                raise ValueError(f"a task of partition {partition} got records of {found.tolist()}")
            offsets = batch.column("offset").to_numpy()
            tags = np.where(offsets == _CARRY, -1, (offsets - starts[partition]) // slice_records)
            cuts = [0, *(np.flatnonzero(tags[1:] != tags[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                tag = int(tags[low])
                if held and tag != of:
                    yield partition, of, pa.Table.from_batches(held)
                    held = []
                of = tag
                held.append(batch.slice(low, high - low))
        if held:
            yield partition, of, pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, values, kept, state, at = [], [], [], None, None
        for partition, slice_, records in slices(batches):
            at = at or list(ends[partition])
            if slice_ < 0:
                state = json.loads(records["value"][-1].as_py())
                continue
            frame = records.to_pandas(coerce_temporal_nanoseconds=True)
            frame["timestamp"] = frame["timestamp"].dt.tz_localize(None)
            frame.insert(0, "topic", topic)
            got, state = fn(frame, state)
            if len(got) != len(frame):
                raise ValueError(f"{len(got)} values for {len(frame)} records")
            taken.append(records)
            values += [None if v is None else str(v) for v in got]
            kept.append((records.slice(len(frame) - 1), json.dumps(state)))
            if len(values) >= HAND_OVER:
                yield from made(taken, values, kept, at)
                taken, values, kept = [], [], []
        if taken:
            yield from made(taken, values, kept, at)

    def made(taken: list[pa.Table], values: list, kept: list[tuple[pa.Table, str]], at: list[int]) -> Iterator[pa.RecordBatch]:
        states = [s for _, s in kept]
        for k, (parts, texts) in enumerate(((taken, values), ([r for r, _ in kept], states))):
            source, value = pa.concat_tables(parts), pa.array(texts, pa.string()).cast(pa.binary())
            if value.null_count:  # a value of None is no record
                source, value = source.filter(value.is_valid()), value.drop_null()
            n = len(value)
            columns = {
                "partition": source["partition"], "offset": np.arange(at[k], at[k] + n),
                "key": pa.nulls(n, pa.string()) if k else source["key"], "value": value,
                "timestamp": source["timestamp"], "src_offset": source["offset"], "_carried": np.full(n, bool(k)),
            }
            at[k] += n
            yield from pa.table(columns).combine_chunks().to_batches()

    return run


def process_partitions(
    src: TopicLog,
    topic: str,
    fn: SliceFn,
    out: TopicLog,
    out_topic: str,
    group_id: str = DEFAULT_GROUP,
    commit_every: int = MERGED_COMMIT_BATCH,
    slice_records: int = SLICE,
    rounds: int | None = None,
) -> int:
    """``fn`` over each partition of ``topic`` in offset order, resumed where it was.

    ``fn`` gets a slice's records in order and what it carried from the slice before (None at
    first; anything that JSON holds), and returns a value (or None: no record) for each record
    and what to carry on. Positions are committed every ``commit_every`` records of a partition
    and at a slice's end. Runs until everything is processed, or ``rounds`` slices a partition;
    returns the slices of the partition that had most.
    """
    spark = src.spark
    carried = carry_topic(out_topic, group_id)
    done = 0
    while rounds is None or done < rounds:
        # where each partition stands: the end of what the group has consumed from its start
        ends = src.catalog([topic]).select(*TP, "begin_offset", F.col("end_offset").alias("_end"))
        at = out.consumed(group_id, src.root, [topic]).groupBy(*TP).agg(F.max("next_offset").alias("_at"))
        bounds = join_small(ends, at, TP, "left").select(
            *TP, F.coalesce("_at", "begin_offset").alias("_from"), "_end"
        ).where("_from < _end").collect()
        if not bounds:
            return done
        n_slices = max(1, ROUND // slice_records)
        if rounds is not None:
            n_slices = min(n_slices, rounds - done)
        reach = n_slices * slice_records
        reached = [(r.partition, i, r._from, r._from + reach) for i, r in enumerate(bounds)]
        task = local_table(spark, reached, "partition int, _task int, _from long, _to long")
        # the least and greatest offsets wanted reach the scan and skip row groups
        inside = (F.col("offset") >= min(r._from for r in bounds)) & (F.col("offset") < max(r._from for r in bounds) + reach)
        records = src.read(topic, partitions=[r.partition for r in bounds]).where(inside).select(*_IN)
        records = join_small(records, task, "partition").where("offset >= _from and offset < _to")
        carry = join_small(_carry(out, carried), task.select("partition", "_task"), "partition", rows=len(bounds))
        rows = records.drop("_from", "_to").unionByName(carry.withColumn("offset", F.lit(_CARRY).cast("long")), allowMissingColumns=True)
        # a partition is a task of its own, so the offset alone is its order
        rows = rows.repartitionById(len(bounds), "_task").sortWithinPartitions("offset").select(*_IN)
        slice_, batch = (F.floor(x / F.lit(n)) for x, n in ((F.col("offset") - F.col("_from"), slice_records), (F.col("offset"), commit_every)))
        commits = records.groupBy("partition", slice_.alias("_slice"), batch.alias("_batch")).agg(
            F.min("offset").alias("begin_offset"), (F.max("offset") + 1).alias("next_offset")
        ).select(F.lit(group_id).alias("group_id"), F.lit(topic).alias("topic"), "partition", "begin_offset", "next_offset")
        known = {(r.topic, r.partition): r.end_offset for r in out.end_offsets([out_topic, carried]).collect()}
        ends = {r.partition: (known.get((out_topic, r.partition), 0), known.get((carried, r.partition), 0)) for r in bounds}
        made = rows.mapInArrow(_run(fn, topic, slice_records, {r.partition: r._from for r in bounds}, ends), _OUT)
        made = made.select(
            F.when(F.col("_carried"), F.lit(carried)).otherwise(F.lit(out_topic)).alias("topic"), *_IN,
            F.lit(topic).alias("src_topic"), F.col("partition").alias("src_partition"), "src_offset",
        )
        out.write_segment(made, new_segment_id(f"ordered-{group_id}"), commits, source=src.root)
        done += max(min(n_slices, -(-(r._end - r._from) // slice_records)) for r in bounds)
    return done


def _carry(out: TopicLog, carried: str) -> DataFrame:
    """The last carried value of each partition: one record each, by the log's end offsets."""
    last = out.catalog([carried]).select(*TP, (F.col("end_offset") - 1).alias("next_offset"))
    return out.read(carried, from_positions=last).select("partition", "value")
