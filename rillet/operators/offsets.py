"""Offset assignment (the log's job on produce).

Offsets are dense per (topic, partition), starting at the partition's current
end offset, in a caller-given order. A window ``row_number() over (partition by
topic, partition ...)`` would put a whole partition in one task; a hot partition
can hold a third of a topic. Records that lie in their order already, split by split
(a table written in order, a topic log), are numbered where they are (``assign_in_splits``):

1. a narrow pass counts the records of each (input split, topic, partition) and takes their
   least and greatest order values; a split is named by its task, file and block;
2. when the splits of a target don't overlap in the order, prefix sums over them give each
   its first offset, and prefix sums over a task its place in the task;
3. the record pass sorts inside each task, numbers the rows and joins the small table: a scan,
   a local sort, a broadcast join and the write. No shuffle of records.

Where splits overlap, or records come out of a shuffle, a two-pass prefix sum over range
slices is used instead (``assign_offsets``):

1. range-partition on (topic, partition, order...) - the order columns make the
   keys fine-grained, so a hot partition is split over many tasks - sort inside
   each task and tag rows with ``monotonically_increasing_id`` (task id in the
   high bits, position in the low bits); stage the result as a written table in
   the shared checkpoint folder, which fixes the split and cuts lineage;
2. count rows per (task, topic, partition) - a tiny table, at most
   tasks + partitions rows - and turn it into a running base per slice;
3. offset = end offset + rows in earlier slices + position within the slice.

When records are copied from contiguous source ranges (replication, fan-out)
the order is (source topic, source partition, source offset) and the position
follows from arithmetic on the source offset: no sort and no shuffle of records.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillet.model import TP
from rillet.session import scratch_dir
from rillet.sources import fs

# Small side tables (slice statistics, end offsets) are broadcast only below this row count.
BROADCAST_ROWS = 1_000_000
TARGET_SLICE_BYTES = 256 * 1024 * 1024
MAX_SLICES = 400_000  # 100 TB at 256 MB; beyond that slices grow instead
_LOW_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


@contextmanager
def staging_area(spark: SparkSession):
    """A staging folder in the shared checkpoint folder, removed when the block ends.

    Writers assign offsets inside the block and write their segment before it
    closes; the staged copy of the records does not outlive the write.
    """
    path = scratch_dir(spark, "offsets")
    try:
        yield path
    finally:
        fs.delete(spark, path)


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def slice_count(df: DataFrame) -> int:
    """Number of range slices: ~256 MB each (at 100 TB about 400k), at least the shuffle width."""
    spark = df.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - statistics are a hint only
        size = 0
    if size >= 2**62:  # no statistics (Long.MaxValue): fall back to the shuffle width
        size = 0
    return min(max(base, math.ceil(size / TARGET_SLICE_BYTES)), max(base, MAX_SLICES))


def with_rows(df: DataFrame, rows: int) -> DataFrame:
    """Remember a proven row count (tables fixed from local rows), so no job re-counts them."""
    df._rillet_rows = int(rows)
    return df


def local_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A small table from rows already on the driver, with its row count recorded."""
    return with_rows(spark.createDataFrame(rows, schema), len(rows))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with ``small`` broadcast only when its row count is proven under the bound."""
    if rows is None:
        rows = getattr(small, "_rillet_rows", None)
    n = small.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def end_offsets_or_empty(spark, ends: DataFrame | None) -> DataFrame:
    if ends is not None:
        out = ends.select(*TP, F.col("end_offset").cast("long").alias("_base"))
        known = getattr(ends, "_rillet_rows", None)
        return with_rows(out, known) if known is not None else out
    return local_table(spark, [], "topic string, partition int, _base long")


def assign_offsets(
    df: DataFrame,
    order_by,
    ends: DataFrame | None = None,
    slices: int | None = None,
    staging: str | None = None,
) -> DataFrame:
    """Add ``offset``: dense per (topic, partition) in ``order_by`` order, after ``ends``.

    ``ends`` holds (topic, partition, end_offset) of the target log; missing keys start at 0.
    The order columns must make the order total (add a unique tiebreaker). The result
    reads the staged table at ``staging`` (see ``staging_area``), so it must be
    consumed before that folder is removed; without ``staging`` a scratch folder is kept.
    """
    spark = df.sparkSession
    order = _cols(order_by)
    n = slices or slice_count(df)
    keys = [F.col("topic"), F.col("partition")]
    staged_path = f"{staging}/staged" if staging else scratch_dir(spark, "offsets")
    (
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_rid", F.monotonically_increasing_id())
        .write.parquet(staged_path)
    )
    staged = spark.read.parquet(staged_path).withColumn("_slice", F.shiftright("_rid", _LOW_BITS))

    stats = staged.groupBy("_slice", *TP).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_first")
    )
    before = Window.partitionBy(*TP).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    base = end_offsets_or_empty(spark, ends)
    stats = join_small(stats, base, TP, "left").select(
        "_slice",
        *TP,
        "_first",
        (F.coalesce(F.col("_base"), F.lit(0)) + F.col("_before")).alias("_start"),
    )
    # at most slices + partitions rows (each slice holds a contiguous key range): fix it once
    # as local rows so the record pass neither re-aggregates nor re-counts it; beyond the
    # broadcast bound it stays distributed and the join shuffles
    head = stats.limit(BROADCAST_ROWS + 1).collect()
    if len(head) <= BROADCAST_ROWS:
        stats = local_table(spark, head, stats.schema)
    out = join_small(staged, stats, ["_slice", *TP])
    out = out.withColumn("offset", (F.col("_start") + F.col("_rid") - F.col("_first")).cast("long"))
    return out.drop("_rid", "_slice", "_first", "_start")


_SPLIT = ["_task", "_file", "_block"]


def _shuffled(node) -> bool:
    """True when the rows of a physical plan come out of a shuffle (what is broadcast to them may)."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(node.initialPlan())
    if kind == "BroadcastExchangeExec":
        return False
    if "Exchange" in kind:
        return True
    kids = node.children()
    return any(_shuffled(kids.apply(i)) for i in range(kids.size()))


def _located(df: DataFrame) -> DataFrame | None:
    """``df`` with the input split of each row, or None when its rows have been shuffled."""
    if _shuffled(df._jdf.queryExecution().executedPlan()):
        return None
    if "_metadata" in df._jdf.queryExecution().analyzed().metadataOutput().toString():
        file, block = F.xxhash64("_metadata.file_path"), F.col("_metadata.file_block_start")
    else:  # rows that don't come from files: a task is a split
        file = block = F.lit(0).cast("long")
    return df.withColumns({"_task": F.spark_partition_id(), "_file": file, "_block": block})


def assign_in_splits(
    df: DataFrame, order_by, ends: DataFrame | None = None, range_by=None
) -> tuple[DataFrame, DataFrame] | None:
    """Offsets as by ``assign_offsets``, with every record staying in its input split.

    Returns (records with ``offset``, index rows), or None where it can't be done: the splits of
    a (topic, partition) overlap in the order, there are more than ``BROADCAST_ROWS`` counts, or
    the records come out of a shuffle. ``range_by``: the first order columns, when they alone
    tell records of different splits apart (the payload then takes no part in the counting).
    Both passes must see the same splits; a record whose split was not counted, or that goes
    beyond its count, fails the write.
    """
    located = _located(df)
    if located is None:
        return None
    order = _cols(order_by)
    bounds = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_cols(range_by or order_by))])
    stats = located.groupBy(*_SPLIT, *TP).agg(
        F.count(F.lit(1)).alias("_n"), F.min(bounds).alias("_lo"), F.max(bounds).alias("_hi")
    )
    target = Window.partitionBy(*TP).orderBy("_lo", "_hi", *_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    task = Window.partitionBy("_task").orderBy(*TP, "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select(
        *_SPLIT,
        *TP,
        "_n",
        F.coalesce(F.sum("_n").over(target), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(task), F.lit(0)).alias("_first"),
        F.coalesce(F.max("_hi").over(target) >= F.col("_lo"), F.lit(False)).alias("_overlaps"),
    )
    base = end_offsets_or_empty(df.sparkSession, ends)
    stats = join_small(stats, base, TP, "left").withColumn("_start", F.coalesce("_base", F.lit(0)) + F.col("_before"))
    # a bounded table of counts, fixed for both uses
    rows = stats.drop("_base", "_before").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS or any(r["_overlaps"] for r in rows):
        return None
    table = local_table(df.sparkSession, [tuple(r)[:-2] + (r["_start"],) for r in rows], stats.drop("_base", "_before", "_overlaps").schema)
    numbered = located.sortWithinPartitions(*TP, "_file", "_block", *order).withColumn(
        "_rid", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    )
    at = F.col("_rid") - F.col("_first")
    lost = F.raise_error(F.lit("the input's splits have changed between counting and writing"))
    out = join_small(numbered, table, [*_SPLIT, *TP], "left").withColumn(
        "offset", F.when((at >= 0) & (at < F.col("_n")), F.col("_start") + at).otherwise(lost.cast("long")).cast("long")
    )
    index = table.groupBy(*TP).agg(
        F.min("_start").alias("begin_offset"),
        F.max(F.col("_start") + F.col("_n")).alias("end_offset"),
        F.sum("_n").cast("long").alias("n_records"),
    )
    return out.drop(*_SPLIT, "_rid", "_first", "_start", "_n"), index


def number(
    df: DataFrame, order_by, ends: DataFrame | None = None, staging: str | None = None, range_by=None
) -> tuple[DataFrame, DataFrame | None]:
    """Offsets in the input's splits where possible, else over range slices: (records, index rows if known)."""
    return assign_in_splits(df, order_by, ends, range_by) or (assign_offsets(df, order_by, ends, staging=staging), None)


def offsets_from_source(
    df: DataFrame,
    ends: DataFrame | None = None,
    src_topic: str = "src_topic",
    src_partition: str = "src_partition",
    src_offset: str = "src_offset",
    source_ranges: DataFrame | None = None,
    tiebreak: list[str] | None = None,
    staging: str | None = None,
    with_index: bool = False,
):
    """Offsets for records copied from source ranges, ordered by source position.

    Every (target, source partition) range must be contiguous - true for whole-log,
    seek and partition reads and for fan-out copies. Checked on a small aggregate
    that reads key columns only; a gap falls back to ``number``.

    ``with_index``: also return the segment index rows the write will produce
    (topic, partition, begin_offset, end_offset, n_records), known from the range
    table without reading the written data; None on the two-pass fallback.
    """
    spark = df.sparkSession
    src = [src_topic, src_partition]
    ranges = source_ranges
    if ranges is None:
        ranges = df.groupBy(*TP, *src).agg(
            F.min(src_offset).alias("_lo"),
            F.max(src_offset).alias("_hi"),
            F.count(F.lit(1)).alias("_n"),
        )
    ranges = ranges.cache()
    try:
        check = ranges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((F.col("_hi") - F.col("_lo") + 1 != F.col("_n")).cast("int")).alias("gaps"),
        ).first()
        n_ranges, gaps = int(check["n"]), int(check["gaps"] or 0)
        if gaps:
            order = [src_topic, src_partition, src_offset]
            out, index = number(df, [*order, *(tiebreak or [])], ends, staging, order)
            return (out, index) if with_index else out
        before = Window.partitionBy(*TP).orderBy(*src).rowsBetween(Window.unboundedPreceding, -1)
        base = end_offsets_or_empty(spark, ends)
        table = join_small(
            ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))),
            base,
            TP,
            "left",
        ).select(
            *TP,
            *src,
            "_lo",
            "_n",
            (F.coalesce(F.col("_base"), F.lit(0)) + F.col("_before")).alias("_start"),
        )
        if n_ranges <= BROADCAST_ROWS:
            # one row per (target partition, source partition): metadata, bounded by partition
            # counts; fixed here so the record pass does not recompute it
            table = local_table(spark, table.collect(), table.schema)
        out = join_small(df, table.drop("_n"), [*TP, *src], rows=n_ranges)
        index = table.where(F.col("_n") > 0).groupBy(*TP).agg(
            F.min("_start").alias("begin_offset"),
            F.max(F.col("_start") + F.col("_n")).alias("end_offset"),
            F.sum("_n").cast("long").alias("n_records"),
        )
    finally:
        ranges.unpersist()
    out = out.withColumn(
        "offset", (F.col("_start") + F.col(src_offset) - F.col("_lo")).cast("long")
    ).drop("_lo", "_start")
    return (out, index) if with_index else out
