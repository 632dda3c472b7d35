"""The topic log: Parquet files plus a segment index.

Layout under ``root``::

    data/topic=<t>/partition=<p>/seg=<s>/part-*.parquet   offset, key, value, timestamp
    segments/seg=<s>/part-*.parquet                        one row per (topic, partition) in <s>
    commits/group_id=<g>/seg=<s>/part-*.parquet            committed positions
    claims/<flow>/<batch>                                  at-most-once claim markers
    snapshots/n=<k>/{index,catalog,done}                   the index so far in few files (``compact``)

A *segment* is everything one write produced. It becomes visible when its index
rows exist (written last), so readers see committed segments only
(read-committed), the catalog and end offsets come from the small index instead
of a scan, and a replayed write of the same segment id overwrites its own
directories (dynamic partition overwrite) instead of adding a copy.

One writer per topic at a time: offsets continue from the committed end offsets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillet.model import (
    DEFAULT_TOPIC_PARTITIONS,
    RANGE_SCHEMA,
    RECORD_COLUMNS,
    SEGMENT_SCHEMA,
    SOURCE_COLUMNS,
    STORED_COMMIT_SCHEMA,
    STORED_SCHEMA,
    TP,
)
from rillet.operators.offsets import BROADCAST_ROWS, join_small, local_table, number, staging_area
from rillet.session import configure
from rillet.sources import fs


# Positions written apart from a segment (they stand alone) carry this prefix in their folder name.
ALONE = "alone-"
#: Folders (topic, partition, segment) that a resumed read names one by one; beyond it, it lists the topic.
NAMED_FOLDERS = 10_000


def new_segment_id(prefix: str = "w") -> str:
    return f"{prefix}-{uuid.uuid4().hex[:16]}"


def _as_binary(c: Column) -> Column:
    return c.cast("binary")


class TopicLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.data_path = f"{self.root}/data"
        self.index_path = f"{self.root}/segments"
        self.commits_path = f"{self.root}/commits"
        self.claims_path = f"{self.root}/claims"
        self.snapshots_path = f"{self.root}/snapshots"
        self._covered: tuple[str, frozenset[str]] | None = None

    # ------------------------------------------------------------------ index
    def segments(self) -> DataFrame:
        """The index: rows of all committed segments, from the snapshot where there is one, and the newer folders."""
        if not fs.exists(self.spark, self.index_path):
            return self.spark.createDataFrame([], SEGMENT_SCHEMA)
        at = self._since_snapshot()
        if at is None:
            return self.spark.read.schema(SEGMENT_SCHEMA).parquet(self.index_path)
        snapshot, newer = at
        return self.spark.read.schema(SEGMENT_SCHEMA).parquet(f"{snapshot}/index").unionByName(self._index_of(newer))

    def _index_of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SEGMENT_SCHEMA)
        reader = self.spark.read.schema(SEGMENT_SCHEMA).option("basePath", self.index_path)
        return reader.parquet(*[f"{self.index_path}/{name}" for name in folders])

    def _since_snapshot(self) -> tuple[str, list[str]] | None:
        """The latest snapshot's folder and the index folders that it does not hold; None without one.

        The driver lists the folders' names; the files of covered folders are not opened. None also
        when there are too many newer folders to name.
        """
        done = [n for n in self._snapshots() if fs.exists(self.spark, f"{self.snapshots_path}/{n}/done")]
        if not done:
            return None
        snapshot = f"{self.snapshots_path}/{done[-1]}"
        if self._covered is None or self._covered[0] != snapshot:
            names = self.spark.read.parquet(f"{snapshot}/index").select("seg").distinct().collect()
            self._covered = (snapshot, frozenset(self._dir("seg", r.seg) for r in names))
        folders = [n for n in fs.list_names(self.spark, self.index_path) if n.startswith("seg=")]
        newer = sorted(n for n in folders if n not in self._covered[1])
        return None if len(newer) > NAMED_FOLDERS else (snapshot, newer)

    def _snapshots(self) -> list[str]:
        return sorted(n for n in fs.list_names(self.spark, self.snapshots_path) if n.startswith("n="))

    def compact(self) -> None:
        """Write the index so far as a snapshot, so that readers open few files instead of one a segment.

        A snapshot counts once its ``done`` marker exists; the one before it stays for readers that
        have begun, older ones go. Index folders stay where they are: streams read them. One
        compaction at a time; writers and readers may go on.
        """
        if not fs.exists(self.spark, self.index_path):
            return
        known = self._snapshots()
        name = f"n={int(known[-1][2:]) + 1 if known else 1:012d}"
        folder = f"{self.snapshots_path}/{name}"
        rows = self.segments().repartitionByRange("topic", "partition").sortWithinPartitions(*TP, "begin_offset")
        rows.select(*SEGMENT_SCHEMA.names).write.parquet(f"{folder}/index")
        # the catalog of exactly these rows: segments may have come since
        held = self.spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/index")
        self._summed(held).coalesce(1).write.parquet(f"{folder}/catalog")
        fs.create_new(self.spark, f"{folder}/done", "done")
        for old in known[:-1]:
            fs.delete(self.spark, f"{self.snapshots_path}/{old}")

    def _forget_snapshots(self, seg: str | Column) -> None:
        """Before a covered segment is written again (or several of any name): its rows in a snapshot would be old."""
        if not self._snapshots():
            return
        if isinstance(seg, str):
            self._since_snapshot()
            if self._covered is not None and self._dir("seg", seg) not in self._covered[1]:
                return
        fs.delete(self.spark, self.snapshots_path)
        self._covered = None

    def is_committed(self, seg: str) -> bool:
        """A segment is committed once its index directory exists (renamed in at job commit)."""
        return fs.exists(self.spark, f"{self.index_path}/{self._dir('seg', seg)}")

    def catalog(self, topics: list[str] | None = None) -> DataFrame:
        """One row per (topic, partition) with begin/end offsets and record count.

        With a snapshot, from its catalog and the index rows of newer segments.
        """
        at = self._since_snapshot()
        if at is None:
            rows = self.segments()
        else:
            kept = self.spark.read.schema(self._summed(self._index_of([])).schema).parquet(f"{at[0]}/catalog")
            rows = kept.unionByName(self._index_of(at[1]).select(*kept.columns))
        if topics is not None:
            rows = rows.where(F.col("topic").isin(list(topics)))
        return self._summed(rows)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*TP).agg(
            F.min("begin_offset").alias("begin_offset"),
            F.max("end_offset").alias("end_offset"),
            F.sum("n_records").cast("long").alias("n_records"),
        )

    def end_offsets(self, topics: list[str] | None = None) -> DataFrame:
        """Committed end offsets, frozen now: later commits must not shift offsets being assigned.

        One row per (topic, partition) of the log - metadata, never records.
        """
        rows = self.catalog(topics).select(*TP, "end_offset").collect()
        return local_table(self.spark, rows, "topic string, partition int, end_offset long")

    # ------------------------------------------------------------------- read
    def _dir(self, column: str, value: str) -> str:
        """A partition folder name as Spark writes it (special characters escaped)."""
        jvm = self.spark.sparkContext._jvm
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{column}={escape(str(value))}"

    def _scan(self, topics: list[str] | None, seg: str | None = None) -> DataFrame:
        """The data files, listing only the named topics' folders (or one segment's)."""
        reader = self.spark.read.schema(STORED_SCHEMA).option("basePath", self.data_path)
        if seg is not None and "*" not in seg:
            tops = [self._dir("topic", t) for t in topics] if topics else ["topic=*"]
            paths = [f"{self.data_path}/{t}/partition=*/{self._dir('seg', seg)}" for t in tops]
            paths = [p for p in paths if fs.glob_any(self.spark, p)]
            if not paths:
                return self.spark.createDataFrame([], STORED_SCHEMA)
            return reader.parquet(*paths)
        if topics:
            present = set(fs.list_names(self.spark, self.data_path))
            dirs = [self._dir("topic", t) for t in topics]
            paths = [f"{self.data_path}/{d}" for d in dirs if d in present]
            if not paths:
                return self.spark.createDataFrame([], STORED_SCHEMA)
            return reader.parquet(*paths)
        return reader.parquet(self.data_path)

    def read(
        self,
        topics: list[str] | str | None = None,
        partitions: list[int] | None = None,
        from_offset: int | None = None,
        segments: list[str] | None = None,
        committed: bool = True,
        with_source: bool = False,
        from_positions: DataFrame | None = None,
        to_positions: DataFrame | None = None,
        consumed: DataFrame | None = None,
    ) -> DataFrame:
        """Records of the given topics (all when None), committed segments only.

        Topic, partition and segment filters prune directories; ``from_offset`` is
        pushed to the Parquet reader and skips row groups by their offset statistics.
        ``from_positions`` and ``to_positions`` (topic, partition, next_offset) bound each
        partition: the first included, the second not. Of several rows for a partition the
        highest counts; a partition without a row, or with a null, is not bounded.
        ``consumed`` (topic, partition, begin_offset, next_offset) leaves out the records of these
        ranges, and does not open the folders of segments that lie inside one.
        """
        cols = RECORD_COLUMNS + (SOURCE_COLUMNS if with_source else [])
        if getattr(consumed, "_rillet_rows", None) == 0:
            consumed = None
        if not fs.exists(self.spark, self.data_path):
            return self.spark.createDataFrame([], STORED_SCHEMA).select(*cols)
        if isinstance(topics, str):
            topics = [topics]
        one_seg = segments[0] if segments is not None and len(segments) == 1 else None
        parts = None if consumed is None or segments is not None else self._unconsumed(topics, consumed)
        if parts is not None:
            df = self._folders(parts)
        else:
            df = self._scan(topics, one_seg)
        if topics is not None:
            df = df.where(F.col("topic").isin(list(topics)))
        if partitions is not None:
            df = df.where(F.col("partition").isin([int(p) for p in partitions]))
        if segments is not None:
            df = df.where(F.col("seg").isin(list(segments)))
        if from_offset is not None:
            df = df.where(F.col("offset") >= F.lit(int(from_offset)))
        if from_positions is not None:
            df = self._bounded(df, from_positions, lambda at: F.col("offset") >= at)
        if to_positions is not None:
            df = self._bounded(df, to_positions, lambda at: F.col("offset") < at)
        if consumed is not None:
            df = self._without(df, consumed, F.col("offset"), F.col("offset") + 1)
        if committed and segments is None and parts is None:
            # a segment is committed as a whole: its name alone decides visibility
            index = self.segments()
            if topics is not None:
                index = index.where(F.col("topic").isin(list(topics)))
            df = join_small(df, index.select("seg").distinct(), ["seg"], "left_semi")
        return df.select(*cols)

    def read_segments(self, parts: list[tuple[str, int, str]], with_source: bool = False) -> DataFrame:
        """Records of exact (topic, partition, segment) folders, e.g. one micro-batch's.

        Only those folders are listed, so the cost follows the segments asked for, not
        the age of the log. Every index row names a folder that exists.
        """
        return self._folders(parts).select(*RECORD_COLUMNS, *(SOURCE_COLUMNS if with_source else []))

    def _folders(self, parts: list[tuple[str, int, str]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STORED_SCHEMA)
        paths = [
            f"{self.data_path}/{self._dir('topic', t)}/{self._dir('partition', p)}/{self._dir('seg', g)}"
            for t, p, g in sorted(set(parts))
        ]
        reader = self.spark.read.schema(STORED_SCHEMA).option("basePath", self.data_path)
        return reader.parquet(*paths)

    def read_ranges(self, ranges: DataFrame) -> DataFrame:
        """Records inside the given ranges (topic, partition, begin_offset, next_offset), committed only.

        The index names the folders that a range overlaps; no other is opened.
        """
        named = ranges.select(*[F.col(c).alias(f"_{c}") for c in RANGE_SCHEMA.names])
        same = [F.col("topic") == F.col("_topic"), F.col("partition") == F.col("_partition")]
        rows = getattr(ranges, "_rillet_rows", None)
        overlap = [*same, F.col("begin_offset") < F.col("_next_offset"), F.col("end_offset") > F.col("_begin_offset")]
        index = join_small(self.segments(), named, overlap, "left_semi", rows)
        records = self._folders([tuple(r) for r in index.select(*TP, "seg").collect()])
        inside = [*same, F.col("offset") >= F.col("_begin_offset"), F.col("offset") < F.col("_next_offset")]
        return join_small(records, named, inside, "left_semi", rows).select(*RECORD_COLUMNS)

    @staticmethod
    def _without(df: DataFrame, ranges: DataFrame, begin: Column, end: Column) -> DataFrame:
        """The rows of ``df`` whose [begin, end) does not lie inside one of the ranges."""
        named = ranges.select(*[F.col(c).alias(f"_{c}") for c in RANGE_SCHEMA.names])
        inside = [
            F.col("topic") == F.col("_topic"),
            F.col("partition") == F.col("_partition"),
            begin >= F.col("_begin_offset"),
            end <= F.col("_next_offset"),
        ]
        return join_small(df, named, inside, "left_anti", getattr(ranges, "_rillet_rows", None))

    def _unconsumed(self, topics: list[str] | None, consumed: DataFrame) -> list[tuple[str, int, str]] | None:
        """The committed folders with records outside ``consumed``; None when they are too many to name."""
        index = self.segments()
        if topics is not None:
            index = index.where(F.col("topic").isin(list(topics)))
        left = self._without(index, consumed, F.col("begin_offset"), F.col("end_offset"))
        rows = left.select(*TP, "seg").limit(NAMED_FOLDERS + 1).collect()
        return None if len(rows) > NAMED_FOLDERS else [tuple(r) for r in rows]

    def stream_records(self, topics: list[str] | str | None = None, max_files: int | None = None) -> DataFrame:
        """Records as a streaming DataFrame, straight from the data files.

        Read-uncommitted (files of a segment whose write failed are visible), for
        plain consumption: console / memory sinks, ``observe``, stateful operators.
        Delivery flows use the committed-segment stream instead.
        """
        if isinstance(topics, str):
            topics = [topics]
        if topics and len(topics) == 1:
            # the streaming file source takes the given folder as its root: topic is not a
            # directory column there, so it comes back as a literal
            schema = T.StructType([f for f in STORED_SCHEMA.fields if f.name != "topic"])
            reader = self.spark.readStream.schema(schema)
            path = f"{self.data_path}/{self._dir('topic', topics[0])}"
        else:
            reader = self.spark.readStream.schema(STORED_SCHEMA)
            path = self.data_path
        if max_files:
            reader = reader.option("maxFilesPerTrigger", int(max_files))
        df = reader.parquet(path)
        if topics and len(topics) == 1:
            df = df.withColumn("topic", F.lit(topics[0]))
        elif topics:
            df = df.where(F.col("topic").isin(topics))
        return df.select(*RECORD_COLUMNS)

    def _commits(self, group_id: str | None, source: str | None = None) -> DataFrame:
        """Position rows that count: those of committed segments, and those that stand alone.

        A segment's positions are written before its index; until the segment is committed
        they claim output that nobody can see, so they are left out. ``source``: the root of the
        log they were consumed from; rows that name none count for every source.
        """
        schema = T.StructType([*STORED_COMMIT_SCHEMA.fields, T.StructField("seg", T.StringType(), False)])
        if not fs.exists(self.spark, self.commits_path):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self.commits_path)
        if group_id is not None:
            df = df.where(F.col("group_id") == group_id)
        if source is not None:
            df = df.where(F.coalesce(F.col("source"), F.lit(source)) == source)
        alone = F.col("seg").startswith(ALONE)
        names = self.segments().select("seg").distinct()
        counted = df.where(alone).unionByName(join_small(df.where(~alone), names, ["seg"], "left_semi").select(*df.columns))
        return counted

    def commit_log(self, group_id: str | None = None, source: str | None = None) -> DataFrame:
        """Every committed position row (one per commit batch / group), not only the latest."""
        return self._commits(group_id, source).select("group_id", *TP, "next_offset")

    def consumed(self, group_id: str, source: str, topics: list[str] | None = None) -> DataFrame:
        """What ``group_id`` has consumed of the log at root ``source``: disjoint ranges a partition.

        The ranges of one segment are merged first, with map-side combining (a copy commits one
        range for every batch of records, next to each other), then those of all segments in order.
        """
        if not fs.exists(self.spark, self.commits_path):
            return local_table(self.spark, [], RANGE_SCHEMA)
        rows = self._commits(group_id, source).select(
            *TP, F.coalesce("begin_offset", F.lit(0)).cast("long").alias("begin_offset"), "next_offset", "seg"
        )
        if topics is not None:
            rows = rows.where(F.col("topic").isin(list(topics)))
        rows = rows.where("next_offset > begin_offset")
        merged = rows.groupBy(*TP, "seg").agg(
            F.min("begin_offset").alias("begin_offset"),
            F.max("next_offset").alias("next_offset"),
            F.sum(F.col("next_offset") - F.col("begin_offset")).alias("_held"),
        )
        few = merged.limit(BROADCAST_ROWS + 1).collect()
        whole = F.col("_held") == F.col("next_offset") - F.col("begin_offset")
        if len(few) <= BROADCAST_ROWS and all(r._held == r.next_offset - r.begin_offset for r in few):
            parts = [(r.topic, r.partition, r.begin_offset, r.next_offset) for r in few]
        else:
            holes = merged.where(~whole).select(*TP, "seg")
            apart = rows.join(holes, [*TP, "seg"], "left_semi").select(*RANGE_SCHEMA.names)
            found = self._islands(merged.where(whole).select(*RANGE_SCHEMA.names).unionByName(apart))
            parts = [tuple(r) for r in found.limit(BROADCAST_ROWS + 1).collect()]
            if len(parts) > BROADCAST_ROWS:
                return found
        # frozen now, as the end offsets are: a copy into the same log must not see its own commits
        ranges: list[tuple] = []
        for topic, partition, begin, end in sorted(parts):
            if ranges and ranges[-1][:2] == (topic, partition) and begin <= ranges[-1][3]:
                begin, end = ranges[-1][2], max(end, ranges.pop()[3])
            ranges.append((topic, partition, begin, end))
        return local_table(self.spark, ranges, RANGE_SCHEMA)

    @staticmethod
    def _islands(parts: DataFrame) -> DataFrame:
        """Ranges that touch or overlap as one."""
        ordered = Window.partitionBy(*TP).orderBy("begin_offset", "next_offset")
        before = F.max("next_offset").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        starts = parts.withColumn("_new", F.coalesce(F.col("begin_offset") > before, F.lit(True)).cast("int"))
        islands = starts.withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        return islands.groupBy(*TP, "_island").agg(
            F.min("begin_offset").alias("begin_offset"), F.max("next_offset").alias("next_offset")
        ).select(*RANGE_SCHEMA.names)

    @staticmethod
    def _bounded(df: DataFrame, positions: DataFrame, within) -> DataFrame:
        """S3 for many partitions: the records of each (topic, partition) on one side of its position."""
        at = positions.groupBy(*TP).agg(F.max("next_offset").cast("long").alias("_at"))
        joined = join_small(df, at, TP, "left")
        return joined.where(F.col("_at").isNull() | within(F.col("_at"))).drop("_at")

    # ------------------------------------------------------------------ write
    def write_segment(
        self,
        records: DataFrame,
        seg: str | Column,
        commits: DataFrame | None = None,
        index: DataFrame | None = None,
        source: str | None = None,
    ) -> None:
        """Write records (with offsets) as segment ``seg`` (a name, or a Column naming several).

        Order: data, then the consumed positions (``commits``), then the index rows.
        Both tables are written with dynamic partition overwrite, so a segment
        directory appears at job commit and a rewrite of the same segment replaces
        it. The index is the commit point: output and positions become visible together.
        ``index`` gives the index rows when the caller already knows them (copies), ``source``
        the root of the log that the positions belong to.
        """
        if commits is not None and not isinstance(seg, str):
            raise ValueError("positions are committed with a single named segment")
        self._forget_snapshots(seg)
        seg_col = F.lit(seg) if isinstance(seg, str) else seg
        src = [
            (F.col(c) if c in records.columns else F.lit(None)).cast(f.dataType).alias(c)
            for c, f in zip(SOURCE_COLUMNS, STORED_SCHEMA.fields[4:7])
        ]
        data = records.withColumn("_seg", seg_col).select(*RECORD_COLUMNS, *src, F.col("_seg").alias("seg"))
        (
            data.sortWithinPartitions("topic", "partition", "seg", "offset")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("topic", "partition", "seg")
            .parquet(self.data_path)
        )
        if commits is not None:
            self.write_commits(commits, seg, source=source)
        if index is not None and isinstance(seg, str):
            index = index.select(*TP, "begin_offset", "end_offset", "n_records").withColumn("seg", F.lit(seg))
        else:
            # index from the new segment's offset column only (tiny), not by re-running the
            # write plan; a write of several segments aggregates its plan (never reads values)
            written = self._scan(None, seg) if isinstance(seg, str) else data
            index = written.groupBy(*TP, "seg").agg(
                F.min("offset").alias("begin_offset"),
                (F.max("offset") + 1).alias("end_offset"),
                F.count(F.lit(1)).alias("n_records"),
            )
        (
            index.repartition(1, "seg")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("seg")
            .parquet(self.index_path)
        )
        if commits is not None and not self.is_committed(seg):
            # nothing was written (all records dropped): the positions claim no output
            self.write_commits(commits, seg, alone=True, source=source)

    def produce(
        self,
        produced: DataFrame,
        order_by,
        seg: str | Column | None = None,
        num_partitions: int = DEFAULT_TOPIC_PARTITIONS,
        timestamp: Column | str | None = None,
    ) -> DataFrame:
        """Append produced records; the log assigns offsets in ``order_by`` order.

        ``produced`` has topic, partition (may be null), key, value and the order
        columns. An open partition goes to ``pmod(xxhash64(key or value), n)``.
        Returns the written records (the produce results), read back from the log.
        """
        if seg is None:
            seg = new_segment_id("p")
        part = F.coalesce(
            F.col("partition").cast("int"),
            F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("binary"), _as_binary(F.col("value")))), F.lit(num_partitions)).cast("int"),
        )
        if timestamp is not None:
            ts = F.col(timestamp) if isinstance(timestamp, str) else timestamp
        elif "timestamp" in produced.columns:
            ts = F.coalesce(F.col("timestamp").cast("timestamp"), F.current_timestamp())
        else:
            ts = F.current_timestamp()
        shaped = produced.withColumn("partition", part).withColumn("value", _as_binary(F.col("value")))
        shaped = shaped.withColumn("timestamp", ts.cast("timestamp"))
        with staging_area(self.spark) as staging:
            with_offsets, index = number(shaped, order_by, self.end_offsets(), staging)
            self.write_segment(with_offsets, seg, index=index)
        if isinstance(seg, str):
            return self.read(segments=[seg])
        names = [r.seg for r in produced.select(seg.alias("seg")).distinct().collect()]
        return self.read(segments=names)

    # ---------------------------------------------------------------- commits
    def write_commits(self, positions: DataFrame, seg: str, alone: bool = False, source: str | None = None) -> None:
        """Store positions (group_id, topic, partition, next_offset) under segment ``seg``.

        They count once the segment is committed, or at once when they stand ``alone``. With a
        ``begin_offset`` a row stands for the records from there on, without one for all before
        ``next_offset``. ``source``: the root of the log that was read.
        """
        given = {"begin_offset": F.lit(None).cast("long"), "source": F.lit(source).cast("string")}
        given = {c: v for c, v in given.items() if c not in positions.columns}
        (
            positions.withColumns(given).select(*STORED_COMMIT_SCHEMA.names)
            .withColumn("seg", F.lit(f"{ALONE}{seg}" if alone else seg))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("group_id", "seg")
            .parquet(self.commits_path)
        )

    def committed_positions(self, group_id: str | None = None, source: str | None = None) -> DataFrame:
        """Current position per (group, topic, partition): the highest committed next offset.

        Records before it may be unread, when a group has read selected partitions or from an
        offset on (``consumed`` has the ranges). Several sources with topics of one name are told
        apart by ``source``, the root of a log.
        """
        return self._commits(group_id, source).groupBy("group_id", *TP).agg(F.max("next_offset").alias("next_offset"))

    def last_ranges(self, group_id: str, source: str | None = None, before: DataFrame | None = None) -> DataFrame:
        """The range that ``group_id`` committed last in each partition: the one that ends furthest on.

        ``before`` (topic, partition, offset): only ranges that end at or before the offset, and
        only these partitions. One row a partition, frozen now.
        """
        rows = self._commits(group_id, source).select(*RANGE_SCHEMA.names)
        if before is not None:
            rows = join_small(rows, before.select(*TP, F.col("offset").alias("_at")), TP).where("next_offset <= _at")
        last = rows.groupBy(*TP).agg(F.max(F.struct("next_offset", "begin_offset")).alias("last"))
        found = last.select(*TP, "last.begin_offset", "last.next_offset").collect()
        return local_table(self.spark, [tuple(r) for r in found], RANGE_SCHEMA)

    def bind_flow(self, flow: str, **identity) -> None:
        """Tie a flow's name to what it reads, writes and where its progress is; raise when it is taken.

        Segments and claims are named after (flow, batch): a second flow with the same name
        would find its batches committed and drop them.
        """
        if not flow:
            raise ValueError("a flow needs a name of its own")
        record = "; ".join(f"{k}={identity[k]}" for k in sorted(identity))
        path = f"{self.root}/flows/{self._dir('flow', flow)}"
        if fs.create_new(self.spark, path, record):
            return
        known = fs.read_text(self.spark, path)
        if known != record:
            raise ValueError(f"flow {flow!r} is bound to ({known}), not to ({record})")

    def claim(self, flow: str, batch_id: int) -> bool:
        """Atomically claim (flow, batch); False when it was claimed before."""
        return fs.create_new(self.spark, f"{self.claims_path}/{flow}/{int(batch_id)}", "claimed")
