"""Snapshots of the segment index: the same catalog and records from few files."""

from pyspark.sql import functions as F

from rillet.model import TP


def _old_log(spark, log, n):
    """An index of n segments of two partitions, ten records each."""
    rows = spark.range(2 * n).select(
        F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("partition"),
        (F.floor(F.col("id") / 2) * 10).cast("long").alias("begin_offset"),
        (F.floor(F.col("id") / 2) * 10 + 10).cast("long").alias("end_offset"),
        F.lit(10).cast("long").alias("n_records"), F.format_string("s%05d", F.floor(F.col("id") / 2)).alias("seg"),
    )
    rows.coalesce(4).write.mode("append").partitionBy("seg").parquet(log.index_path)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _produce(spark, log, seg, n=3):
    rows = spark.range(n).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit("k").alias("key"), F.lit("v").alias("value"), "id")
    log.produce(rows, ["id"], seg=seg)


def test_end_offsets_open_few_files_however_old_the_log(spark, new_log):
    log = new_log("old")
    _old_log(spark, log, 2000)
    want, index = _rows(log.catalog()), _rows(log.segments())
    assert len(index) == 4000 and len(log.catalog().inputFiles()) >= 2000
    log.compact()
    assert _rows(log.catalog()) == want and _rows(log.segments()) == index
    assert len(log.catalog().inputFiles()) <= 2
    _produce(spark, log, "new")
    assert len(log.catalog().inputFiles()) <= 3
    ends = {(r.partition, r.end_offset) for r in log.end_offsets(["t"]).collect()}
    assert ends == {(0, 20003), (1, 20000)}
    assert log.read("t").count() == 3


def test_compaction_again_and_a_snapshot_without_its_marker(spark, new_log):
    log = new_log("again")
    for i in range(4):
        _produce(spark, log, f"s{i}")
        if i != 2:
            log.compact()
    assert log._snapshots() == ["n=000000000002", "n=000000000003"]
    want = _rows(log.catalog())
    assert want == [("t", 0, 0, 12, 12)] and log.read("t").count() == 12
    # a compaction that failed part-way is not seen
    spark.range(1).write.parquet(f"{log.snapshots_path}/n=000000000004/index")
    assert _rows(log.catalog()) == want and log.segments().count() == 4
    log.compact()
    assert _rows(log.catalog()) == want


def test_a_covered_segment_written_again(spark, new_log):
    log = new_log("rewritten")
    _produce(spark, log, "a")
    log.compact()
    other = spark.createDataFrame([("t", 0, 0, "k", bytearray(b"w"), None)], "topic string, partition int, offset long, key string, value binary, timestamp timestamp")
    log.write_segment(other, "a")
    assert _rows(log.catalog()) == [("t", 0, 0, 1, 1)] and _rows(log.segments().select(*TP, "seg")) == [("t", 0, "a")]


def test_no_log_and_odd_names(spark, new_log):
    log = new_log("empty")
    log.compact()
    assert log.catalog().count() == 0 and log.segments().count() == 0
    _produce(spark, log, "a=b/c %")
    log.compact()
    _produce(spark, log, "d")
    assert _rows(log.catalog()) == [("t", 0, 0, 6, 6)] and log.read("t").count() == 6
