"""The literal inputs and outputs of FIXTURES.md."""

from pyspark.sql import functions as F

from conftest import values
from rillet.functions.report import envelope_result_text
from rillet.operators.batching import commit_batches, commit_positions
from rillet.operators.copy import fan_out, produce_numbers, replicate, route_conditional
from rillet.operators.grouped_within import grouped_within
from rillet.operators.observe import consumer_lag, pending_gauge
from rillet.sources.generate import number_range, table_to_produced
from rillet.streaming.external import process_from_stored_offset


def _produce_texts(spark, log, topic, texts, partition=0, key=None):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq long, text string")
    produced = table_to_produced(
        df, topic, F.lit(partition), None if key is None else F.lit(key), F.col("text"), keep=["seq"]
    )
    return log.produce(produced, ["seq"])


def test_produce_three_reports(new_log):
    out = produce_numbers(new_log(), 3, "numbers").orderBy("offset").collect()
    assert [r.report for r in out] == [
        "numbers/0 0: 1",
        "numbers/0 1: 2",
        "numbers/0 2: 3",
    ]
    assert [r.pass_through for r in out] == [1, 2, 3]


def test_produce_key_and_partition(new_log):
    log = new_log()
    produce_numbers(log, 3, "numbers")
    rows = log.read("numbers").collect()
    assert {(r.partition, r.key) for r in rows} == {(0, "key")}


def test_produce_thirty_then_replicate_in_order(new_log):
    log = new_log()
    produce_numbers(log, 30, "test")
    assert values(log.read("test")) == [str(i) for i in range(1, 31)]
    out = replicate(log, "test", "test1")
    rows = out.orderBy("offset").collect()
    assert [bytes(r.value).decode() for r in rows] == [str(i) for i in range(1, 31)]
    assert all(r.key is None for r in rows)
    assert [r.offset for r in rows] == list(range(30))


def test_console_text_keeps_duplicates(spark, new_log):
    log = new_log()
    _produce_texts(spark, log, "t", ["a", "a", "un mensaje", "otro mensaje"])
    assert values(log.read("t")) == ["a", "a", "un mensaje", "otro mensaje"]


def test_plain_sink_hundred_no_key(spark, new_log):
    log = new_log()
    produced = table_to_produced(
        number_range(spark, 100), "topic1", None, None, F.col("number").cast("string"), keep=["number"]
    )
    out = log.produce(produced, ["number"])
    rows = out.orderBy("offset").collect()
    assert len(rows) == 100 and all(r.key is None for r in rows)
    assert [bytes(r.value).decode() for r in rows] == [str(i) for i in range(1, 101)]


def test_two_topics_into_one_keep_keys(spark, new_log):
    log = new_log()
    _produce_texts(spark, log, "topic1", ["x1", "x2"], key="k1")
    _produce_texts(spark, log, "topic2", ["y1"], key="k2")
    out = replicate(log, ["topic1", "topic2"], "targetTopic", keep_key=True).orderBy("offset").collect()
    assert [(r.key, bytes(r.value).decode()) for r in out] == [("k1", "x1"), ("k1", "x2"), ("k2", "y1")]


def test_seek_and_assigned_partitions(spark, new_log):
    log = new_log()
    for p in range(4):
        _produce_texts(spark, log, "topic1", [f"p{p}-{i}" for i in range(10)], partition=p)
    seek = log.read("topic1", partitions=[0], from_offset=7).orderBy("offset").collect()
    assert [r.offset for r in seek] == [7, 8, 9]
    assigned = log.read("topic1", partitions=[1, 2]).collect()
    assert {r.partition for r in assigned} == {1, 2} and len(assigned) == 20


def test_fan_out_two_records_per_input_one_commit_each(spark, new_log):
    log = new_log()
    _produce_texts(spark, log, "topic1", ["a", "b", "c"], key="k")
    dst = new_log("dst")
    out = fan_out(log, "topic1", dst=dst).collect()
    assert sorted((r.topic, bytes(r.value).decode()) for r in out) == [
        ("topic2", "a"), ("topic2", "b"), ("topic2", "c"),
        ("topic3", "a"), ("topic3", "b"), ("topic3", "c"),
    ]
    assert all(r.key is None for r in out)
    assert dst.committed_positions().collect()[0].next_offset == 3


def test_conditional_routing_counts_and_commits(spark, new_log):
    log = new_log()
    _produce_texts(spark, log, "topic1", ["duplicate", "ignore", "other"])
    dst = new_log("dst")
    v = F.col("value").cast("string")
    written, envelopes = route_conditional(log, "topic1", v == "duplicate", v == "ignore", dst=dst)
    per_src = {r.src_offset: r.n for r in written.groupBy("src_offset").agg(F.count("*").alias("n")).collect()}
    assert per_src == {0: 2, 2: 1}
    assert [r.next_offset for r in commit_positions(envelopes.select("pass_through.*")).collect()] == [3]
    assert dst.committed_positions().collect()[0].next_offset == 3


def test_conditional_as_coded_both_true(spark, new_log):
    log = new_log()
    _produce_texts(spark, log, "topic1", ["a", "b"])
    written, _ = route_conditional(log, "topic1", F.lit(True), F.lit(True), dst=new_log("dst"))
    assert written.count() == 4


def test_result_texts(spark):
    parts = "array<struct<topic:string,partition:int,offset:bigint,value:string>>"
    df = spark.createDataFrame(
        [([("topic2", 0, 5, "v"), ("topic3", 0, 9, "v")],), ([],)], f"parts {parts}"
    )
    texts = [r.t for r in df.select(envelope_result_text("parts").alias("t")).collect()]
    assert texts == ["topic2/0 5: v, topic3/0 9: v", "passed through"]


def test_commit_batches_of_twenty(spark):
    df = spark.range(45).selectExpr("'t' as topic", "0 as partition", "id as offset")
    out = commit_batches(df, 20, "group1").orderBy("batch").collect()
    assert [r.next_offset for r in out] == [20, 40, 45]


def _timed(spark, seconds):
    rows = [("t", 0, i, float(s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "topic string, partition int, offset long, s double").select(
        "topic", "partition", "offset", F.timestamp_seconds("s").alias("timestamp")
    )


def test_count_or_time_time_wins(spark):
    out = grouped_within(_timed(spark, [0, 1, 6, 7]), 20, 5).orderBy("first_offset").collect()
    assert [(r.first_offset, r.next_offset) for r in out] == [(0, 2), (2, 4)]


def test_count_or_time_count_wins(spark):
    out = grouped_within(_timed(spark, [i / 25 for i in range(25)]), 20, 5).orderBy("first_offset").collect()
    assert [(r.n_records, r.next_offset) for r in out] == [(20, 20), (5, 25)]


def test_external_offset_inclusive_reads_last_again(spark, new_log):
    log = new_log()
    _produce_texts(spark, log, "topic1", [str(i) for i in range(15)])
    out = new_log("out")
    process_from_stored_offset(log, "topic1", out, until=F.col("offset") <= 9, inclusive=True)
    process_from_stored_offset(log, "topic1", out, inclusive=True)
    src_offsets = sorted(r.src_offset for r in out.read("processed", with_source=True).collect())
    assert src_offsets.count(9) == 2 and len(src_offsets) == 16


def test_external_offset_next_position(spark, new_log):
    log = new_log()
    _produce_texts(spark, log, "topic1", [str(i) for i in range(15)])
    out = new_log("out")
    process_from_stored_offset(log, "topic1", out, until=F.col("offset") <= 9)
    process_from_stored_offset(log, "topic1", out)
    src_offsets = sorted(r.src_offset for r in out.read("processed", with_source=True).collect())
    assert src_offsets == list(range(15))


def test_pending_gauge_text(spark):
    catalog = spark.createDataFrame([("t", 0, 0, 30, 30)], "topic string, partition int, begin_offset long, end_offset long, n_records long")
    positions = spark.createDataFrame([("g", "t", 0, 12)], "group_id string, topic string, partition int, next_offset long")
    text = pending_gauge(consumer_lag(catalog, positions, "g")).first().text
    assert text.splitlines() == [
        "# HELP messages Number of messages in the queueService",
        "# TYPE messages gauge",
        "messages 18",
    ]


def test_record_function_as_pandas_udf(spark, new_log):
    """P13 on the vectorised path: a pandas_udf over (key, value) runs on Arrow batches."""
    import pandas as pd

    from rillet.functions.records import apply_record_fn

    @F.pandas_udf("string")
    def describe(key: pd.Series, value: pd.Series) -> pd.Series:
        return key.fillna("-") + ":" + value.map(lambda b: bytes(b).decode()).str.upper()

    log = new_log()
    _produce_texts(spark, log, "t", ["a", "un mensaje"], key="k")
    out = apply_record_fn(log.read("t"), describe).orderBy("offset").collect()
    assert [r.result for r in out] == ["k:A", "k:UN MENSAJE"]
    default = apply_record_fn(log.read("t")).orderBy("offset").collect()
    assert [r.result for r in default] == ["a", "un mensaje"]
