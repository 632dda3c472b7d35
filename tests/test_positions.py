"""Consumed ranges and numbering in place; ordered partition flows (resume by source, of fan-out and routing: see the queries)."""

import warnings

import pytest
from pyspark.sql import functions as F

from conftest import SF, values
from rillet.functions.records import payload_int
from rillet.operators.copy import replicate
from rillet.operators.partitions import carry_topic, process_partitions
from rillet.sources.generate import events_to_produced


def _numbers(spark, log, n, partitions=1, first=0, topic="topic1"):
    rows = spark.range(first, first + n).select(
        F.lit(topic).alias("topic"), (F.col("id") % partitions).cast("int").alias("partition"),
        F.col("id").cast("string").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), "id",
    )
    log.produce(rows, ["id"])
    return log


def test_ranges_left_out_are_completed(spark, new_log):
    src, dst = _numbers(spark, new_log("s"), 100), new_log("d")
    upto = spark.createDataFrame([("topic1", 0, 50)], "topic string, partition int, next_offset long")
    replicate(src, "topic1", "x", dst=dst, to_positions=upto)
    replicate(src, "topic1", "x", dst=dst, from_offset=80)
    ranges = dst.consumed("group1", src.root).orderBy("begin_offset").collect()
    assert [(r.begin_offset, r.next_offset) for r in ranges] == [(0, 50), (80, 100)]
    replicate(src, "topic1", "x", dst=dst, commit_grouping=("batch", 7))
    assert values(dst.read("x")) == [str(i) for i in [*range(50), *range(80, 100), *range(50, 80)]]
    assert [(r.begin_offset, r.next_offset) for r in dst.consumed("group1", src.root).collect()] == [(0, 100)]
    _numbers(spark, src, 5, first=500)
    assert replicate(src, "topic1", "x", dst=dst).count() == 5


def test_a_second_target_of_a_group_warns(spark, new_log):
    src, dst = _numbers(spark, new_log("s"), 10), new_log("d")
    replicate(src, "topic1", "x", dst=dst)
    with pytest.warns(UserWarning, match="another target"):
        assert replicate(src, "topic1", "y", dst=dst).count() == 0
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message=".*another target.*")
        assert replicate(src, "topic1", "x", dst=dst).count() == 0
        assert replicate(src, "topic1", "y", dst=dst, group_id="other").count() == 10


def test_resumed_read_opens_only_new_segments(spark, new_log):
    src, dst = _numbers(spark, new_log("s"), 20), new_log("d")
    replicate(src, "topic1", "x", dst=dst)
    _numbers(spark, src, 20, first=20)
    left = src.read("topic1", consumed=dst.consumed("group1", src.root))
    assert len({f.rsplit("/", 1)[0] for f in left.inputFiles()}) == 1 and left.count() == 20


def test_copies_by_hook_and_routing_are_numbered_in_place(spark, new_log):
    """No shuffle of records: their plan has no exchange but what is broadcast to them."""
    from rillet.operators.offsets import _shuffled, assign_in_splits
    from rillet.operators.routing import explode_envelopes, route

    log = new_log("plan")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    built = assign_in_splits(events_to_produced(ev), ["ts", "event_id"])
    log.produce(events_to_produced(ev), ["ts", "event_id"])
    k = payload_int("k")
    order = ["src_topic", "src_partition", "src_offset"]
    routed = assign_in_splits(explode_envelopes(route(log.read("topic1"), k >= 80, k < 10)), [*order, "part"], None, order)
    for df, index in (built, routed):
        assert not _shuffled(df._jdf.queryExecution().executedPlan())
        counts = {(r.topic, r.partition): r.n for r in df.groupBy("topic", "partition").agg(F.count("*").alias("n")).collect()}
        assert {(r.topic, r.partition): r.n_records for r in index.collect()} == counts


def _running():
    def sums(records, carry):
        out, total = [], carry or 0
        for value in records["value"]:
            total += int(value.decode())
            out.append(str(total) if total % 2 else None)  # no record for even sums
        return out, total

    return sums  # a function of its own, so that workers need not import this module


def _expected(log):
    want = {}
    for r in log.read("topic1").orderBy("partition", "offset").collect():
        want.setdefault(r.partition, []).append(int(bytes(r.value)))
    out = []
    for p, numbers in want.items():
        total = 0
        for n in numbers:
            total += n
            if total % 2:
                out.append((p, str(total)))
    return sorted(out)


def test_ordered_flow_carries_over_slices_and_calls(spark, new_log):
    src, out = _numbers(spark, new_log("s"), 101, partitions=3), new_log("o")
    assert process_partitions(src, "topic1", _running(), out, "sums", commit_every=10, slice_records=20) == 2
    _numbers(spark, src, 20, partitions=2, first=200)
    assert process_partitions(src, "topic1", _running(), out, "sums", commit_every=10, slice_records=50) == 1
    got = sorted((r.partition, bytes(r.value).decode()) for r in out.read("sums").collect())
    assert got == _expected(src)
    ends = {r.partition: r.end_offset for r in src.catalog(["topic1"]).collect()}
    assert {r.partition: r.next_offset for r in out.committed_positions().collect()} == ends
    assert out.read(carry_topic("sums", "group1")).count() == 3 * 2 + 2


def test_ordered_flow_survives_a_lost_round(spark, new_log, monkeypatch):
    """A failure after the output is written, before it is committed: the slice is done again from its carry."""
    from rillet.sources.log import TopicLog

    src, out = _numbers(spark, new_log("s"), 60, partitions=2), new_log("o")
    process_partitions(src, "topic1", _running(), out, "sums", slice_records=20, rounds=1)
    write = TopicLog.write_commits

    def crash(self, *args, **kw):
        write(self, *args, **kw)
        raise RuntimeError("injected")

    monkeypatch.setattr(TopicLog, "write_commits", crash)
    with pytest.raises(RuntimeError):
        process_partitions(src, "topic1", _running(), out, "sums", slice_records=20, rounds=1)
    monkeypatch.setattr(TopicLog, "write_commits", write)
    process_partitions(src, "topic1", _running(), out, "sums", slice_records=20)
    assert sorted((r.partition, bytes(r.value).decode()) for r in out.read("sums").collect()) == _expected(src)


def test_jobs_of_an_ordered_flow_follow_the_records_not_the_slices(spark, new_log, monkeypatch):
    """Many short slices are one round: one segment, a carry and commits for each slice."""
    from rillet.sources.log import TopicLog

    src, out, writes = _numbers(spark, new_log("s"), 200, partitions=2), new_log("o"), []
    write = TopicLog.write_segment
    monkeypatch.setattr(TopicLog, "write_segment", lambda self, *a, **kw: (writes.append(1), write(self, *a, **kw))[1])
    assert process_partitions(src, "topic1", _running(), out, "sums", commit_every=4, slice_records=10) == 10
    assert len(writes) == 1
    assert sorted((r.partition, bytes(r.value).decode()) for r in out.read("sums").collect()) == _expected(src)
    carry = out.read(carry_topic("sums", "group1"), with_source=True).where("partition = 1").orderBy("offset").collect()
    assert [r.src_offset for r in carry] == list(range(9, 100, 10))
    commits = sorted(r.next_offset for r in out.commit_log("group1").where("partition = 0").collect())
    assert commits == sorted({e for s in range(0, 100, 10) for e in [*range(s - s % 4 + 4, s + 10, 4), s + 10]})


def test_rounds_of_an_ordered_flow_are_bounded(spark, new_log, monkeypatch):
    """Partitions of unlike length over several rounds, slices that end inside Arrow batches."""
    from rillet.operators import partitions

    monkeypatch.setattr(partitions, "ROUND", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        src, out = _numbers(spark, new_log("s"), 150, partitions=2), new_log("o")
        src = _numbers(spark, src, 20, partitions=1, first=500)
        assert process_partitions(src, "topic1", _running(), out, "sums", slice_records=10) == 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.partition, bytes(r.value).decode()) for r in out.read("sums").collect()) == _expected(src)
    assert out.read(carry_topic("sums", "group1")).count() == 10 + 8


def test_an_ordered_flow_numbers_its_output_as_it_makes_it(spark, new_log, monkeypatch):
    """Nothing is staged, counted or sorted anew to be numbered; offsets go on over rounds, calls and dropped records."""
    from rillet.operators import offsets, partitions

    def again(*args, **kw):
        raise AssertionError("records that a task made in order are numbered in a pass of their own")

    monkeypatch.setattr(partitions, "ROUND", 30)
    src, out, more = _numbers(spark, new_log("s"), 90, partitions=2), new_log("o"), new_log("more")
    src = _numbers(spark, src, 15, partitions=1, first=500)
    _numbers(spark, more, 40, partitions=3)
    with monkeypatch.context() as m:
        m.setattr(offsets, "assign_in_splits", again)
        m.setattr(offsets, "assign_offsets", again)
        process_partitions(src, "topic1", _running(), out, "sums", slice_records=10)
        process_partitions(more, "topic1", _running(), out, "sums", group_id="other", slice_records=10)
    for topic in ("sums", carry_topic("sums", "group1"), carry_topic("sums", "other")):
        held, taken = {}, {}
        for r in out.read(topic, with_source=True).orderBy("offset").collect():
            held.setdefault(r.partition, []).append(r.offset)
            taken.setdefault(r.partition, []).append((r.src_topic, r.src_partition))
        assert held == {p: list(range(len(at))) for p, at in held.items()}
        assert all(set(of) == {("topic1", p)} for p, of in taken.items())
    index = {(r.topic, r.partition): (r.begin_offset, r.end_offset, r.n_records) for r in out.catalog().collect()}
    counts = out.read().groupBy("topic", "partition").count().collect()
    assert index == {(r.topic, r.partition): (0, r["count"], r["count"]) for r in counts}
    assert sorted((r.partition, bytes(r.value).decode()) for r in out.read("sums").collect()) == sorted(_expected(src) + _expected(more))


def test_a_slice_is_a_plain_frame_whatever_its_records_hold(spark, new_log):
    """Null keys, values and times; all columns; the index counts from 0 in every slice."""
    src, out = new_log("s"), new_log("o")
    rows = [(i, None if i % 3 else f"k{i}", None if i % 4 == 1 else f"v{i}") for i in range(25)]
    df = spark.createDataFrame(rows, "n int, key string, value string").selectExpr(
        "'topic1' as topic", "cast(n % 2 as int) as partition", "key", "cast(value as binary) as value", "n",
        "case when n >= 6 then timestamp'2024-01-01 00:00:00' + make_dt_interval(0, n) end as at",
    )
    src.produce(df, ["n"], timestamp="at")

    def seen(records, carry):
        kinds = {c: str(t) for c, t in records.dtypes.items()}
        assert list(records.columns) == ["topic", "partition", "offset", "key", "value", "timestamp"]
        assert (kinds["partition"], kinds["offset"], kinds["timestamp"]) == ("int32", "int64", "datetime64[ns]")
        assert list(records.index) == list(range(len(records))) and set(records["topic"]) == {"topic1"}
        return [
            f"{r.offset} {r.key} {None if r.value is None else r.value.decode()} {r.timestamp}" for r in records.itertuples()
        ], carry

    process_partitions(src, "topic1", seen, out, "seen", slice_records=4)
    want = {
        (r.partition, r.offset, r.key, r.timestamp, f"{r.offset} {r.key} {None if r.value is None else bytes(r.value).decode()} {r.timestamp or 'NaT'}")
        for r in src.read("topic1").collect()
    }
    assert {(r.partition, r.src_offset, r.key, r.timestamp, bytes(r.value).decode()) for r in out.read("seen", with_source=True).collect()} == want


def test_payloads_of_running_sums_are_read_as_json():
    import json

    import pandas as pd

    from rillet.plans.queries import _running_sum

    odd = [b'{"k": 3}', b' {"k": 4}\n', None, b'{"k": null}', b"{}", '{"k": 5, "é": [1]}'.encode(), '{"k": 6}'.encode("utf-16"), b'\xef\xbb\xbf{"k": 7}']
    sums = [sum(json.loads(v).get("k") or 0 for v in odd[: i + 1] if v is not None) for i in range(len(odd))]
    assert _running_sum(pd.DataFrame({"value": odd}), None) == (sums, 25)
    for broken in (b'{"k": 1} 2', b'{"k": ', b""):
        with pytest.raises(ValueError):
            _running_sum(pd.DataFrame({"value": [broken]}), 1)
