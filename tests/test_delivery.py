"""Fault injection on streaming copies: exactly-once =, at-least-once ⊇, at-most-once ⊆."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from rillet.operators.copy import replicate
from rillet.session import scratch_dir
from rillet.sources.generate import events_to_produced
from rillet.streaming.flows import await_end, backoff_delays, drain, replicate_stream, run_with_restart


@pytest.fixture(scope="module")
def weekly(spark):
    from rillet.sources.log import TopicLog

    log = TopicLog(spark, scratch_dir(spark, "test-weekly"))
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for week in range(1, 6):  # one committed segment each, in order
        log.produce(events_to_produced(ev.where(F.weekofyear("ts") == week)), ["ts", "event_id"], seg=f"w{week:02d}")
    return log


def _run(spark, src, dst, guarantee, stage):
    ckpt = scratch_dir(spark, "test-ckpt")
    fired = []

    def hook(at, batch_id):
        if at == stage and batch_id == 1 and not fired:
            fired.append(1)
            raise RuntimeError("injected")

    restarts = run_with_restart(
        lambda: replicate_stream(src, "topic1", "copy", dst, guarantee, checkpoint=ckpt, max_segments=2, hook=hook, flow="copy"),
        sleep=lambda s: None,
        delays=backoff_delays(0, 0),
    )
    assert restarts == 1
    return [(r.src_partition, r.src_offset) for r in dst.read("copy", with_source=True).collect()]


def _source(src):
    return sorted((r.partition, r.offset) for r in src.read("topic1").collect())


def test_exactly_once_equals_source(spark, weekly, new_log):
    dst = new_log("eo")
    got = _run(spark, weekly, dst, "exactly_once", "after_write")
    assert sorted(got) == _source(weekly)
    ends = {r.partition: r.end_offset for r in weekly.catalog().collect()}
    assert {r.partition: r.next_offset for r in dst.committed_positions().collect()} == ends


def test_at_least_once_superset(spark, weekly, new_log):
    got = _run(spark, weekly, new_log("alo"), "at_least_once", "after_write")
    assert set(got) == set(_source(weekly)) and len(got) > len(set(got))


def test_at_most_once_subset_without_duplicates(spark, weekly, new_log):
    got = _run(spark, weekly, new_log("amo"), "at_most_once", "after_claim")
    assert len(got) == len(set(got)) and set(got) < set(_source(weekly))


def test_batch_equals_stream(spark, weekly, new_log):
    batch = replicate(weekly, "topic1", "copy", dst=new_log("b"))
    dst = new_log("s")
    q = replicate_stream(weekly, "topic1", "copy", dst, "exactly_once", max_segments=3,
                         checkpoint=scratch_dir(spark, "test-ckpt"), flow="copy")
    q.awaitTermination()
    cols = ["topic", "partition", "offset", "key", "value", "src_offset"]
    assert sorted(map(tuple, batch.select(*cols).collect())) == sorted(map(tuple, dst.read("copy", with_source=True).select(*cols).collect()))


def test_restart_is_noop_when_drained(spark, weekly, new_log):
    dst = new_log("drain")
    ckpt = scratch_dir(spark, "test-ckpt")
    q = replicate_stream(weekly, "topic1", "copy", dst, "exactly_once", checkpoint=ckpt, flow="copy",
                         trigger={"processingTime": "1 second"})
    drain(q)
    n = dst.read("copy").count()
    q2 = replicate_stream(weekly, "topic1", "copy", dst, "exactly_once", checkpoint=ckpt, flow="copy")
    q2.awaitTermination()
    assert dst.read("copy").count() == n == weekly.read("topic1").count()


def _closed_batch_groups(log, n, seconds):
    from rillet.operators.grouped_within import grouped_within

    groups = grouped_within(log.read("topic1"), n, seconds).toPandas()
    last = groups.sort_values("first_offset").groupby("partition").tail(1)
    open_tail = last[last.n_records < n]
    all_groups = set(map(tuple, groups[["partition", "first_offset", "next_offset"]].values))
    return all_groups - set(map(tuple, open_tail[["partition", "first_offset", "next_offset"]].values))


def _all_groups(log, n, seconds):
    from rillet.operators.grouped_within import grouped_within

    return {(r.partition, r.next_offset) for r in grouped_within(log.read("topic1"), n, seconds).collect()}


def test_grouped_commits_span_micro_batches(spark, weekly, new_log):
    """Count-or-time commits over one-segment micro-batches = the groups of the batch form, the last one too."""
    dst = new_log("grouped")
    await_end(
        replicate_stream(
            weekly, "topic1", "copy", dst, "exactly_once", max_segments=1, flow="copy",
            checkpoint=scratch_dir(spark, "test-ckpt"), commit_grouping=("within", 7, 4 * 3600),
        )
    )
    assert {(r.partition, r.next_offset) for r in dst.commit_log("group1").collect()} == _all_groups(weekly, 7, 4 * 3600)


@pytest.mark.parametrize(("guarantee", "stage"), [("exactly_once", "before_write"), ("at_least_once", "after_write")])
def test_open_groups_survive_a_failure(spark, weekly, new_log, guarantee, stage):
    """A replayed batch takes up the group that was open before it, whatever it had written."""
    dst, fired = new_log("grouped-failure"), []

    def hook(at, batch_id):
        if at == stage and batch_id == 2 and not fired:
            fired.append(1)
            raise RuntimeError("injected")

    run_with_restart(
        lambda: replicate_stream(
            weekly, "topic1", "copy", dst, guarantee, max_segments=1, flow="copy", hook=hook,
            checkpoint=f"{dst.root}/ckpt", commit_grouping=("within", 7, 4 * 3600),
        ),
        sleep=lambda s: None,
    )
    assert fired
    rows = dst.commit_log("group1").collect()
    assert {(r.partition, r.next_offset) for r in rows} == _all_groups(weekly, 7, 4 * 3600)
    assert len(rows) == len(set(rows))


def test_positions_written_twice_do_not_move_the_open_group(spark, weekly, new_log):
    """Of the ranges a flow has committed, a batch takes those that end before it."""
    dst = new_log("open")
    schema = "group_id string, topic string, partition int, begin_offset long, next_offset long"
    for seg, begin, end in (("a", 3, 5), ("b", 8, 9), ("a2", 3, 5)):
        dst.write_commits(spark.createDataFrame([("f.open", "topic1", 0, begin, end)], schema), seg, alone=True, source="x")
    at = spark.createDataFrame([("topic1", 0, 5), ("topic1", 1, 0)], "topic string, partition int, offset long")
    assert [tuple(r) for r in dst.last_ranges("f.open", "x", at).collect()] == [("topic1", 0, 3, 5)]
    assert [tuple(r) for r in dst.last_ranges("f.open", "x").collect()] == [("topic1", 0, 8, 9)]
    assert dst.last_ranges("f.open", "y").count() == dst.last_ranges("other", "x").count() == 0


def test_ranges_open_only_the_folders_they_overlap(spark, weekly):
    ranges = spark.createDataFrame([("topic1", 0, 2, 5), ("topic1", 1, 4, 4), ("nowhere", 0, 0, 9)], "topic string, partition int, begin_offset long, next_offset long")
    found = weekly.read_ranges(ranges)
    assert sorted((r.partition, r.offset) for r in found.collect()) == [(0, 2), (0, 3), (0, 4)]
    assert len({f.split("/seg=")[1].split("/")[0] for f in found.inputFiles()}) <= 2


def test_drain_commits_open_groups(spark, weekly, new_log):
    dst = new_log("grouped-drain")
    drain(replicate_stream(
        weekly, "topic1", "copy", dst, flow="copy", trigger={"processingTime": "1 second"}, commit_grouping=("within", 7, 4 * 3600),
    ))
    ends = {r.partition: r.end_offset for r in weekly.catalog().collect()}
    assert {r.partition: r.next_offset for r in dst.committed_positions("group1").collect()} == ends


def test_a_flow_name_belongs_to_one_flow(spark, weekly, new_log):
    dst = new_log("names")
    replicate_stream(weekly, "topic1", "copy", dst, flow="a").awaitTermination()
    replicate_stream(weekly, "topic1", "copy", dst, flow="a").awaitTermination()  # the same flow resumes
    n = weekly.read("topic1").count()
    assert dst.read("copy").count() == n
    other = new_log("names-src")
    replicate(weekly, "topic1", "b", dst=other)
    with pytest.raises(ValueError, match="bound"):
        replicate_stream(other, "b", "copy", dst, flow="a")
    with pytest.raises(ValueError, match="bound"):
        replicate_stream(weekly, "topic1", "copy", dst, flow="a", checkpoint=scratch_dir(spark, "other"))
    with pytest.raises(ValueError, match="name"):
        replicate_stream(weekly, "topic1", "copy", dst)
    replicate_stream(other, "b", "copy", dst, flow="b").awaitTermination()
    assert dst.read("copy").count() == 2 * n


def test_positions_count_with_their_segment(spark, weekly, new_log, monkeypatch):
    """A crash after the positions and before the index leaves no position behind."""
    from rillet.sources.log import TopicLog
    from rillet.streaming.external import process_from_stored_offset

    out = new_log("crash")
    n = weekly.read("topic1").count()
    write = TopicLog.write_commits

    def crash(self, *args, **kwargs):
        write(self, *args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(TopicLog, "write_commits", crash)
    with pytest.raises(RuntimeError):
        process_from_stored_offset(weekly, "topic1", out)
    monkeypatch.undo()
    assert out.committed_positions().count() == 0 and out.read("processed").count() == 0
    process_from_stored_offset(weekly, "topic1", out)
    assert out.read("processed").count() == n


def test_positions_follow_what_was_read_not_what_the_hook_kept(spark, weekly, new_log):
    ends = {r.partition: r.end_offset for r in weekly.catalog().collect()}
    keep = lambda d: d.where(F.col("offset") < 5)
    positions = lambda log: {r.partition: r.next_offset for r in log.committed_positions().collect()}
    dst = new_log("hook")
    replicate(weekly, "topic1", "copy", dst=dst, fn=keep)
    assert positions(dst) == ends and dst.read("copy").count() == 5 * len(ends)
    stream = new_log("hook-stream")
    replicate_stream(weekly, "topic1", "copy", stream, flow="copy", fn=keep).awaitTermination()
    assert positions(stream) == ends
    nothing = new_log("hook-nothing")
    replicate(weekly, "topic1", "copy", dst=nothing, fn=lambda d: d.where("false"))
    assert positions(nothing) == ends and nothing.read("copy").count() == 0


def test_offsets_are_dense_when_a_hook_drops_and_repeats(spark, weekly, new_log):
    dst = new_log("repeat")
    fn = lambda d: d.where("offset <> 50").unionByName(d.where("offset = 10"))
    out = replicate(weekly, "topic1", "copy", dst=dst, fn=fn)
    for p in {r.partition for r in out.select("partition").distinct().collect()}:
        offsets = sorted(r.offset for r in out.where(F.col("partition") == p).collect())
        assert offsets == list(range(len(offsets)))


def test_several_positions_for_a_partition_and_nulls(spark, weekly):
    ends = {r.partition: r.end_offset for r in weekly.catalog().collect()}
    rows = [("topic1", 0, 30), ("topic1", 0, 70), ("topic1", 1, None)]
    at = spark.createDataFrame(rows, "topic string, partition int, next_offset long")
    got = {r.partition: r["n"] for r in weekly.read("topic1", from_positions=at).groupBy("partition").agg(F.count("*").alias("n")).collect()}
    assert got == {p: e - (70 if p == 0 else 0) for p, e in ends.items()}


def test_restarts_have_no_limit(spark):
    from rillet.streaming.flows import run_with_restart

    left = [25]

    class Done:
        def awaitTermination(self):
            if left[0]:
                left[0] -= 1
                raise RuntimeError("again")

    assert run_with_restart(Done, sleep=lambda s: None) == 25
    left[0] = 3
    with pytest.raises(RuntimeError):
        run_with_restart(Done, max_restarts=2, sleep=lambda s: None)
    delays = backoff_delays(1, 30, 0)
    assert [next(delays) for _ in range(2000)][-1] == 30


def test_keyed_state_grouping_in_order(spark, weekly):
    """The keyed-state form, fed in offset order, closes the same groups."""
    from rillet.streaming.stateful import grouped_within_stream

    out = grouped_within_stream(weekly.stream_records("topic1"), 7, 4 * 3600, timeout=None)
    q = out.writeStream.format("memory").queryName("rillet_groups").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.partition, r.first_offset, r.next_offset) for r in spark.table("rillet_groups").collect()}
    assert got == _closed_batch_groups(weekly, 7, 4 * 3600)


def test_keyed_state_grouping_out_of_order(spark, weekly, tmp_path):
    """Records that arrive ahead, or twice, change no group of a topic without gaps."""
    from rillet.streaming.sinks import to_files
    from rillet.streaming.stateful import grouped_within_stream

    records = weekly.read("topic1").cache()
    late = F.col("offset") % 20 >= 10
    folder = f"file://{tmp_path}"
    groups = None
    # the second tens of each twenty, then some of those again with what is missing
    for part in (records.where(late), records.where(~late | (F.col("offset") % 20 == 15))):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(records.schema).parquet(f"{folder}/in")
        groups = grouped_within_stream(stream, 7, 4 * 3600, timeout=None, dense=True)
        to_files(groups, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    got = [(r.partition, r.first_offset, r.next_offset) for r in spark.read.parquet(f"{folder}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == _closed_batch_groups(weekly, 7, 4 * 3600)


def test_fold_in_pieces_equals_fold_at_once():
    import numpy as np

    from rillet.streaming.stateful import fold

    rng = np.random.default_rng(5)
    offsets = np.cumsum(rng.integers(1, 3, 300))  # with gaps
    ts = np.cumsum(rng.integers(0, 4, 300)) - 3 * (rng.random(300) < 0.1)
    whole, open_ = fold(None, None, offsets, ts, 6, 9)
    for _ in range(20):
        cuts = np.unique(rng.integers(0, 301, 25))
        pieces, state, taken = [], None, None
        for at in np.split(np.arange(300), cuts):
            closed, state = fold(state, taken, offsets[at], ts[at], 6, 9)
            taken = int(offsets[at[-1]]) + 1 if len(at) else taken
            pieces += closed
        assert pieces == whole and state == open_


def test_file_sink_writes_each_row_once_after_a_failure(spark, weekly, tmp_path):
    """K5: a task fails after others have written; the restarted query's files hold the source, strays are unseen."""
    from pyspark.sql.functions import pandas_udf

    from rillet.streaming.sinks import to_files

    folder, flag = f"file://{tmp_path}", str(tmp_path / "failed")

    @pandas_udf("long")
    def once(offset):
        import os

        if (offset == 40).any() and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("injected")
        return offset

    def start():
        records = weekly.stream_records("topic1", max_files=6).withColumn("offset", once("offset"))
        return to_files(records, f"{folder}/out", f"{folder}/ckpt")

    with pytest.raises(Exception, match="injected"):
        start().awaitTermination()
    start().awaitTermination()
    weekly.read("topic1").limit(3).write.mode("append").parquet(f"{folder}/stray")
    stray = next((tmp_path / "stray").glob("part-*.parquet"))
    stray.rename(tmp_path / "out" / stray.name)
    got = sorted((r.partition, r.offset) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == _source(weekly)


def test_observed_metrics_and_shutdown(spark, weekly, new_log):
    """O1: records and highest offset observed per micro-batch; C1: stop keeps progress."""
    from rillet.streaming.flows import shutdown

    dst = new_log("obs")
    ckpt = scratch_dir(spark, "test-ckpt")
    q = replicate_stream(weekly, "topic1", "copy", dst, "exactly_once", checkpoint=ckpt, max_segments=2, flow="copy")
    q.awaitTermination()
    seen = [p["observedMetrics"]["consumed"] for p in q.recentProgress if p.get("observedMetrics")]
    assert sum(int(m["n_records"]) for m in seen) == weekly.read("topic1").count()
    assert max(int(m["max_offset"]) for m in seen) == max(r.end_offset for r in weekly.catalog().collect()) - 1
    q2 = replicate_stream(weekly, "topic1", "copy", dst, "exactly_once", checkpoint=ckpt, flow="copy",
                          trigger={"processingTime": "1 second"})
    shutdown(q2)
    assert not q2.isActive
    assert dst.read("copy").count() == weekly.read("topic1").count()


def test_kafka_mapping_is_guarded(spark):
    from rillet.sources import kafka

    assert kafka.available(spark) in (True, False)


def test_progress_listener_and_stream_produce(spark, weekly, new_log):
    """O2 through a listener; K1 for a streaming DataFrame via produce_stream."""
    import time

    from pyspark.sql import functions as F

    from rillet.sources.generate import table_to_produced
    from rillet.streaming.flows import produce_stream
    from rillet.streaming.listener import attach, detach

    listener = attach(spark, {"replicate-copy"})
    try:
        dst = new_log("listened")
        replicate_stream(weekly, "topic1", "copy", dst, "exactly_once", max_segments=2, flow="replicate-copy",
                         checkpoint=scratch_dir(spark, "test-ckpt")).awaitTermination()
        expected = weekly.read("topic1").count()

        def seen():
            return sum(int(r["observed"].get("consumed", {}).get("n_records", 0)) for r in listener.snapshot())

        deadline = time.time() + 20  # listener events are delivered asynchronously
        while time.time() < deadline and seen() < expected:
            time.sleep(0.2)
        assert seen() == expected
    finally:
        detach(spark, listener)

    out = new_log("produced")
    src = weekly.stream_records("topic1")
    produce_stream(
        src, out,
        lambda b: table_to_produced(b, "again", F.col("partition"), F.col("key"), F.col("value"), F.col("timestamp"), keep=["offset"]),
        ["offset"], flow="again",
    ).awaitTermination()
    got = sorted((r.partition, r.offset) for r in out.read("again").collect())
    assert got == sorted((r.partition, r.offset) for r in weekly.read("topic1").collect())


def test_keyed_state_grouping_timeouts(spark, weekly):
    """Event-time and processing-time timeouts only ever flush a group of the batch form.

    Processing-time timeouts are wall clock, and Spark keeps running no-data batches to
    check them, so that mode runs on a 1-second trigger with a 2-second window until
    every open group has been flushed, then stops.
    """
    import time

    from rillet.operators.grouped_within import grouped_within
    from rillet.streaming.stateful import grouped_within_stream

    for mode, seconds, trigger in (("event", 4 * 3600, {"availableNow": True}),
                                   ("processing", 2, {"processingTime": "1 second"})):
        every = {
            (r.partition, r.first_offset, r.next_offset)
            for r in grouped_within(weekly.read("topic1"), 7, seconds).collect()
        }
        closed = _closed_batch_groups(weekly, 7, seconds)
        name = f"rillet_groups_{mode}"
        q = (
            grouped_within_stream(weekly.stream_records("topic1"), 7, seconds, timeout=mode)
            .writeStream.format("memory").queryName(name).outputMode("append")
            .trigger(**trigger).start()
        )
        if mode == "event":
            q.awaitTermination()
        else:
            deadline = time.time() + 60
            while time.time() < deadline and spark.table(name).count() < len(every):
                time.sleep(1)
            q.stop()
        got = {(r.partition, r.first_offset, r.next_offset) for r in spark.table(name).collect()}
        assert closed <= got <= every, mode
        if mode == "processing":
            assert got == every  # every open group timed out
