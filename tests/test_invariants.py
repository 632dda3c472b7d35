"""Invariants: dense offsets under skew, chunked grouping = sequential fold, positions, backoff."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from rillet.operators.grouped_within import _last_start, _next_starts, grouped_within
from rillet.operators.offsets import assign_offsets
from rillet.sources.generate import events_to_produced
from rillet.streaming.flows import backoff_delays


def test_offsets_dense_and_ordered_on_one_hot_partition(spark):
    """Every row in one (topic, partition), cut into many range slices: offsets stay 0..n-1 in order."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    df = ev.select(F.lit("hot").alias("topic"), F.lit(0).alias("partition"), "ts", "event_id")
    out = assign_offsets(df, ["ts", "event_id"], slices=16).toPandas()
    out = out.sort_values("offset")
    assert out["offset"].tolist() == list(range(len(out)))
    expect = out.sort_values(["ts", "event_id"])["event_id"].tolist()
    assert out["event_id"].tolist() == expect


def test_offsets_continue_after_end(spark):
    df = spark.range(10).select(F.lit("t").alias("topic"), (F.col("id") % 2).cast("int").alias("partition"), "id")
    ends = spark.createDataFrame([("t", 0, 100)], "topic string, partition int, end_offset long")
    out = {(r.partition, r.id): r.offset for r in assign_offsets(df, ["id"], ends, slices=3).collect()}
    assert sorted(v for (p, _), v in out.items() if p == 0) == list(range(100, 105))
    assert sorted(v for (p, _), v in out.items() if p == 1) == list(range(0, 5))


def test_log_offsets_contiguous_across_appends(spark, new_log):
    log = new_log()
    ev = spark.read.parquet(f"{SF}/events.parquet")
    log.produce(events_to_produced(ev), ["ts", "event_id"])
    log.produce(events_to_produced(ev), ["ts", "event_id"])
    stats = log.read("topic1").groupBy("partition").agg(
        F.count("*").alias("n"), F.countDistinct("offset").alias("d"), F.max("offset").alias("mx")
    ).collect()
    for r in stats:
        assert r.n == r.d == r.mx + 1
    cat = {r.partition: r.end_offset for r in log.catalog().collect()}
    assert cat == {r.partition: r.n for r in stats}


def _fold(ts, n, d):
    """Sequential reference fold: list of group sizes."""
    groups, start, count = [], None, 0
    for t in ts:
        if start is not None and (count >= n or t >= start + d):
            groups.append(count)
            start, count = None, 0
        if start is None:
            start = t
        count += 1
    if count:
        groups.append(count)
    return groups


@settings(max_examples=60, deadline=None)
@given(
    gaps=st.lists(st.integers(min_value=0, max_value=9), min_size=1, max_size=120),
    n=st.integers(min_value=1, max_value=7),
    d=st.integers(min_value=1, max_value=25),
)
def test_exit_tables_match_sequential_fold(gaps, n, d):
    """The vectorised next-start + pointer doubling gives the same group starts as the fold."""
    ts = np.cumsum(np.asarray(gaps, dtype=np.int64))
    nxt = _next_starts(ts, n, d)
    starts, s = [], 0
    while s < len(ts):
        starts.append(s)
        s = int(nxt[s])
    sizes = [b - a for a, b in zip(starts, starts[1:] + [len(ts)])]
    assert sizes == _fold(ts.tolist(), n, d)
    last = _last_start(nxt, len(ts))
    assert last[0] == starts[-1]


def test_grouped_within_chunked_equals_fold(spark, new_log):
    """Tiny chunks (many chunk borders, non-monotone timestamps) against the sequential fold."""
    rng = np.random.default_rng(7)
    rows = []
    for p in range(3):
        t = 0.0
        for i in range(400):
            t += float(rng.choice([0.2, 0.5, 1.0, 4.0, 9.0]))
            jitter = float(rng.choice([0.0, 0.0, -3.0]))  # some records arrive late
            rows.append(("t", p, i, t + jitter))
    pdf = pd.DataFrame(rows, columns=["topic", "partition", "offset", "s"])
    df = spark.createDataFrame(pdf).select(
        "topic", F.col("partition").cast("int"), F.col("offset").cast("long"), F.timestamp_seconds("s").alias("timestamp")
    )
    for n, d, chunk in [(5, 6.0, 11), (20, 30.0, 25), (3, 2.0, 7)]:
        got = grouped_within(df, n, d, chunk_size=chunk).toPandas()
        for p in range(3):
            ts = (pdf[pdf.partition == p].sort_values("offset")["s"] * 1_000_000).round().astype("int64").tolist()
            want = _fold(ts, n, int(d * 1_000_000))
            sizes = got[got.partition == p].sort_values("first_offset")["n_records"].tolist()
            assert sizes == want, (n, d, chunk, p)


def test_backoff_delays_double_and_cap():
    gen = backoff_delays(3, 30, 0.2, rand=lambda: 0.0)
    assert [next(gen) for _ in range(6)] == [3, 6, 12, 24, 30, 30]
    top = backoff_delays(3, 30, 0.2, rand=lambda: 1.0)
    assert abs(next(top) - 3.6) < 1e-9


def test_empty_copy_writes_and_commits_nothing(spark, new_log):
    from rillet.operators.copy import produce_numbers, replicate

    src = new_log("src")
    produce_numbers(src, 5, "t")
    dst = new_log("dst")
    assert replicate(src, "t", "copy", dst=dst, fn=lambda d: d.where(F.lit(False))).count() == 0
    assert replicate(src, "missing", "copy", dst=dst).count() == 0
    assert dst.catalog().count() == 0


@settings(max_examples=8, deadline=None)
@given(
    sizes=st.lists(st.integers(min_value=0, max_value=60), min_size=1, max_size=4),
    slices=st.integers(min_value=1, max_value=9),
)
def test_offsets_match_rank_under_random_skew(spark, sizes, slices):
    """Random partition sizes (one may dominate) and slice counts: offsets = rank in order."""
    rows = [("t", p, (i * 7919) % 1000, i) for p, n in enumerate(sizes) for i in range(n)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "topic string, partition int, k long, id long")
    got = assign_offsets(df, ["k", "id"], slices=slices).toPandas()
    want = pd.DataFrame(rows, columns=["topic", "partition", "k", "id"])
    want["offset"] = want.sort_values(["k", "id"]).groupby("partition").cumcount()
    merged = got.merge(want, on=["partition", "id"], suffixes=("", "_want"))
    assert len(merged) == len(rows) and (merged["offset"] == merged["offset_want"]).all()


def test_positions_lag_fanout_and_batch_bounds(spark, new_log):
    from rillet.operators.batching import commit_batches
    from rillet.operators.copy import fan_out, replicate
    from rillet.operators.observe import consumer_lag
    from rillet.operators.routing import multi_envelope

    log = new_log("src")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    log.produce(events_to_produced(ev), ["ts", "event_id"])
    recs = log.read("topic1")

    # commits never decrease along the commit log of one partition
    batches = commit_batches(recs.select("topic", "partition", "offset"), 20).toPandas()
    for _, g in batches.sort_values("batch").groupby("partition"):
        assert g["next_offset"].is_monotonic_increasing
        assert (g["n_records"] <= 20).all()

    # 0 <= lag <= log size, for a group that stopped part-way
    dst = new_log("dst")
    replicate(log, "topic1", "copy", dst=dst, fn=lambda d: d.where(F.col("offset") < 100))
    lag = consumer_lag(log.catalog(), dst.committed_positions(), "group1").toPandas()
    assert ((lag["lag"] >= 0) & (lag["lag"] <= lag["end_offset"])).all()

    # fan-out count = sum of envelope sizes
    env = multi_envelope(recs, ["a", "b"])
    expected = env.select(F.sum(F.size("records"))).first()[0]
    assert fan_out(log, "topic1", ("a", "b"), dst=new_log("fan")).count() == expected

    # count-or-time groups never exceed n
    groups = grouped_within(recs, 7, 3600).toPandas()
    assert (groups["n_records"] <= 7).all() and groups["n_records"].sum() == recs.count()


def test_hot_partition_is_split_across_tasks(spark):
    """One partition holds ~90% of the rows: the staged range slices stay balanced."""
    from rillet.operators.offsets import staging_area

    ev = spark.read.parquet(f"{SF}/events.parquet")
    hot = ev.select(
        F.lit("t").alias("topic"),
        F.when(F.col("event_id") % 10 == 0, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("partition"),
        "ts",
        "event_id",
    )
    with staging_area(spark) as staging:
        out = assign_offsets(hot, ["ts", "event_id"], slices=8, staging=staging)
        sizes = (
            spark.read.parquet(f"{staging}/staged")
            .groupBy(F.shiftright("_rid", 33).alias("task"))
            .agg(F.count("*").alias("n"), F.countDistinct("partition").alias("parts"))
            .toPandas()
        )
        per_task_hot = (
            spark.read.parquet(f"{staging}/staged").where("partition = 0")
            .select(F.shiftright("_rid", 33).alias("task")).distinct().count()
        )
        offsets = out.where("partition = 0").select("offset").toPandas()["offset"].sort_values().tolist()
    total = int(sizes["n"].sum())
    assert per_task_hot >= 6  # the hot partition spans most tasks
    assert sizes["n"].max() <= 2 * total / len(sizes)  # no task holds much more than its share
    assert offsets == list(range(len(offsets)))


def _in_splits(spark, folder, order, target=4):
    from rillet.operators.offsets import assign_in_splits

    df = spark.read.parquet(folder).select(F.lit("t").alias("topic"), (F.col("id") % target).cast("int").alias("partition"), "id", "x")
    return df, assign_in_splits(df, order)


def test_numbering_in_splits_equals_range_slices(spark):
    """Several files, rows unordered inside a file: offsets as by the shuffle."""
    from rillet.session import scratch_dir

    folder = scratch_dir(spark, "test-splits")
    rows = spark.range(0, 5000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1000)))
    rows.repartitionByRange(6, "id").sortWithinPartitions("x").write.parquet(folder)
    for target in (4, 1):
        df, (out, index) = _in_splits(spark, folder, ["id"], target)
        want = {(r.partition, r.id): r.offset for r in assign_offsets(df, ["id"], slices=5).collect()}
        assert {(r.partition, r.id): r.offset for r in out.collect()} == want
        assert {(r.partition, r.begin_offset, r.end_offset) for r in index.collect()} == {(p, 0, 5000 // target) for p in range(target)}
    # an order that runs across the files
    assert _in_splits(spark, folder, ["x", "id"])[1] is None
    # rows out of a shuffle
    from rillet.operators.offsets import assign_in_splits

    assert assign_in_splits(df.repartition(3), ["id"]) is None


def test_numbering_in_splits_fails_when_splits_change(spark):
    import pytest

    from rillet.session import scratch_dir

    folder = scratch_dir(spark, "test-splits")
    spark.range(0, 3000).withColumn("x", F.col("id")).repartitionByRange(3, "id").write.parquet(folder)
    _, (out, _) = _in_splits(spark, folder, ["id"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        with pytest.raises(Exception, match="splits have changed"):
            out.select("*").where("offset >= 0").toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
        spark.conf.set("spark.sql.files.openCostInBytes", "4MB")


def test_exit_tables_composed_in_levels_equal_the_fold(spark, monkeypatch):
    """Three tables at a time: many levels over the chunks of one partition."""
    from rillet.operators import grouped_within as g

    monkeypatch.setattr(g, "FAN", 3)
    rng = np.random.default_rng(5)
    seconds = np.cumsum(rng.choice([0.5, 1.0, 7.0], 500))
    pdf = pd.DataFrame({"topic": "t", "partition": 0, "offset": range(500), "s": seconds})
    df = spark.createDataFrame(pdf).select(
        "topic", F.col("partition").cast("int"), F.col("offset").cast("long"), F.timestamp_seconds("s").alias("timestamp")
    )
    got = g.grouped_within(df, 5, 6.0, chunk_size=11).orderBy("first_offset").toPandas()
    assert got["n_records"].tolist() == _fold((seconds * 1e6).astype(int).tolist(), 5, 6_000_000)
