"""Registered queries: each reads the driver tables (``events``, ``conversations``)
under ``sf_dir``, runs one operator family of the library over the whole table
and returns a DataFrame whose columns match the oracle SQL in ``oracles.py``.

Topic logs built from the tables live in fresh folders under the shared
checkpoint folder. A log built once per (application, table, layout) is reused
read-only by the queries that only consume it; queries that write use a log of
their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.functions.records import apply_record_fn, payload_int
from rillet.functions.report import envelope_result_text
from rillet.model import DEFAULT_GROUP
from rillet.operators.batching import commit_batches, commit_positions
from rillet.operators.copy import fan_out, produce_numbers, replicate, route_conditional
from rillet.operators.grouped_within import grouped_within
from rillet.operators.observe import consumer_lag, consumer_metrics, pending_gauge, producer_metrics
from rillet.operators.partitions import process_partitions
from rillet.operators.routing import multi_envelope, route, single_envelope
from rillet.session import configure, scratch_dir
from rillet.sources.csv_ingest import TIMESTAMP, ingest_csv
from rillet.sources.csv_records import read_csv
from rillet.sources.generate import events_to_produced, table_to_produced
from rillet.sources import fs
from rillet.sources.log import TopicLog
from rillet.streaming.external import process_from_stored_offset, stop_positions
from rillet.streaming.flows import await_end, envelope_stream, replicate_stream
from rillet.streaming.sinks import to_files
from rillet.streaming.stateful import grouped_within_stream

RESULT_PARTS = "array<struct<topic:string,partition:int,offset:bigint,value:string>>"

# Fixed query parameters.
PARTITIONS = 4
SEEK_PARTITION = 0
SEEK_FROM = 1000
ASSIGNED = [1, 2]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
DUPLICATE_TOPICS = ("topic2", "topic3")
DUPLICATE_MIN_K = 80  # payload k >= 80 -> both topics
IGNORE_MAX_K = 10  # payload k < 10 -> nothing produced
LAG_CUTOFF = "2024-01-15 00:00:00"
GROUP_N = 20
GROUP_HOURS = 5
ORDERED_SLICE = 1000  # several slices for each partition from sf0.01 on
GROUP_CHUNK = 500  # several chunks for each partition at every size

_LOGS: dict[tuple, TopicLog] = {}
_SCAN = json.JSONDecoder().scan_once


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _build(spark: SparkSession, sf_dir: str, layout: str) -> TopicLog:
    log = TopicLog(spark, scratch_dir(spark, f"log-{layout}"))
    if layout == "topic1":
        log.produce(events_to_produced(_table(spark, sf_dir, "events")), ["ts", "event_id"])
    elif layout == "by_type":
        ev = _table(spark, sf_dir, "events")
        log.produce(events_to_produced(ev, F.col("event_type"), PARTITIONS), ["ts", "event_id"])
    elif layout == "by_role":
        conv = _table(spark, sf_dir, "conversations")
        produced = table_to_produced(
            conv,
            F.col("role"),
            F.pmod(F.col("conv_id"), F.lit(PARTITIONS)),
            F.col("conv_id").cast("string"),
            F.col("text"),
            None,
            keep=["conv_id", "turn"],
        )
        log.produce(produced, ["conv_id", "turn"])
    else:
        raise ValueError(layout)
    return log


def base_log(spark: SparkSession, sf_dir: str, layout: str = "topic1") -> TopicLog:
    """Read-only topic log built from a driver table (built once per application)."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), layout)
    cached = _LOGS.get(key)
    if cached is None or not fs.exists(spark, cached.index_path):
        _LOGS[key] = _build(spark, sf_dir, layout)
    return _LOGS[key]


def _fresh(spark: SparkSession, label: str) -> TopicLog:
    return TopicLog(spark, scratch_dir(spark, label))


def _records(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "topic", "partition", "offset", "key", F.col("value").cast("string").alias("value"), *extra
    )


# ----------------------------------------------------------------- queries
def q_topic_from_events(spark, sf_dir):
    """Events -> topic1 (partition = user_id % 4), offsets by (ts, event_id)."""
    return _records(base_log(spark, sf_dir).read("topic1"))


def q_produce_report(spark, sf_dir):
    """Produce the events' numbers to a topic and report each write."""
    numbers = _table(spark, sf_dir, "events").select(F.col("event_id").alias("number"))
    return produce_numbers(_fresh(spark, "produce"), numbers, "numbers")


def q_plain_sink_events(spark, sf_dir):
    """K1 / P5: event payloads to topic1 with no key and no partition (1 partition)."""
    ev = _table(spark, sf_dir, "events")
    produced = table_to_produced(ev, "topic1", None, None, F.col("props"), F.col("ts"), keep=["event_id"])
    return _records(_fresh(spark, "plain").produce(produced, ["event_id"]))


def q_replicate_drop_key(spark, sf_dir):
    """topic1 -> test1, key dropped, partition kept."""
    out = replicate(base_log(spark, sf_dir), "topic1", "test1", dst=_fresh(spark, "copy"))
    return _records(out, "src_offset")


def q_replicate_keep_key(spark, sf_dir):
    """All event topics -> targetTopic, keys kept."""
    src = base_log(spark, sf_dir, "by_type")
    out = replicate(src, EVENT_TYPES, "targetTopic", dst=_fresh(spark, "copy"), keep_key=True)
    return _records(out, "src_topic", "src_offset")


def q_seek_offset(spark, sf_dir):
    """S3: one partition of topic1 from a stored offset on."""
    log = base_log(spark, sf_dir)
    return _records(log.read("topic1", partitions=[SEEK_PARTITION], from_offset=SEEK_FROM))


def q_assign_partitions(spark, sf_dir):
    """Explicit partitions of topic1, read as one single-partition read each."""
    log = base_log(spark, sf_dir)
    reads = [log.read("topic1", partitions=[p]) for p in ASSIGNED]
    out = reads[0]
    for r in reads[1:]:
        out = out.unionByName(r)
    return _records(out)


def _cutoff(log: TopicLog) -> DataFrame:
    """Where a consumer of topic1 stops that takes the records before the cutoff."""
    return stop_positions(log.read("topic1"), F.col("timestamp") < F.lit(LAG_CUTOFF))


def q_seek_stored_positions(spark, sf_dir):
    """S3 over every partition: each resumes from the position its group stored.

    The group stopped part-way (records before the cutoff were consumed); a restart reads
    the rest of every partition of topic1.
    """
    log = base_log(spark, sf_dir)
    dst = _fresh(spark, "positions")
    replicate(log, "topic1", "test1", dst=dst, to_positions=_cutoff(log))
    stored = dst.committed_positions(DEFAULT_GROUP)
    return _records(log.read("topic1", from_positions=stored))


def q_assign_all_partitions(spark, sf_dir):
    """S4 / S5 over the whole topic: one single-partition read per partition, merged."""
    log = base_log(spark, sf_dir)
    parts = [r.partition for r in log.catalog(["topic1"]).select("partition").collect()]
    reads = [log.read("topic1", partitions=[p]) for p in sorted(parts)]
    out = reads[0]
    for r in reads[1:]:
        out = out.unionByName(r)
    return _records(out)


def q_topic_catalog(spark, sf_dir):
    """(topic, partition, begin, end, count) over a five-topic log."""
    return base_log(spark, sf_dir, "by_type").catalog()


def q_fanout_two_topics(spark, sf_dir):
    """Every topic1 record to topic2 and topic3, keys dropped."""
    out = fan_out(base_log(spark, sf_dir), "topic1", dst=_fresh(spark, "fanout"))
    return _records(out, "src_offset")


def _route(spark, sf_dir):
    k = payload_int("k")
    return route_conditional(
        base_log(spark, sf_dir),
        "topic1",
        duplicate=k >= DUPLICATE_MIN_K,
        ignore=k < IGNORE_MAX_K,
        dst=_fresh(spark, "route"),
    )


def q_route_conditional(spark, sf_dir):
    """Duplicate -> topic2 + topic3; ignore -> nothing; else -> topic2."""
    written, _ = _route(spark, sf_dir)
    return _records(written, "src_offset")


def q_route_commits(spark, sf_dir):
    """Positions after routing include the ignored records."""
    written, envelopes = _route(spark, sf_dir)
    return commit_positions(envelopes.select("pass_through.*"))


def q_multi_result_report(spark, sf_dir):
    """One result text per consumed record: parts joined by ', ' or 'passed through'."""
    written, envelopes = _route(spark, sf_dir)
    # parts in the order of the topics they went to
    place = F.array_position(F.array(*[F.lit(t) for t in DUPLICATE_TOPICS]), F.col("topic"))
    parts = written.groupBy("src_topic", "src_partition", "src_offset").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    place.alias("place"),
                    F.col("topic"),
                    F.col("partition"),
                    F.col("offset"),
                    F.col("value").cast("string").alias("value"),
                )
            )
        ).alias("parts")
    )
    listed = F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in ("topic", "partition", "offset", "value")]))
    produced = parts.select("src_partition", "src_offset", listed.alias("parts")).select(
        "src_partition", "src_offset", envelope_result_text("parts").alias("report")
    )
    passed = envelopes.where(F.size("records") == 0).select(
        F.col("pass_through.partition").alias("src_partition"),
        F.col("pass_through.offset").alias("src_offset"),
        envelope_result_text(F.array().cast(RESULT_PARTS)).alias("report"),
    )
    return produced.unionByName(passed)


def q_commit_batches_20(spark, sf_dir):
    """Commits batched by 20 consumed positions per partition."""
    consumed = base_log(spark, sf_dir).read("topic1").select("topic", "partition", "offset")
    return commit_batches(consumed, 20, DEFAULT_GROUP)


def q_commit_batches_100(spark, sf_dir):
    """Commits batched by 100 over merged partitions."""
    consumed = base_log(spark, sf_dir).read("topic1").select("topic", "partition", "offset")
    return commit_batches(consumed, 100, DEFAULT_GROUP)


def q_grouped_within(spark, sf_dir):
    """Groups closed at 20 records or 5 hours of event time, per partition."""
    recs = base_log(spark, sf_dir).read("topic1")
    return grouped_within(recs, GROUP_N, GROUP_HOURS * 3600, chunk_size=GROUP_CHUNK)


def _lag(spark, sf_dir):
    log = base_log(spark, sf_dir)
    dst = _fresh(spark, "lag")
    replicate(log, "topic1", "test1", dst=dst, to_positions=_cutoff(log))
    return consumer_lag(log.catalog(["topic1"]), dst.committed_positions(DEFAULT_GROUP), DEFAULT_GROUP)


def q_consumer_lag(spark, sf_dir):
    """O3: end offset - committed position for a group that stopped part-way."""
    return _lag(spark, sf_dir)


def q_pending_gauge(spark, sf_dir):
    """O3: the pending-messages gauge as exposition text."""
    return pending_gauge(_lag(spark, sf_dir))


def q_producer_metrics(spark, sf_dir):
    """O2: records and payload bytes per (topic, partition) of the five-topic log."""
    return producer_metrics(base_log(spark, sf_dir, "by_type").read())


def q_consumer_metrics(spark, sf_dir):
    """O1: what a consumer of topic1 saw, per partition."""
    return consumer_metrics(base_log(spark, sf_dir).read("topic1"))


def q_conversation_copy(spark, sf_dir):
    """Long multilingual payloads: all role topics -> one topic, byte-identical, keys kept."""
    src = base_log(spark, sf_dir, "by_role")
    roles = sorted(r.topic for r in src.catalog().select("topic").distinct().collect())
    out = replicate(src, roles, "dialogue", dst=_fresh(spark, "dialogue"), keep_key=True)
    return _records(out, "src_topic", "src_offset")


def q_chain_hops(spark, sf_dir):
    """R2: topic1 -> hopB -> hopC, one replicate per hop, each with its own positions."""
    log = base_log(spark, sf_dir)
    b = _fresh(spark, "hop-b")
    replicate(log, "topic1", "hopB", dst=b)
    c = _fresh(spark, "hop-c")
    out = replicate(b, "hopB", "hopC", dst=c)
    return _records(out, "src_topic", "src_offset")


# ------------------------------------------------------------- streaming
def _flow(label: str) -> str:
    """A flow name of its own per query call (stable across its runs, unique per call)."""
    return f"{label}-{uuid.uuid4().hex[:8]}"


def _arriving(spark, sf_dir):
    """topic1 as it grows: yields the log after the records before the cutoff, and after the rest."""
    log = _fresh(spark, "arriving")
    for part in _two_parts(spark, sf_dir):
        log.produce(part, ["ts", "event_id"])
        yield log


def _two_parts(spark, sf_dir):
    """The events before the cutoff, and all others (also those without a time), as records of topic1."""
    events = _table(spark, sf_dir, "events")
    early = F.coalesce(F.col("ts") < F.lit(LAG_CUTOFF), F.lit(False))
    return [events_to_produced(events.where(part)) for part in (early, ~early)]


def _stream_copy(spark, sf_dir, guarantee: str):
    """One flow, run twice: over what is there, then over what has come since."""
    dst, flow = _fresh(spark, f"stream-{guarantee}"), _flow(f"copy-{guarantee}")
    for src in _arriving(spark, sf_dir):
        await_end(replicate_stream(src, "topic1", "test1", dst, guarantee, flow=flow))
    return _records(dst.read("test1", with_source=True), "src_offset")


def q_stream_exactly_once(spark, sf_dir):
    """Exactly-once copy, resumed after new records arrive."""
    return _stream_copy(spark, sf_dir, "exactly_once")


def q_stream_at_least_once(spark, sf_dir):
    """At-least-once copy (output, then positions), resumed after new records arrive."""
    return _stream_copy(spark, sf_dir, "at_least_once")


def q_stream_at_most_once(spark, sf_dir):
    """At-most-once copy (claim and positions, then output), resumed after new records arrive."""
    return _stream_copy(spark, sf_dir, "at_most_once")


def q_stream_two_sources(spark, sf_dir):
    """A flow from each event topic into one topic, each with a name of its own."""
    src, dst = base_log(spark, sf_dir, "by_type"), _fresh(spark, "stream-merged")
    for topic in EVENT_TYPES:
        await_end(replicate_stream(src, topic, "targetTopic", dst, "exactly_once", keep_key=True, flow=_flow(topic)))
    return dst.read("targetTopic", with_source=True).select(
        "topic", "partition", "key", F.col("value").cast("string").alias("value"), "src_topic", "src_offset"
    )


def q_stream_batched_commits(spark, sf_dir):
    """T3 / G2 as a stream: at-least-once, one commit for each 20 positions; the commit log."""
    dst = _fresh(spark, "stream-batched")
    src = base_log(spark, sf_dir)
    await_end(
        replicate_stream(src, "topic1", "test1", dst, "at_least_once", commit_grouping=("batch", 20), flow=_flow("batched"))
    )
    return dst.commit_log(DEFAULT_GROUP)


def q_stream_route(spark, sf_dir):
    """F5 as an exactly-once stream: records routed by predicates, positions from every envelope."""
    k = payload_int("k")
    dst = _fresh(spark, "stream-route")
    envelopes = lambda d: route(d, k >= DUPLICATE_MIN_K, k < IGNORE_MAX_K, DUPLICATE_TOPICS, "topic2", False, DEFAULT_GROUP)
    envelope_stream(base_log(spark, sf_dir), "topic1", envelopes, dst, "exactly_once", flow=_flow("route"), targets=list(DUPLICATE_TOPICS)).awaitTermination()
    return _records(dst.read(list(DUPLICATE_TOPICS), with_source=True), "src_offset")


def q_replicate_hook(spark, sf_dir):
    """A hook that drops every tenth record and repeats every seventh; offsets stay dense."""
    dst = _fresh(spark, "copy-hook")

    def hook(d: DataFrame) -> DataFrame:
        times = F.when(F.col("offset") % 10 == 5, 0).when(F.col("offset") % 7 == 3, 2).otherwise(1)
        return d.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).drop("_copy")

    replicate(base_log(spark, sf_dir), "topic1", "test1", dst=dst, fn=hook)
    return _records(dst.read("test1", with_source=True), "src_offset")


def q_replicate_resume(spark, sf_dir):
    """A group's second call copies what has come since the first."""
    dst = _fresh(spark, "copy-resume")
    for src in _arriving(spark, sf_dir):
        replicate(src, "topic1", "test1", dst=dst)
    return _records(dst.read("test1", with_source=True), "src_offset")


def q_stream_fanout(spark, sf_dir):
    """F4 as an exactly-once stream: topic1 -> topic2 + topic3, positions from every envelope."""
    dst, flow = _fresh(spark, "stream-fanout"), _flow("fanout")
    for src in _arriving(spark, sf_dir):
        envelope_stream(
            src, "topic1", lambda d: multi_envelope(d, ["topic2", "topic3"]), dst, "exactly_once", flow=flow
        ).awaitTermination()
    return _records(dst.read(["topic2", "topic3"], with_source=True), "src_offset")


def _external(spark, sf_dir, inclusive: bool):
    src = base_log(spark, sf_dir)
    out = _fresh(spark, "external")
    stop = F.col("timestamp") < F.lit(LAG_CUTOFF)
    process_from_stored_offset(src, "topic1", out, until=stop, inclusive=inclusive)
    process_from_stored_offset(src, "topic1", out, inclusive=inclusive)
    return _records(out.read("processed", with_source=True), "src_offset")


def q_external_offsets(spark, sf_dir):
    """T4 / S3: two runs, the second from the position stored with the first run's output."""
    return _external(spark, sf_dir, inclusive=False)


def q_external_offsets_inclusive(spark, sf_dir):
    """T4 as coded (Q4): the stored offset is the last processed one and is read again."""
    return _external(spark, sf_dir, inclusive=True)


CSV_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
CSV_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def q_csv_to_json_topic(spark, sf_dir):
    """Events written as CSV files, ingested as a stream into JSON records on a topic."""
    folder = scratch_dir(spark, "csv-in")
    written = {"header": True, "escape": '"', "timestampFormat": TIMESTAMP, "timestampNTZFormat": TIMESTAMP}
    _table(spark, sf_dir, "events").write.options(**written).csv(folder)
    log = _fresh(spark, "csv-topic")
    q = ingest_csv(
        log, folder, CSV_SCHEMA, "csv_events", CSV_COLUMNS, ["event_id"],
        key=F.col("user_id").cast("string"), partition=F.pmod(F.col("user_id"), F.lit(PARTITIONS)),
        timestamp=F.col("ts"), trigger={"availableNow": True}, flow=_flow("csv-ingest"),
    )
    q.awaitTermination()
    return _records(log.read("csv_events"))


def q_csv_multiline_documents(spark, sf_dir):
    """Documents, whose texts hold line breaks and quotes, written as CSV and framed by many tasks."""
    folder = scratch_dir(spark, "csv-docs")
    spaces = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.options(header=True, escape='"', **spaces).csv(folder)
    rows = read_csv(spark, folder, "doc_id long, text string, lang string, source string, n_chars long", **spaces)
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


def q_replicate_batched_commits(spark, sf_dir):
    """Copy with one commit per batch of 20 positions; the full commit log."""
    dst = _fresh(spark, "copy-batched")
    replicate(base_log(spark, sf_dir), "topic1", "test1", dst=dst, commit_grouping=("batch", 20))
    return dst.commit_log(DEFAULT_GROUP)


def q_replicate_grouped_commits(spark, sf_dir):
    """Copy with one commit per count-or-time group (20 records / 5 hours)."""
    dst = _fresh(spark, "copy-grouped")
    replicate(
        base_log(spark, sf_dir), "topic1", "test1", dst=dst,
        commit_grouping=("within", GROUP_N, GROUP_HOURS * 3600),
    )
    return dst.commit_log(DEFAULT_GROUP)


def q_chain_exactly_once(spark, sf_dir):
    """Two exactly-once hops as streams (topic1 -> hopB -> hopC), both resumed after new records.

    Exactly-once per hop; the two hops are separate transactions.
    """
    b, c = _fresh(spark, "tx-hop-b"), _fresh(spark, "tx-hop-c")
    hop_b, hop_c = _flow("hop-b"), _flow("hop-c")
    for src in _arriving(spark, sf_dir):
        await_end(replicate_stream(src, "topic1", "hopB", b, "exactly_once", flow=hop_b))
        await_end(replicate_stream(b, "hopB", "hopC", c, "exactly_once", flow=hop_c))
    return _records(c.read("hopC", with_source=True), "src_topic", "src_offset")


def q_business_results(spark, sf_dir):
    """A per-record function of (key, value), as a Column expression."""
    recs = base_log(spark, sf_dir).read("topic1")
    out = apply_record_fn(recs, lambda key, value: F.concat(key, F.lit("="), value.cast("string")))
    return out.select("topic", "partition", "offset", "result")


def q_replicate_two_logs(spark, sf_dir):
    """Two source logs with one topic name, one group, one target; each keeps its own positions."""
    dst = _fresh(spark, "copy-two-logs")
    sources = []
    for part in _two_parts(spark, sf_dir):
        log = _fresh(spark, "one-of-two")
        log.produce(part, ["ts", "event_id"])
        sources.append(log)
    for log in sources + sources:  # the second time nothing is left
        replicate(log, "topic1", "test1", dst=dst)
    return _records(dst.read("test1", with_source=True), "src_offset")


def q_replicate_completed(spark, sf_dir):
    """A group reads two partitions, then the start of all, then what is left of the topic."""
    log, dst = base_log(spark, sf_dir), _fresh(spark, "copy-completed")
    replicate(log, "topic1", "test1", dst=dst, partitions=ASSIGNED)
    replicate(log, "topic1", "test1", dst=dst, to_positions=_cutoff(log))
    replicate(log, "topic1", "test1", dst=dst)
    return _records(dst.read("test1", with_source=True), "src_offset")


def q_fanout_resume(spark, sf_dir):
    """Fan-out called as the topic grows, and once more; every record goes out once."""
    dst = _fresh(spark, "fanout-resume")
    for log in _arriving(spark, sf_dir):
        fan_out(log, "topic1", dst=dst)
        fan_out(log, "topic1", dst=dst)
    return _records(dst.read(list(DUPLICATE_TOPICS), with_source=True), "src_offset")


def q_route_resume(spark, sf_dir):
    """Routing called as the topic grows, and once more; ignored records are not read again."""
    dst, k = _fresh(spark, "route-resume"), payload_int("k")
    for log in _arriving(spark, sf_dir):
        for _ in range(2):
            route_conditional(log, "topic1", k >= DUPLICATE_MIN_K, k < IGNORE_MAX_K, dst=dst)
    return _records(dst.read(list(DUPLICATE_TOPICS), with_source=True), "src_offset")


def _payload(value):
    """The JSON of one payload; most are read without the checks that ``json.loads`` makes first."""
    try:
        text = value.decode()
        found, end = _SCAN(text, 0)
        if end == len(text):
            return found
    except (StopIteration, ValueError):  # space around it, other encodings, broken JSON
        pass
    return json.loads(value)


def _running_sum(records, carry):
    """The sum of the payload's k so far; the carry is the sum at the slice's end."""
    total, out = carry or 0, []
    for value in records["value"]:
        k = _payload(value).get("k") if value is not None else None
        total += k or 0
        out.append(total)
    return out, total


def _ordered(spark, sf_dir):
    out = _fresh(spark, "ordered")
    process_partitions(base_log(spark, sf_dir), "topic1", _running_sum, out, "sums", slice_records=ORDERED_SLICE)
    return out


def q_partition_running_sums(spark, sf_dir):
    """A function that needs order over each partition, slice by slice with a carried sum."""
    return _records(_ordered(spark, sf_dir).read("sums", with_source=True), "src_offset")


def q_partition_commits_100(spark, sf_dir):
    """The same flow's commit log, one position for each 100 records of a partition."""
    return _ordered(spark, sf_dir).commit_log(DEFAULT_GROUP)


def q_range_source(spark, sf_dir):
    """The numbers 1..n, n the number of events, produced in order."""
    n = _table(spark, sf_dir, "events").count()
    return produce_numbers(_fresh(spark, "range"), n, "numbers")


def q_single_envelopes(spark, sf_dir):
    """F1 / T2 as a stream: one record an envelope, the key kept, positions from the envelopes."""
    dst = _fresh(spark, "stream-single")
    envelope_stream(
        base_log(spark, sf_dir), "topic1", lambda d: single_envelope(d, "single", keep_key=True), dst, "at_least_once",
        flow=_flow("single"), targets=["single"],
    ).awaitTermination()
    return _records(dst.read("single", with_source=True), "src_offset")


def q_per_record_commits(spark, sf_dir):
    """The sequence of commits after every record."""
    recs = base_log(spark, sf_dir).read("topic1").select("topic", "partition", "offset")
    return recs.select(F.lit(DEFAULT_GROUP).alias("group_id"), "topic", "partition", (F.col("offset") + 1).alias("next_offset"))


def q_stream_grouped_commits(spark, sf_dir):
    """T8 / G4 as a stream: one commit per count-or-time group, groups spanning micro-batches.

    What is open when the stream ends is committed then.
    """
    src = _fresh(spark, "arriving")
    for part in _two_parts(spark, sf_dir):
        src.produce(part, ["ts", "event_id"])
    dst = _fresh(spark, "stream-grouped")
    await_end(
        replicate_stream(
            src, "topic1", "test1", dst, "exactly_once", max_segments=1,
            commit_grouping=("within", GROUP_N, GROUP_HOURS * 3600), flow=_flow("grouped"),
        )
    )
    return dst.commit_log(DEFAULT_GROUP)


def q_topic_catalog_compacted(spark, sf_dir):
    """The catalog of topic1 from a snapshot of its index and the segments since."""
    for log in _arriving(spark, sf_dir):
        found = log.catalog(["topic1"])
        log.compact()
    return found


def q_stream_groups_keyed(spark, sf_dir):
    """G4 / T8 on Spark's keyed state: the count-or-time groups that close as topic1 grows, into the file sink."""
    out, checkpoint = scratch_dir(spark, "groups"), scratch_dir(spark, "groups-checkpoint")
    for src in _arriving(spark, sf_dir):
        groups = grouped_within_stream(src.stream_records("topic1"), GROUP_N, GROUP_HOURS * 3600, timeout=None, dense=True)
        to_files(groups, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def q_stream_file_sink(spark, sf_dir):
    """topic1 as it grows, through Spark's own file sink."""
    out, checkpoint = scratch_dir(spark, "files"), scratch_dir(spark, "files-checkpoint")
    for src in _arriving(spark, sf_dir):
        to_files(src.stream_records("topic1"), out, checkpoint).awaitTermination()
    return _records(spark.read.parquet(out))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topic_from_events": q_topic_from_events,
    "produce_report": q_produce_report,
    "plain_sink_events": q_plain_sink_events,
    "replicate_drop_key": q_replicate_drop_key,
    "replicate_keep_key": q_replicate_keep_key,
    "seek_offset": q_seek_offset,
    "assign_partitions": q_assign_partitions,
    "seek_stored_positions": q_seek_stored_positions,
    "assign_all_partitions": q_assign_all_partitions,
    "topic_catalog": q_topic_catalog,
    "fanout_two_topics": q_fanout_two_topics,
    "route_conditional": q_route_conditional,
    "route_commits": q_route_commits,
    "multi_result_report": q_multi_result_report,
    "commit_batches_20": q_commit_batches_20,
    "commit_batches_100": q_commit_batches_100,
    "grouped_within": q_grouped_within,
    "consumer_lag": q_consumer_lag,
    "pending_gauge": q_pending_gauge,
    "producer_metrics": q_producer_metrics,
    "consumer_metrics": q_consumer_metrics,
    "conversation_copy": q_conversation_copy,
    "chain_hops": q_chain_hops,
    "stream_exactly_once": q_stream_exactly_once,
    "stream_at_least_once": q_stream_at_least_once,
    "stream_at_most_once": q_stream_at_most_once,
    "stream_two_sources": q_stream_two_sources,
    "stream_batched_commits": q_stream_batched_commits,
    "stream_route": q_stream_route,
    "stream_fanout": q_stream_fanout,
    "replicate_hook": q_replicate_hook,
    "replicate_resume": q_replicate_resume,
    "external_offsets": q_external_offsets,
    "external_offsets_inclusive": q_external_offsets_inclusive,
    "csv_to_json_topic": q_csv_to_json_topic,
    "csv_multiline_documents": q_csv_multiline_documents,
    "replicate_batched_commits": q_replicate_batched_commits,
    "replicate_grouped_commits": q_replicate_grouped_commits,
    "chain_exactly_once": q_chain_exactly_once,
    "business_results": q_business_results,
    "per_record_commits": q_per_record_commits,
    "replicate_two_logs": q_replicate_two_logs,
    "replicate_completed": q_replicate_completed,
    "fanout_resume": q_fanout_resume,
    "route_resume": q_route_resume,
    "partition_running_sums": q_partition_running_sums,
    "partition_commits_100": q_partition_commits_100,
    "range_source": q_range_source,
    "single_envelopes": q_single_envelopes,
    "stream_grouped_commits": q_stream_grouped_commits,
    "topic_catalog_compacted": q_topic_catalog_compacted,
    "stream_groups_keyed": q_stream_groups_keyed,
    "stream_file_sink": q_stream_file_sink,
}
