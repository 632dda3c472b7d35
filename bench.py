"""Throughput bench: the headline operators over ``events`` at $BENCH_SF_DIR.

Prints one JSON line: {"metric", "value" (sum of per-step medians, seconds), "unit",
"queries": {name: median sec}, "rows_per_sec": {name: rows/s}, "sf", "cpus", "memory", "repeats"}.
Each timed step is a full action (a write, or a collect of a small result). After one
warm-up pass, every step runs ``BENCH_REPEATS`` times (default 5) and reports the median.
"""

from __future__ import annotations

import json
import os
import statistics
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rillet.operators.batching import commit_batches  # noqa: E402
from rillet.operators.copy import fan_out, replicate, route_conditional  # noqa: E402
from rillet.operators.grouped_within import grouped_within  # noqa: E402
from rillet.operators.observe import consumer_lag  # noqa: E402
from rillet.functions.records import payload_int  # noqa: E402
from rillet.session import get_session, scratch_dir  # noqa: E402
from rillet.sources.generate import events_to_produced  # noqa: E402
from rillet.sources import fs  # noqa: E402
from rillet.sources.log import TopicLog  # noqa: E402
from rillet.streaming.external import stop_positions  # noqa: E402
from rillet.streaming.flows import replicate_stream  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(
        f"local[{cpus}]",
        app="rillet-bench",
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    runs: dict[str, list[float]] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        runs.setdefault(name, []).append(time.perf_counter() - t)
        return out

    made: list[str] = []

    def log_at(label: str) -> TopicLog:
        log = TopicLog(spark, scratch_dir(spark, label))
        made.append(log.root)
        return log

    def one_pass() -> None:
        src = log_at("bench-src")
        week = F.concat(F.lit("week-"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
        timed("topic_build", lambda: src.produce(events_to_produced(events), ["ts", "event_id"], seg=week))

        timed("replicate_batch", lambda: replicate(src, "topic1", "test1", dst=log_at("b-copy")).count())

        def stream(guarantee):
            dst = log_at(f"b-{guarantee}")
            q = replicate_stream(src, "topic1", "test1", dst, guarantee, max_segments=2, flow="copy")
            q.awaitTermination()
            return dst.read("test1").count()

        timed("replicate_stream_at_least_once", lambda: stream("at_least_once"))
        timed("replicate_stream_exactly_once", lambda: stream("exactly_once"))
        timed("fanout_two_topics", lambda: fan_out(src, "topic1", dst=log_at("b-fan")).count())
        k = payload_int("k")
        timed(
            "route_conditional",
            lambda: route_conditional(src, "topic1", k >= 80, k < 10, dst=log_at("b-route"))[0].count(),
        )
        recs = src.read("topic1")
        timed("commit_batches_20", lambda: commit_batches(recs.select("topic", "partition", "offset"), 20).collect())
        timed("grouped_within", lambda: grouped_within(recs, 20, 5 * 3600).collect())
        timed("topic_catalog", lambda: src.catalog().collect())
        lag_dst = log_at("b-lag")
        stop = stop_positions(src.read("topic1"), F.col("timestamp") < F.lit("2024-01-15"))
        replicate(src, "topic1", "test1", dst=lag_dst, to_positions=stop)
        timed("consumer_lag", lambda: consumer_lag(src.catalog(["topic1"]), lag_dst.committed_positions("group1"), "group1").collect())

    def clean() -> None:
        # the pass's own logs; nothing reads them after the pass
        while made:
            fs.delete(spark, made.pop())

    one_pass()  # warm-up: JVM, code generation, Python workers
    clean()
    runs.clear()
    for _ in range(repeats):
        one_pass()
        clean()
    times = {q: round(statistics.median(v), 3) for q, v in runs.items()}

    per_row = {"topic_build", "replicate_batch", "replicate_stream_at_least_once", "replicate_stream_exactly_once",
               "fanout_two_topics", "route_conditional"}
    rps = {q: round(n / t, 1) for q, t in times.items() if q in per_row and t > 0}
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rps,
                "rows": n,
                "sf": float(sf.group(1)) if sf else sf_dir,
                "cpus": cpus,
                "memory": spark.conf.get("spark.driver.memory", "default"),
                "repeats": repeats,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
