"""Write PLANS.md: the physical plan of each headline operator (sf0.01 by default).

For each plan: the operator tree, and for every scan the folders it lists, the
filters it pushes down and the columns it reads.

    python explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

from pyspark.sql import functions as F

from rillet.functions.records import payload_int, readdress
from rillet.operators.batching import commit_batches
from rillet.operators.grouped_within import grouped_within
from rillet.operators.observe import consumer_lag
from rillet.operators.offsets import assign_in_splits, assign_offsets, offsets_from_source
from rillet.operators.routing import explode_envelopes, route
from rillet.session import get_session, scratch_dir
from rillet.sources.generate import events_to_produced
from rillet.sources.log import TopicLog

KEEP = re.compile(r"^(\s*[+:|-].*|\S.*\(\d+\)$|Location:.*|PartitionFilters:.*|PushedFilters:.*|ReadSchema:.*|Join type:.*)$")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    lines = []
    for line in buf.getvalue().splitlines():
        line = re.sub(r"file:/\S*/rillet/([a-z-]+)-[0-9a-f]+", r"<\1>", line)
        line = re.sub(r"#\d+", "", line)
        if KEEP.match(line) and not line.startswith("(") and "Arguments" not in line:
            lines.append(line)
    return "\n".join(lines)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf}/events.parquet")
    log = TopicLog(spark, scratch_dir(spark, "plans"))
    log.produce(events_to_produced(events), ["ts", "event_id"])
    recs = log.read("topic1")
    k = payload_int("k")
    source = ["src_topic", "src_partition", "src_offset"]
    plans = {
        "topic build in the input's splits (no record shuffle)":
            assign_in_splits(events_to_produced(events), ["ts", "event_id"], log.end_offsets())[0],
        "topic build over range slices, where splits overlap (record pass over the staged table)":
            assign_offsets(events_to_produced(events), ["ts", "event_id"], log.end_offsets()),
        "replicate: offsets from source ranges (no record shuffle)":
            offsets_from_source(readdress(recs, "test1"), None),
        "seek: one partition from an offset":
            log.read("topic1", partitions=[0], from_offset=1000),
        "commit batches of 20":
            commit_batches(recs.select("topic", "partition", "offset"), 20),
        "topic catalog (segment index only)": log.catalog(),
        "consumer lag": consumer_lag(log.catalog(), commit_batches(recs.select("topic", "partition", "offset"), 20)
                                     .groupBy("group_id", "topic", "partition").agg(F.max("next_offset").alias("next_offset")), "group1"),
        "conditional routing, numbered in the source's splits (no record shuffle)":
            assign_in_splits(explode_envelopes(route(recs, k >= 80, k < 10)), [*source, "part"], None, source)[0],
        "count-or-time groups (partitions fit one chunk)": grouped_within(recs, 20, 5 * 3600),
        "count-or-time groups (chunked: 500-record chunks, exits, composed tables, fragments)":
            grouped_within(recs, 20, 5 * 3600, chunk_size=500),
    }
    out = ["# Physical plans", "", f"Generated by `explain_plans.py` on `{sf}` (local[8], AQE on).", ""]
    for title, df in plans.items():
        out += [f"## {title}", "", "```", plan_text(df), "```", ""]
    open("PLANS.md", "w").write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
