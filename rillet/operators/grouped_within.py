"""Count-or-time grouping (G4): close a group at ``n`` records or ``d`` of event time.

Per (topic, partition), in offset order: a group opens at its first record and
closes before a record that would be its (n+1)-th, or whose timestamp is at
least the group's first timestamp + d.

The fold is sequential, but a hot partition must not become one task. Each
partition is cut into chunks of bounded size; a chunk also receives the ``n``
records before it (its halo). The only thing a chunk needs from its past is
where the group open at its start began - one of ``n + 1`` possibilities - so:

1. every chunk computes, in parallel, its exit for each possible entry
   (vectorised: next-start table, then pointer doubling);
2. exit tables are functions from entry to exit: those of ``FAN`` neighbouring chunks are
   composed into one, level by level, until a partition is one table; on the way back each
   level's tables hand their entries down, which fixes each chunk's real entry;
3. every chunk, in parallel, labels its groups from that entry and emits group
   fragments, which a hash aggregate merges across chunk borders.

No task holds more than one chunk's records, or ``FAN`` tables of n + 1 numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.model import GROUP_LIMIT, GROUP_WINDOW_SECONDS, TP
from rillet.operators.offsets import join_small, offsets_from_source
from rillet.session import scratch_dir

#: Records of a chunk.
CHUNK = 100_000
#: Exit tables composed into one.
FAN = 1_000

_KEYS = ["topic", "partition", "chunk"]


def _next_starts(ts: np.ndarray, n: int, d: int) -> np.ndarray:
    """nxt[i]: where the group opened at i closes (capped at len(ts) when it runs past the end)."""
    size = len(ts)
    nxt = np.minimum(np.arange(size) + n, size)
    found = np.zeros(size, dtype=bool)
    for k in range(1, n):
        if k >= size:
            break
        hit = np.zeros(size, dtype=bool)
        hit[: size - k] = ts[k:] >= ts[: size - k] + d
        new = hit & ~found
        nxt[new] = np.arange(size)[new] + k
        found |= hit
    return nxt


def _last_start(nxt: np.ndarray, end: int) -> np.ndarray:
    """For every position, the last group start before ``end`` on the path from it."""
    idx = np.arange(len(nxt))
    jump = np.where(nxt < end, nxt, idx)
    while True:
        nxt_jump = jump[jump]
        if np.array_equal(nxt_jump, jump):
            return jump
        jump = nxt_jump


def _prepare(pdf: pd.DataFrame):
    if pdf["_ts"].isna().any():
        raise ValueError("count-or-time grouping needs a timestamp on every record")
    pdf = pdf.sort_values("_pos", kind="stable")
    halo = pdf["_halo"].to_numpy()
    ts = pdf["_ts"].to_numpy(dtype=np.int64)
    return pdf, int(halo.sum()), ts


def _exits(n: int, d: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, h, ts = _prepare(pdf)
        end = len(ts)
        if h == end:  # past the partition's end: nothing of its own
            return pd.DataFrame(columns=["topic", "partition", "chunk", "exits"], dtype=object)
        nxt = _next_starts(ts, n, d)
        last = _last_start(nxt, end)
        # entry j: the open group began j records before this chunk (j = 0: it starts here)
        exits = [int(end - last[h - j]) if 0 <= h - j < end else -1 for j in range(n + 1)]
        return pd.DataFrame(
            {
                "topic": [pdf["topic"].iloc[0]],
                "partition": [int(pdf["partition"].iloc[0])],
                "chunk": [int(pdf["chunk"].iloc[0])],
                "exits": [exits],
            }
        )

    return run


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One table for neighbouring ones: each possible entry led through all of them."""
    at = None
    for exits in pdf.sort_values("chunk")["exits"]:
        exits = np.asarray(exits, dtype=np.int64)
        at = exits if at is None else np.where(at >= 0, exits[at], -1)
    row = pdf.iloc[:1][["topic", "partition", "above"]].rename(columns={"above": "chunk"})
    return row.assign(exits=[at.tolist()])


def _hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entry of each of a group's tables, in order, from the entry of the group."""
    pdf = pdf.sort_values("chunk")
    at, entries = int(pdf["entry"].iloc[0]), []
    for exits in pdf["exits"]:
        entries.append(at)
        at = int(exits[at])
    return pdf[["topic", "partition", "chunk"]].assign(entry=np.asarray(entries, dtype=np.int64))


def _entries(exits: DataFrame) -> DataFrame:
    """(topic, partition, chunk, entry) of all tables (topic, partition, chunk, exits)."""
    spark = exits.sparkSession
    ddl = "topic string, partition int, chunk long, exits array<long>"

    def kept(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "chunk-exits")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    levels = [kept(exits).withColumn("above", F.floor(F.col("chunk") / FAN))]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) >= FAN:
        composed = levels[-1].groupBy(*TP, "above").applyInPandas(_compose, ddl)
        levels.append(kept(composed).withColumn("above", F.floor(F.col("chunk") / FAN)))
    above = levels[-1].select(*TP, "above").distinct().withColumn("entry", F.lit(0).cast("long"))
    for level in reversed(levels):
        told = join_small(level, above, [*TP, "above"])
        found = told.groupBy(*TP, "above").applyInPandas(_hand_down, "topic string, partition int, chunk long, entry long")
        above = kept(found).withColumnRenamed("chunk", "above")
    return above.withColumnRenamed("above", "chunk")


def _fragments(n: int, d: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, h, ts = _prepare(pdf)
        end = len(ts)
        entry = int(pdf["entry"].iloc[0])
        nxt = _next_starts(ts, n, d)
        start = h - entry
        is_start = np.zeros(end, dtype=bool)
        while start < end:
            is_start[start] = True
            start = int(nxt[start])
        owner = np.maximum.accumulate(np.where(is_start, np.arange(end), -1))
        own = slice(h, end)
        offsets = pdf["offset"].to_numpy(dtype=np.int64)
        frag = pd.DataFrame({"first_offset": offsets[owner[own]], "offset": offsets[own]})
        frag = frag.groupby("first_offset", sort=False)["offset"].agg(["count", "max"]).reset_index()
        return pd.DataFrame(
            {
                "topic": pdf["topic"].iloc[0],
                "partition": np.int32(pdf["partition"].iloc[0]),
                "first_offset": frag["first_offset"].to_numpy(dtype=np.int64),
                "n_records": frag["count"].to_numpy(dtype=np.int64),
                "last_offset": frag["max"].to_numpy(dtype=np.int64),
            }
        )

    return run


def grouped_within(
    records: DataFrame,
    n: int = GROUP_LIMIT,
    seconds: float = GROUP_WINDOW_SECONDS,
    chunk_size: int | None = None,
) -> DataFrame:
    """Groups of (topic, partition, first_offset, next_offset, n_records)."""
    d = int(round(seconds * 1_000_000))
    base = records.select(
        *TP,
        "offset",
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_ts"),
    )
    c = max(int(chunk_size or CHUNK), n + 1)  # the records before a chunk must come from one chunk
    out_schema = "topic string, partition int, first_offset long, n_records long, last_offset long"

    # dense position per partition, in offset order (arithmetic when offsets are contiguous)
    src = base.withColumns(
        {"src_topic": F.col("topic"), "src_partition": F.col("partition"), "src_offset": F.col("offset")}
    ).withColumnRenamed("offset", "_orig")
    dense = offsets_from_source(src).select(
        *TP, F.col("_orig").alias("offset"), "_ts", F.col("offset").alias("_pos")
    )
    # each record in its own chunk, the last n of a chunk also in the next one
    own = F.floor(F.col("_pos") / c)
    last = F.pmod(F.col("_pos"), F.lit(c)) >= c - n
    chunks = F.when(last, F.array(own, own + 1)).otherwise(F.array(own))
    rows = dense.select("*", F.explode(chunks).alias("chunk")).withColumn("_halo", F.col("chunk") > own)
    exits = rows.groupBy(*_KEYS).applyInPandas(
        _exits(n, d), "topic string, partition int, chunk long, exits array<long>"
    )
    entries = _entries(exits)
    # halo-only chunks past a partition's end have no entry and drop out here
    labelled = join_small(rows, entries, _KEYS)
    frags = labelled.groupBy(*_KEYS).applyInPandas(_fragments(n, d), out_schema)
    return frags.groupBy(*TP, "first_offset").agg(
        (F.max("last_offset") + 1).alias("next_offset"),
        F.sum("n_records").cast("long").alias("n_records"),
    )
