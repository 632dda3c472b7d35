"""Metrics and lag (O1-O3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rillet.model import GAUGE_HELP, GAUGE_TYPE, TP


def observe_consumption(df: DataFrame, name: str = "consumed"):
    """O1: attach record count, highest offset and bytes to a (streaming) frame.

    Batch: pass an ``Observation`` and read ``.get`` after an action. Stream: the
    metrics appear in ``query.lastProgress['observedMetrics'][name]``.
    """
    metrics = [
        F.count(F.lit(1)).alias("n_records"),
        F.max("offset").alias("max_offset"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n_bytes"),
    ]
    if df.isStreaming:
        return df.observe(name, *metrics), None
    obs = Observation(name)
    return df.observe(obs, *metrics), obs


def consumer_metrics(records: DataFrame) -> DataFrame:
    """O1 as a table: per (topic, partition) count, highest offset and bytes consumed."""
    return records.groupBy(*TP).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.max("offset").alias("max_offset"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("n_bytes"),
    )


def producer_metrics(records: DataFrame) -> DataFrame:
    """O2: records and payload bytes produced per (topic, partition)."""
    return records.groupBy(*TP).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("n_bytes"),
    )


def consumer_lag(catalog: DataFrame, positions: DataFrame, group_id: str) -> DataFrame:
    """O3: lag = end offset - committed next offset (begin offset when nothing committed)."""
    pos = positions.where(F.col("group_id") == group_id).select(*TP, "next_offset")
    return (
        catalog.join(pos, TP, "left")
        .select(
            F.lit(group_id).alias("group_id"),
            *TP,
            "end_offset",
            F.coalesce(F.col("next_offset"), F.col("begin_offset")).alias("next_offset"),
        )
        .withColumn("lag", F.greatest(F.col("end_offset") - F.col("next_offset"), F.lit(0)).cast("long"))
    )


def pending_gauge(lag: DataFrame) -> DataFrame:
    """O3 exposition text: HELP and TYPE lines, then ``messages <total lag>``."""
    return lag.agg(F.coalesce(F.sum("lag"), F.lit(0)).cast("long").alias("messages")).select(
        "messages",
        F.concat(
            F.lit(f"{GAUGE_HELP}\n{GAUGE_TYPE}\nmessages "),
            F.col("messages").cast("string"),
        ).alias("text"),
    )
