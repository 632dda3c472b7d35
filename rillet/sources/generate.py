"""Record generators: number ranges (S10) and tables mapped to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number_range(spark: SparkSession, n: int, start: int = 1) -> DataFrame:
    """The integers start..n inclusive as column ``number`` (``Source.range``)."""
    return spark.range(start, int(n) + 1).withColumnRenamed("id", "number")


def table_to_produced(
    df: DataFrame,
    topic: Column | str,
    partition: Column | None,
    key: Column | None,
    value: Column,
    timestamp: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Map any table to records to produce: (topic, partition, key, value, timestamp, keep...)."""
    t = F.lit(topic) if isinstance(topic, str) else topic
    return df.select(
        t.alias("topic"),
        (F.lit(None) if partition is None else partition).cast("int").alias("partition"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        value.cast("binary").alias("value"),
        (F.lit(None) if timestamp is None else timestamp).cast("timestamp").alias("timestamp"),
        *(keep or []),
    )


def events_to_produced(events: DataFrame, topic: Column | str = "topic1", partitions: int = 4) -> DataFrame:
    """The events table as records: partition = user_id % partitions, key = user_id, value = props."""
    return table_to_produced(
        events,
        topic,
        F.pmod(F.col("user_id"), F.lit(partitions)),
        F.col("user_id").cast("string"),
        F.col("props"),
        F.col("ts"),
        keep=["ts", "event_id"],
    )
