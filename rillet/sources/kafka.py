"""The same record schema over an external message-log connector (Kafka format).

Untested here: the connector jar is not installed in this environment and there
is no network. ``available`` says whether the ``kafka`` source can be loaded.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.model import DEFAULT_GROUP


def available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001
        return False


def _records(df: DataFrame) -> DataFrame:
    return df.select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.col("timestamp"),
    )


def read_topics(
    spark: SparkSession,
    servers: str,
    topics: list[str] | None = None,
    assign: dict[str, list[int]] | None = None,
    starting: str | dict = "earliest",
    streaming: bool = True,
    read_committed: bool = True,
    max_offsets_per_trigger: int | None = None,
    group_id: str = DEFAULT_GROUP,
) -> DataFrame:
    """Subscribe (or assign partitions) from ``starting`` (earliest by default)."""
    reader = spark.readStream if streaming else spark.read
    r = reader.format("kafka").option("kafka.bootstrap.servers", servers)
    r = r.option("kafka.group.id", group_id)
    if assign:
        r = r.option("assign", json.dumps(assign))
    else:
        r = r.option("subscribe", ",".join(topics or []))
    r = r.option("startingOffsets", starting if isinstance(starting, str) else json.dumps(starting))
    if read_committed:
        r = r.option("kafka.isolation.level", "read_committed")
    if max_offsets_per_trigger and streaming:
        r = r.option("maxOffsetsPerTrigger", int(max_offsets_per_trigger))
    return _records(r.load())


def write_topics(df: DataFrame, servers: str, checkpoint: str | None = None):
    """K1 / K4: write (topic, partition, key, value) records; streams need a checkpoint."""
    cols = [c for c in ("topic", "partition", "key", "value") if c in df.columns]
    out = df.select(*[F.col(c) for c in cols])
    if df.isStreaming:
        return (
            out.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("checkpointLocation", checkpoint)
            .start()
        )
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    return None
