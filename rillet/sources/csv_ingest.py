"""CSV rows -> JSON records -> topic, as a stream over a folder of CSV files.

New files in the folder are picked up each trigger (30 s in the service form);
each row becomes one JSON record. Offsets follow ``order_by`` within each
micro-batch, continuing from the topic's end offsets; batches are written
exactly-once (segment per batch id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillet.sources.generate import table_to_produced
from rillet.sources.log import TopicLog
from rillet.streaming.flows import produce_stream

#: Timestamps in CSV and JSON, to the microsecond.
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
INGEST_TRIGGER = {"processingTime": "30 seconds"}


def csv_stream(spark: SparkSession, folder: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).options(header=True, multiLine=True, escape='"', timestampFormat=TIMESTAMP)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", int(max_files))
    return reader.csv(folder)


def rows_to_json(df: DataFrame, columns: list[str]) -> Column:
    options = {"timestampFormat": TIMESTAMP, "timestampNTZFormat": TIMESTAMP}
    return F.to_json(F.struct(*[F.col(c) for c in columns]), options)


def ingest_csv(
    log: TopicLog,
    folder: str,
    schema: T.StructType,
    topic: str,
    json_columns: list[str],
    order_by: list[str],
    key: Column | None = None,
    partition: Column | None = None,
    timestamp: Column | None = None,
    flow: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Start the ingest stream; ``trigger`` defaults to every 30 seconds."""
    stream = csv_stream(log.spark, folder, schema, max_files)

    def to_records(batch: DataFrame) -> DataFrame:
        return table_to_produced(
            batch, topic, partition, key, rows_to_json(batch, json_columns), timestamp, keep=order_by
        )

    return produce_stream(
        stream,
        log,
        to_records,
        order_by,
        flow=flow,
        checkpoint=checkpoint,
        trigger=trigger or INGEST_TRIGGER,
    )
