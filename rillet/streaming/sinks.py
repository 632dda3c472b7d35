"""Terminal sinks (K5, K7-K9) for record frames, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillet.session import scratch_dir


def as_text(df: DataFrame) -> DataFrame:
    """Records as printable text: the value decoded as UTF-8."""
    return df.select(F.col("value").cast("string").alias("value"))


def ignore(df: DataFrame, trigger: dict | None = None) -> StreamingQuery | None:
    """K7: run the flow and drop its output (``noop`` format)."""
    if df.isStreaming:
        return (
            df.writeStream.format("noop")
            .option("checkpointLocation", scratch_dir(df.sparkSession, "noop-checkpoint"))
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    df.write.format("noop").mode("overwrite").save()
    return None


def print_each(df: DataFrame, trigger: dict | None = None) -> StreamingQuery | None:
    """K8: print every element, one line each; one partition at a time is on the driver."""
    if df.isStreaming:
        return (
            df.writeStream.foreachBatch(lambda batch, _: print_each(batch))
            .option("checkpointLocation", scratch_dir(df.sparkSession, "console-checkpoint"))
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    for row in df.toLocalIterator():
        print(*row, sep="\t")
    return None


def to_memory(df: DataFrame, name: str, trigger: dict | None = None) -> StreamingQuery:
    """K9 for streams: keep the output in an in-memory table (tests, small results only)."""
    return (
        df.writeStream.format("memory")
        .queryName(name)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def to_files(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """K5 by Spark's own file sink: Parquet files under ``path``, each row once.

    A batch's files count once the sink's ``_spark_metadata`` names them, which is one atomic
    write; a replayed batch that is named already is skipped. ``spark.read.parquet(path)`` reads
    the named files only, so what a failed attempt left is never seen.
    """
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
