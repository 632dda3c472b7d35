"""Record-level projections and hooks (P1-P5, P9-P13). All Column / DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.model import DEFAULT_GROUP, PRODUCE_KEY, PRODUCE_PARTITION

SOURCE_COLUMNS = ["src_topic", "src_partition", "src_offset"]


def with_source(df: DataFrame) -> DataFrame:
    """Keep the consumed coordinates next to the record (the pass-through of a copy)."""
    return (
        df.withColumn("src_topic", F.col("topic"))
        .withColumn("src_partition", F.col("partition"))
        .withColumn("src_offset", F.col("offset"))
    )


def readdress(df: DataFrame, topic: str | Column, keep_key: bool = False, partition: Column | None = None) -> DataFrame:
    """A consumed record re-addressed to ``topic``; the key is dropped unless ``keep_key``.

    The copy stays in the source partition number unless ``partition`` is given, so
    per-partition order survives the copy.
    """
    t = F.lit(topic) if isinstance(topic, str) else topic
    return with_source(df).select(
        t.alias("topic"),
        (F.col("partition") if partition is None else partition).cast("int").alias("partition"),
        (F.col("key") if keep_key else F.lit(None).cast("string")).alias("key"),
        F.col("value"),
        F.col("timestamp"),
        *SOURCE_COLUMNS,
    )


def number_text(c: Column | str) -> Column:
    """Number to its decimal text."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def fixed_address(
    df: DataFrame,
    topic: str,
    value: Column,
    partition: int | None = PRODUCE_PARTITION,
    key: str | None = PRODUCE_KEY,
) -> DataFrame:
    """Records for ``topic`` with a fixed partition and key (either may be None)."""
    return df.withColumn("topic", F.lit(topic)).withColumn(
        "partition", F.lit(partition).cast("int")
    ).withColumn("key", F.lit(key).cast("string")).withColumn("value", value)


def committable(df: DataFrame, group_id: str = DEFAULT_GROUP) -> DataFrame:
    """P10: the position a consumed record lets a group commit."""
    return df.select(
        F.lit(group_id).alias("group_id"),
        F.col("topic"),
        F.col("partition"),
        F.col("offset"),
    )


def pass_through(results: DataFrame) -> DataFrame:
    """The pass-through value carried by produce results or envelopes."""
    return results.select("pass_through.*")


def identity(df: DataFrame) -> DataFrame:
    return df


def business(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The user transform hook; identity by default."""
    return df.transform(fn or identity)


def apply_record_fn(
    df: DataFrame,
    fn: Callable[[Column, Column], Column] | None = None,
    output: str = "result",
) -> DataFrame:
    """A per-record function of (key, value) as a Column expression.

    Default: the value as text. Use a ``pandas_udf`` for logic that needs Python;
    it then runs on Arrow batches, not row by row.
    """
    f = fn or (lambda key, value: value.cast("string"))
    return df.withColumn(output, f(F.col("key"), F.col("value")))


def payload_int(field: str, value: Column | str = "value") -> Column:
    """A JSON payload field as an integer, for routing predicates.

    Missing fields, non-JSON payloads and non-numeric values give null (``try_cast``),
    never a failed job.
    """
    v = F.col(value) if isinstance(value, str) else value
    return F.get_json_object(v.cast("string"), f"$.{field}").try_cast("int")
