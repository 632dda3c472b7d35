"""Envelopes and routing (F1-F5): one consumed record becomes 0, 1 or N records.

An envelope row keeps the consumed position (``pass_through``) whatever it
produces, so commits are taken from envelopes *before* they are exploded and an
ignored record still advances its group's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.model import DEFAULT_GROUP



def _empty_records() -> Column:
    return F.array().cast("array<struct<topic:string,partition:int,key:string,value:binary>>")


def produced_record(topic: str, keep_key: bool = False) -> Column:
    """One record to produce: copy of the consumed value (and key when kept), same partition."""
    return F.struct(
        F.lit(topic).alias("topic"),
        F.col("partition").cast("int").alias("partition"),
        (F.col("key") if keep_key else F.lit(None).cast("string")).alias("key"),
        F.col("value").cast("binary").alias("value"),
    )


def _pass_through(group_id: str) -> Column:
    return F.struct(
        F.lit(group_id).alias("group_id"),
        F.col("topic").alias("topic"),
        F.col("partition").alias("partition"),
        F.col("offset").alias("offset"),
    )


def envelope(df: DataFrame, records: Column, group_id: str = DEFAULT_GROUP) -> DataFrame:
    return df.select(
        records.alias("records"),
        _pass_through(group_id).alias("pass_through"),
        F.col("timestamp"),
    )


def single_envelope(df: DataFrame, topic: str, keep_key: bool = False, group_id: str = DEFAULT_GROUP) -> DataFrame:
    """one record per consumed record."""
    return envelope(df, F.array(produced_record(topic, keep_key)), group_id)


def multi_envelope(df: DataFrame, topics: list[str], keep_key: bool = False, group_id: str = DEFAULT_GROUP) -> DataFrame:
    """The same value to every topic in ``topics``."""
    return envelope(df, F.array(*[produced_record(t, keep_key) for t in topics]), group_id)


def pass_through_envelope(df: DataFrame, group_id: str = DEFAULT_GROUP) -> DataFrame:
    """nothing produced; the position is still committed."""
    return envelope(df, _empty_records(), group_id)


def route(
    df: DataFrame,
    duplicate: Column,
    ignore: Column,
    duplicate_topics: tuple[str, ...] = ("topic2", "topic3"),
    single_topic: str = "topic2",
    keep_key: bool = False,
    group_id: str = DEFAULT_GROUP,
) -> DataFrame:
    """duplicate -> every duplicate topic; else ignore -> nothing; else -> ``single_topic``."""
    records = (
        F.when(duplicate, F.array(*[produced_record(t, keep_key) for t in duplicate_topics]))
        .when(ignore, _empty_records())
        .otherwise(F.array(produced_record(single_topic, keep_key)))
    )
    return envelope(df, records, group_id)


def explode_envelopes(envelopes: DataFrame) -> DataFrame:
    """Produced records with their source coordinates and position inside the envelope."""
    return envelopes.select(
        F.posexplode("records").alias("part", "r"),
        "pass_through",
        "timestamp",
    ).select(
        F.col("r.topic").alias("topic"),
        F.col("r.partition").alias("partition"),
        F.col("r.key").alias("key"),
        F.col("r.value").alias("value"),
        F.col("timestamp"),
        F.col("pass_through.topic").alias("src_topic"),
        F.col("pass_through.partition").alias("src_partition"),
        F.col("pass_through.offset").alias("src_offset"),
        F.col("part"),
    )


def envelope_positions(envelopes: DataFrame) -> DataFrame:
    """The consumed positions of envelopes, as (group_id, topic, partition, offset)."""
    return envelopes.select("pass_through.*")
