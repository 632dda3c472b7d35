"""A corpus pipeline: quality rules, language, near-duplicates, personal data, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All
stages but the last return the columns of ``docs``; empty and null texts go at the first.
Rows with a null id, or the same one, are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.llm import language_id, near_dedup, packing, pii, quality_rules
from rillet.llm.staging import staged, text_session

#: A document's language stage: the largest share a language must have.
MIN_LANGUAGE_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps. The rules are judged in the scan itself: no join."""
    text_session(spark)
    return quality_rules.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one learned language has at least half."""
    text_session(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    found = docs.withColumn("_language", language_id.predictor(model)("text"))
    return found.where(F.col("_language.score") >= MIN_LANGUAGE_SHARE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, null last (of repeated rows, one)."""
    text_session(spark)
    key = near_dedup.ROW
    groups = staged(near_dedup.grouped(docs, k=5, percent=80).select(*key, "first"), "groups")
    gone = groups.where("NOT first").select(*key).distinct()
    twice = groups.where("first").groupBy(*key).count().where("count > 1").select(*key)
    kept = _joined(near_dedup.with_row(docs), gone, "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = _joined(kept, twice, "left_semi").dropDuplicates(key)
    return _joined(kept, twice, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Keys are broadcast up to a checked number of rows (16 bytes each); beyond it both sides are shuffled."""
    few = keys.limit(near_dedup.BROADCAST_IDS + 1).count() <= near_dedup.BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), near_dedup.ROW, how)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data replaced by its kind."""
    text_session(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 ids."""
    text_session(spark)
    return packing.digest(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]

#: Language, personal data and packing can't be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
