"""Tables written to the shared scratch folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillet.session import configure, scratch_dir

#: Rows that go to a Python worker at once: whole texts, so fewer than Spark's 10,000.
TEXT_ROWS = 1000


def text_session(spark: SparkSession) -> SparkSession:
    """The session, set up for operators that pass whole texts to Python workers."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return spark


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the folder in ``spark.checkpoint.dir`` and read back."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
