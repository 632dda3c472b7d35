"""Driver-side metadata calls through the cluster's Hadoop FileSystem.

Only small things go through here (markers, existence checks); record data is
always read and written by Spark tasks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def create_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a marker file only if it does not exist yet; True when we created it.

    ``FileSystem.create(path, overwrite=False)`` fails when the file exists, which
    makes this a claim usable by at-most-once delivery.
    """
    fs, p = _path(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as exc:  # noqa: BLE001 - Py4J wraps FileAlreadyExistsException
        if "FileAlreadyExists" in str(exc) or fs.exists(p):
            return False
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def glob_any(spark: SparkSession, pattern: str) -> bool:
    """True when the glob pattern matches at least one path."""
    fs, p = _path(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream)
        )
        return reader.readLine()
    finally:
        stream.close()
