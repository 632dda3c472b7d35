"""Record, envelope, result, commit and catalog schemas (fixed, never inferred)."""

from pyspark.sql import types as T

# A record stored in a topic: identity is (topic, partition, offset).
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("key", T.StringType(), True),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
    ]
)

# Columns stored inside the data files; topic/partition/seg are directory columns.
# src_* is provenance (like a record header): where a copied record was consumed.
STORED_SCHEMA = T.StructType(
    [
        T.StructField("offset", T.LongType(), False),
        T.StructField("key", T.StringType(), True),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("src_topic", T.StringType(), True),
        T.StructField("src_partition", T.IntegerType(), True),
        T.StructField("src_offset", T.LongType(), True),
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("seg", T.StringType(), False),
    ]
)

# A record about to be produced: partition and key may be left open.
PRODUCED_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("key", T.StringType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)

PRODUCED_RECORD = T.StructType(
    [
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("key", T.StringType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)

# Source coordinates carried along so the consumed position can be committed.
PASS_THROUGH = T.StructType(
    [
        T.StructField("group_id", T.StringType(), True),
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
    ]
)

# One source record turned into 0, 1 or N records to produce.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("records", T.ArrayType(PRODUCED_RECORD), False),
        T.StructField("pass_through", PASS_THROUGH, True),
    ]
)

# What a produce step reports for each written record.
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("value", T.StringType(), True),
        T.StructField("pass_through", T.IntegerType(), True),
    ]
)

# Committed consumer position: the next offset to read.
COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("group_id", T.StringType(), False),
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("next_offset", T.LongType(), False),
    ]
)

# A commit as stored: the records [begin_offset, next_offset) of one log (by its root) were consumed.
STORED_COMMIT_SCHEMA = T.StructType(
    [
        *COMMIT_SCHEMA.fields,
        T.StructField("begin_offset", T.LongType(), True),
        T.StructField("source", T.StringType(), True),
    ]
)

# What a group has consumed of a partition: disjoint ranges, the end not included.
RANGE_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("begin_offset", T.LongType(), False),
        T.StructField("next_offset", T.LongType(), False),
    ]
)

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("begin_offset", T.LongType(), False),
        T.StructField("end_offset", T.LongType(), False),
        T.StructField("n_records", T.LongType(), False),
    ]
)

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("n_records", T.LongType(), False),
        T.StructField("n_bytes", T.LongType(), False),
    ]
)

# Per-segment index row: a segment is visible to readers once its row exists.
SEGMENT_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("begin_offset", T.LongType(), False),
        T.StructField("end_offset", T.LongType(), False),
        T.StructField("n_records", T.LongType(), False),
        T.StructField("seg", T.StringType(), False),
    ]
)

RECORD_COLUMNS = [f.name for f in RECORD_SCHEMA.fields]
SOURCE_COLUMNS = ["src_topic", "src_partition", "src_offset"]
TP = ["topic", "partition"]

# Fixed values that must equal the reference's defaults.
DEFAULT_GROUP = "group1"
PRODUCE_KEY = "key"
PRODUCE_PARTITION = 0
DEFAULT_TOPIC_PARTITIONS = 1
COMMIT_BATCH = 20
MERGED_COMMIT_BATCH = 100
GROUP_LIMIT = 20
GROUP_WINDOW_SECONDS = 5
PASSED_THROUGH_TEXT = "passed through"
GAUGE_HELP = "# HELP messages Number of messages in the queueService"
GAUGE_TYPE = "# TYPE messages gauge"
# Restart backoff for the exactly-once flow: 3 s minimum, 30 s maximum, 20 % random factor.
RESTART_MIN_SECONDS = 3.0
RESTART_MAX_SECONDS = 30.0
RESTART_RANDOM_FACTOR = 0.2
