"""Large CSV files with line breaks inside quotes, read by many tasks.

A line alone does not tell whether it starts a record: that hangs on the quotes before it. Two
narrow passes over the files' splits settle it:

1. the quotes of each split are counted; the sums before a split, of which only the parity
   counts, say whether it begins inside a quoted field (one row a split);
2. each task walks its splits' lines from there and hands on the records that begin and end in
   one split. Only a record that crosses a border leaves its task: its pieces, at most two a
   split, are put together by a group.

Quotes inside a field are doubled. Lines end with \\n or \\r\\n; a \\r inside quotes stays. Empty
records are dropped, as Spark's reader does. A quoted field left open ends with its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillet.session import configure, scratch_dir

#: Splits of one read; their table is broadcast.
MAX_SPLITS = 1_000_000
SPLIT = ["file", "block"]
_PIECES = "file string, block long, part int, text string"
#: What a piece is: a whole record, the lines before a split's first record, or its last record, not ended.
WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", "\n").text(path).select(*place, "value")


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a split begins inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy(*SPLIT).agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*SPLIT, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _frame(header: bool):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, open_, begun, lines, out = None, False, False, [], []

        def emit(part: int) -> None:
            if lines and not (header and split[1] == 0 and first[0] and part != HEAD):
                out.append((*split, part, "\n".join(lines)))
            elif lines and part == TAIL:
                out.append((*split, part, None))  # a header that crosses the border
            if lines and part != HEAD:
                first[0] = False
            lines.clear()

        def finish() -> None:
            if split is not None:
                emit(TAIL if open_ and begun else HEAD if not begun else WHOLE)

        first = [True]
        for batch in batches:
            for file, block, value, inside in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (file, block) != split:
                    finish()
                    split, open_, begun, first[0] = (file, block), inside, not inside, True
                lines.append(value)
                open_ ^= value.count('"') % 2 == 1
                if not open_:
                    emit(WHOLE if begun else HEAD)
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.field(i).type) for i in range(4)], schema=schema)
            out.clear()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.field(i).type) for i in range(4)], schema=schema)

    return run


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(file, text): the text of every record of the CSV files under ``path``, line breaks in quotes included."""
    configure(spark)
    lines = _lines(spark, path)
    folder = scratch_dir(spark, "csv")
    _starts(lines).write.parquet(f"{folder}/splits")
    starts = spark.read.schema("file string, block long, inside boolean").parquet(f"{folder}/splits")
    if starts.limit(MAX_SPLITS + 1).count() > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits: raise spark.sql.files.maxPartitionBytes or read fewer files at once")
    # The broadcast join keeps the lines in their splits and in order.
    framed = lines.join(F.broadcast(starts), SPLIT).select(*SPLIT, "value", "inside").mapInArrow(_frame(header), _PIECES)
    framed.write.partitionBy("part").parquet(f"{folder}/pieces")
    pieces = spark.read.schema(_PIECES).parquet(f"{folder}/pieces")
    whole = pieces.where(F.col("part") == WHOLE).select("file", "text")
    # A head goes to the last tail before it in its file; texts take no part in finding that out.
    edges = pieces.where(F.col("part") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "part")
    chains = edges.select(*SPLIT, "part", F.sum(F.when(F.col("part") == TAIL, 1).otherwise(0)).over(order).alias("chain"))
    joined = (
        edges.join(chains, [*SPLIT, "part"])
        .groupBy("file", "chain")
        .agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("own"), F.count("text").alias("n"), F.count(F.lit(1)).alias("all"))
        .where("n = all")  # else it is the header
        .select("file", F.array_join("own.text", "\n").alias("text"))
    )
    every = whole.union(joined).withColumn("text", F.regexp_replace("text", "\r\\z", ""))
    return every.where("text <> ''")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, **options) -> DataFrame:
    """The rows of large CSV files with quoted line breaks; ``options`` are those of ``from_csv``."""
    if not isinstance(schema, str):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parse = {"multiLine": "true", "escape": '"', **options}
    return csv_records(spark, path, header).select(F.from_csv("text", schema, parse).alias("r")).select("r.*")
