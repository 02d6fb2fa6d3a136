"""Reading a growing folder of JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrace.sources import jsonl
from lifetrace.streaming.runs import write_batch


def stream_lines(spark: SparkSession, folder: str, trace_pattern: str) -> DataFrame:
    """Lines of the files as they arrive."""
    text = spark.readStream.schema("value string").option("lineSep", "\n").option(
        "recursiveFileLookup", "true"
    ).format("text").load(folder)
    file_path = F.col("_metadata.file_path")
    return text.select(
        F.regexp_extract(file_path, trace_pattern, 1).alias("trace_id"),
        file_path.alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.btrim("value", F.lit(" \t\r")).alias("line"),
    ).filter("line <> '' and not startswith(line, '#')")


def decode_sink(out: str):
    """A foreachBatch sink decoding the lines of each batch.

    (path, start, row) then orders the lines of a file as in a batch read.
    """

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_row", F.monotonically_increasing_id())
        write_batch(jsonl.decoded_once(rows), out, number)

    return sink
