"""The tables of a resolved set of traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("events", "allocations", "overlaps", "rejects", "headers", "fields")
_POSITION = {"events": "seq", "allocations": "creator"}


def write_table(df: DataFrame, path: str, name: str, spans: DataFrame | None = None) -> DataFrame:
    """Write one table, rows clustered by (trace_id, position), and read it.

    Clustering keeps the footers' min/max of the position tight, so a page, a
    context window or one trace reads only its own row groups. Traces are not
    directories: millions of small traces would be millions of files.

    With ``spans`` (trace_id, events) positions are known to be dense and a
    row's partition is computed from its own; otherwise range bounds are
    sampled, which runs the plan behind ``df`` twice.
    """
    if name in _POSITION:
        keys = ["trace_id", _POSITION[name]]
        if spans is None:
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        else:
            df = _placed(df, spans, keys[1]).sortWithinPartitions(*keys)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


ROWS_PER_FILE = 4_000_000
MIN_ROWS_PER_FILE = 32_768
SPANS_BROADCAST = 100_000


def _placed(df: DataFrame, spans: DataFrame, position: str) -> DataFrame:
    """Rows sent to the partition their place in all traces falls into."""
    spark = df.sparkSession
    traces, total = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum("events"), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(tasks, -(-total // MIN_ROWS_PER_FILE)), -(-total // ROWS_PER_FILE))
    starts = spans.select("trace_id", F.col("start").alias("_start"))
    starts = F.broadcast(starts) if traces <= SPANS_BROADCAST else starts
    place = (F.col("_start") + F.col(position)) * F.lit(parts).cast("bigint")
    part = F.call_function("div", place, F.lit(max(total, 1)).cast("bigint"))
    return (
        df.join(starts, "trace_id")
        .repartitionById(parts, F.least(part, F.lit(parts - 1)).cast("int"))
        .select(*df.columns)
    )


def trace_spans(lines: DataFrame) -> DataFrame:
    """(trace_id, events, start): the events of each trace and of those before.

    The running total goes over whole traces, in chunks by a hash so that no
    task sees them all.
    """
    sizes = lines.filter("ok").groupBy("trace_id").agg(F.count(F.lit(1)).alias("events"))
    sizes = sizes.withColumn("_chunk", F.pmod(F.hash("trace_id"), F.lit(1000)))
    chunks = sizes.groupBy("_chunk").agg(F.sum("events").alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_chunk").orderBy("trace_id").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("_in", F.coalesce(F.sum("events").over(inside), F.lit(0)))
    return local.join(offsets, "_chunk").select(
        "trace_id", "events", (F.col("_base") + F.col("_in")).alias("start")
    )


@dataclass
class Trace:
    """Resolved traces, one row set per table, all keyed by ``trace_id``.

    events       one row per accepted record, ``seq`` dense from 0; frees and
                 resizes carry the geometry of the allocation they end
    allocations  one row per creator, an interval [creator, death) in seq and
                 [addr, end_span) in address space
    overlaps     creators that met a live region when they were born
    rejects      lines that gave no event, with the reason
    headers      one row per trace
    fields       the catalog of custom fields, one row per trace and name

    Custom fields are kept as text (``extras``, ``death_extras``) and as VARIANT
    (``custom``, ``death_custom``).
    """

    events: DataFrame
    allocations: DataFrame
    overlaps: DataFrame
    rejects: DataFrame
    headers: DataFrame
    fields: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.events.sparkSession

    def save(self, path: str) -> "Trace":
        """Write every table to a new place and go on from there."""
        for name in TABLES:
            write_table(getattr(self, name), path, name)
        return Trace.load(self.spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Trace":
        return Trace(**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES})
