"""Clamped time, timelines and live totals on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrace.plans import prefix
from lifetrace.plans.small import per_trace
from lifetrace.streaming.runs import previous, write_batch

WIDE = "decimal(38,0)"  # sums of bytes


def clamp_sink(out: str, state: str):
    """A foreachBatch sink writing events with clamped time.

    Inside a batch the running maximum is a blocked scan; between batches one
    number per trace is kept. Nothing late is dropped, it is clamped.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = f"trace_id string, top {batch.schema['t'].dataType.simpleString()}"
        before = per_trace(previous(spark, state, number, schema))
        rows = prefix.scan(
            batch, ["trace_id"], ["ord"], prefix.block_of("ord"), [prefix.Run("_t", "max", F.col("t"))]
        ).join(before, "trace_id", "left")
        clamped = F.coalesce(F.greatest("_t", "top"), F.lit(0))
        write_batch(rows.select("trace_id", "ord", F.col("t").alias("t_raw"), clamped.alias("t")), out, number)
        now = batch.groupBy("trace_id").agg(F.max("t").alias("_new")).join(before, "trace_id", "full_outer")
        write_batch(now.select("trace_id", F.greatest("_new", "top").alias("top")), state, number)

    return sink


def timeline_stream(events: DataFrame, width: int, domain: str = "seq", watermark: tuple | None = None) -> DataFrame:
    """Counts and bytes per fixed-width bin, in update mode.

    Without a watermark no row is ever too late. ``watermark`` (column, delay)
    bounds the state where dropping late rows is acceptable.
    """
    if watermark is not None:
        events = events.withWatermark(*watermark)
    op, hit = F.col("op"), F.col("target").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return events.groupBy(
        "trace_id", F.floor(F.col(domain) / width).cast("bigint").alias("bin")
    ).agg(
        n(op == "M").alias("allocations"), n((op == "F") & hit).alias("frees"),
        n(op == "R").alias("reallocations"), n(op == "E").alias("custom_events"),
        F.coalesce(F.sum(F.when(op.isin("M", "R"), F.col("size").cast(WIDE))), F.lit(0)).alias("allocated_bytes"),
        F.coalesce(F.sum(F.col("target_size").cast(WIDE)), F.lit(0)).alias("freed_bytes"),
    )


def totals_stream(events: DataFrame) -> DataFrame:
    """Live count and bytes per trace after each batch, in update mode."""
    born, ended = F.col("op").isin("M", "R"), F.col("target").isNotNull()
    return events.groupBy("trace_id").agg(
        F.sum(born.cast("bigint") - ended.cast("bigint")).alias("live_count"),
        F.sum(
            F.when(born, F.col("size").cast(WIDE)).otherwise(0) - F.coalesce(F.col("target_size").cast(WIDE), F.lit(0))
        ).alias("live_bytes"),
        F.max("seq").alias("last_seq"),
    )


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The last value written for each key over the batches of an update sink."""
    values = [c for c in batches.columns if c not in (*keys, "batch")]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(
        *keys, *[F.col(f"_v.{v}").alias(v) for v in values]
    )
