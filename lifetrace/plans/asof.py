"""As-of joins: the latest earlier row, without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrace.plans import prefix


def latest_at_or_before(
    left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str]
) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row with on <= left's.

    Both sides are laid out in one order and the values run along it; no task
    sees more than a range partition, however many rows share a key. Rows of
    ``right`` that share (keys, on) should be reduced to one beforehand.
    """
    extra = [c for c in left.columns if c not in (*keys, on)]
    a = right.select(
        *keys, on, F.lit(0).alias("_side"), F.struct(*values).alias("_v"),
        F.lit(None).cast(left.select(F.struct(F.lit(1).alias("_"), *extra)).schema[0].dataType).alias("_l"),
    )
    b = left.select(
        *keys, on, F.lit(1).alias("_side"),
        F.lit(None).cast(a.schema["_v"].dataType).alias("_v"),
        F.struct(F.lit(1).alias("_"), *extra).alias("_l"),
    )
    placed = prefix.dense_index(a.unionByName(b), keys, [on, "_side"], "_place")
    run = prefix.scan(
        placed, keys, ["_place"], prefix.block_of("_place"),
        [prefix.Run("_found", "last", F.col("_v"))],
    )
    return run.filter("_side = 1").select(
        *keys, on, *[F.col(f"_l.{c}").alias(c) for c in extra],
        *[F.col(f"_found.{v}").alias(v) for v in values],
    )


def positions_at(times: DataFrame, events: DataFrame) -> DataFrame:
    """J8 for a table of times (trace_id, t): events with time <= t."""
    steps = events.groupBy("trace_id", "t").agg((F.max("seq") + 1).alias("n"))
    found = latest_at_or_before(times, steps, ["trace_id"], "t", ["n"])
    return found.withColumn("n", F.coalesce("n", F.lit(0)))
