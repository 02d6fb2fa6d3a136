"""Finding keys too large for one task.

A key is split into blocks only when it is hot, so the usual key costs one
shuffle and no carry. The probe looks at one row in 1024 by hash; it decides
only how rows are spread over tasks, never which rows count, so a result is
the same whatever it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1 << 22  # a key above this many rows is split
SAMPLE = 1024
LIST_LIMIT = 20_000  # hot keys a plan may hold as a local list


def hot_keys(
    df: DataFrame, keys: list[str], rows: int, order: str, hot_rows: int = HOT_ROWS
) -> DataFrame | None:
    """Keys with about ``hot_rows`` rows or more, or None when there are none.

    ``rows`` is the known row count: below ``hot_rows`` nothing can be hot and
    no job is run. There are at most rows / hot_rows such keys.
    """
    if rows < hot_rows:
        return None
    rate = SAMPLE if hot_rows >= 64 * SAMPLE else 1
    sample = df if rate == 1 else df.filter(F.pmod(F.xxhash64(*keys, order), F.lit(rate)) == 0)
    counts = sample.groupBy(*keys).count().filter(F.col("count") >= max(hot_rows // rate // 2, 1))
    hot = counts.select(*keys).limit(LIST_LIMIT + 1).collect()
    if not hot:
        return None
    if len(hot) > LIST_LIMIT:
        return counts.select(*keys, F.lit(True).alias("_hot"))
    local = df.sparkSession.createDataFrame(hot, df.select(*keys).schema)
    return F.broadcast(local.withColumn("_hot", F.lit(True)))


def mark_hot(df: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return df.withColumn("_hot", F.lit(False))
    return df.join(hot, keys, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def hot_block(order: Column) -> Column:
    """Block number: the order's own block for a hot key, else one block."""
    return F.when(F.col("_hot"), order).otherwise(F.lit(0).cast("bigint"))
