"""Running values over an order too long for one task.

A window over a whole trace would put that trace into one task. Here rows
carry a block number that grows with the order, so a window only ever holds
one block; one row of totals per block then carries the state across blocks.
The rows are shuffled once, on (keys, block); the totals are that much smaller
(rows / block size) and are joined back on the same columns, so the long side
is not moved again. Where an order has holes there may be as many blocks as
rows; the totals are then scanned in blocks themselves (``levels``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.session import staged

BLOCK_BITS = 16  # rows per block of a dense order, as bits
SPARSE_BITS = 20  # the same for addresses and other orders with holes

BLOCK = "_block"


@dataclass(frozen=True)
class Run:
    """One running value: ``agg`` is sum, max, min or last (non-null)."""

    out: str
    agg: str
    value: Column
    inclusive: bool = True


def block_of(order: str | Column, bits: int = BLOCK_BITS) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.shiftright(col.cast("bigint"), bits)


def _fold(run: Run, value: Column, order: Column) -> Column:
    if run.agg == "sum":
        return F.sum(value)
    if run.agg == "max":
        return F.max(value)
    if run.agg == "min":
        return F.min(value)
    return F.max_by(value, F.when(value.isNotNull(), order))


def _running(run: Run, value: Column, window) -> Column:
    end = Window.currentRow if run.inclusive else -1
    frame = window.rowsBetween(Window.unboundedPreceding, end)
    if run.agg == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min}[run.agg](value).over(frame)


def _combine(run: Run, before: Column, local: Column) -> Column:
    if run.agg == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    if run.agg == "max":
        return F.greatest(before, local)
    if run.agg == "min":
        return F.least(before, local)
    return F.coalesce(local, before)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    runs: list[Run],
    carried: Column | None = None,
    levels: int = 1,
) -> DataFrame:
    """Add running values over ``order`` inside ``keys``.

    ``block`` must not decrease along ``order``. ``carried`` marks the rows of
    keys that span several blocks; the others need no carry (None: all do).
    ``order`` must be unique inside ``keys``. With ``levels`` above 1 the block
    totals are scanned the same way, in blocks of 2^SPARSE_BITS blocks.
    """
    blocked = df.withColumn(BLOCK, block)
    window = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])

    local = blocked.select(
        "*", *[_running(r, r.value, window).alias(f"_l_{r.out}") for r in runs]
    )
    spanning = blocked if carried is None else blocked.filter(carried)
    totals = spanning.groupBy(*keys, BLOCK).agg(
        *[_fold(r, r.value, position).alias(f"_t_{r.out}") for r in runs]
    )
    if levels > 1:
        numbered = totals.withColumnRenamed(BLOCK, "_of")
        carry = scan(
            numbered, keys, ["_of"], block_of("_of", SPARSE_BITS),
            [Run(f"_c_{r.out}", r.agg, F.col(f"_t_{r.out}"), inclusive=False) for r in runs],
            levels=levels - 1,
        ).select(*keys, F.col("_of").alias(BLOCK), *[f"_c_{r.out}" for r in runs])
    else:
        earlier = Window.partitionBy(*keys).orderBy(BLOCK)
        carry = totals.select(
            *keys,
            BLOCK,
            *[
                _running(Run(r.out, r.agg, r.value, False), F.col(f"_t_{r.out}"), earlier).alias(
                    f"_c_{r.out}"
                )
                for r in runs
            ],
        )
    joined = local.join(carry, [*keys, BLOCK], "left")
    return joined.select(
        *df.columns,
        *[_combine(r, F.col(f"_c_{r.out}"), F.col(f"_l_{r.out}")).alias(r.out) for r in runs],
    )


def dense_index(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... along ``order``.

    One range shuffle on (keys, order) sorts the rows; the written table fixes
    which rows a partition holds; the number is then the partition's offset
    plus the place inside it. No task holds more than one range partition,
    however large a key is.
    """
    ranged = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    table = staged(ranged, "ordered").withColumn("_part", F.shiftright("_row", 33))
    return number_rows(table, keys, ["_part"], "_row", out)


OFFSETS_BROADCAST = 100_000  # offset rows small enough to send to every task


def number_rows(
    table: DataFrame, keys: list[str], parts: list[str], row: str, out: str
) -> DataFrame:
    """Dense numbers from (part, row id): rows of a part are consecutive ids.

    There is one offset per part and key inside it. Written and counted first,
    they are broadcast while there are few; else the join shuffles.
    """
    spans = table.groupBy(*keys, *parts).agg(
        F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(
        spans.select(
            *keys, *parts, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
        ),
        "offsets",
    )
    if offsets.count() <= OFFSETS_BROADCAST:
        offsets = F.broadcast(offsets)
    kept = [c for c in table.columns if c not in (*parts, row)]
    return table.join(offsets, [*keys, *parts]).select(
        *kept, (F.col("_base") + F.col(row) - F.col("_first")).alias(out)
    )
