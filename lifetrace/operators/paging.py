"""O rows: total orders over allocations, pages, compact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.functions.u64 import byte_sum
from lifetrace.operators import annotate
from lifetrace.plans.prefix import dense_index

# Every order ends in (trace_id, creator), so pages never depend on chance.
ORDERS = {
    "creator-asc": lambda: [],
    "birth-desc": lambda: [F.col("creator").desc()],
    "size-desc": lambda: [F.col("size").desc()],
    "lifetime-desc": lambda: [F.col("lifetime").desc_nulls_first()],
    "death-desc": lambda: [F.col("death").desc_nulls_last()],
}
# Up to this place a page is a top-k sort; deeper ones read the numbered order.
SHALLOW = 10_000


def ordering(name: str) -> list[Column]:
    return [F.col("trace_id").asc(), *ORDERS[name](), F.col("creator").asc()]


def compact(
    allocations: DataFrame, notes: DataFrame | None = None, members: DataFrame | None = None
) -> DataFrame:
    """The short form of an allocation: no stack, no custom fields.

    With ``notes`` it carries its name and colour, with ``members`` its tags.
    """
    keep = "trace_id creator id addr size usable birth_t death death_t lifetime site thr".split()
    rows = allocations.select(*keep)
    rows = rows if notes is None else annotate.with_notes(rows, notes)
    return rows if members is None else annotate.with_tags(rows, members)


def positions(allocations: DataFrame, order: str) -> DataFrame:
    """Every allocation with its place in the order, from 0.

    One range shuffle sorts them; no task holds more than a part of the order.
    """
    return dense_index(allocations, [], ordering(order), "position")


def page(allocations: DataFrame, order: str, start: int = 0, limit: int = 100) -> DataFrame:
    """One page of an order, with its place, the total and the next start.

    The caller's limit is the limit. Near the top the sort keeps start + limit
    rows per task; a page further down is a range of ``positions``.
    """
    by = ordering(order)
    end = start + limit
    if end <= SHALLOW:
        rows = allocations.orderBy(*by).offset(start).limit(limit)
        placed = rows.withColumn(
            "position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)) - 1 + start
        )
    else:
        place = F.col("position")
        placed = positions(allocations, order).filter((place >= start) & (place < end))
    total = allocations.groupBy(F.lit(1).alias("_k")).agg(
        F.count(F.lit(1)).alias("matched"), byte_sum("size").alias("matched_bytes")
    )
    return (
        placed.withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")
        .withColumn("next", F.when(F.col("matched") > end, F.lit(end).cast("bigint")))
    )


def after(allocations: DataFrame, order: str, last: dict, limit: int = 100) -> DataFrame:
    """The page behind a row already shown: a filter instead of an offset.

    ``last`` holds trace_id, creator and the sort column of that row.
    """
    same_trace = F.col("trace_id") == last["trace_id"]
    beyond_trace = F.col("trace_id") > last["trace_id"]
    later = F.col("creator") > last["creator"]
    if order == "creator-asc":
        inside = later
    elif order == "birth-desc":
        inside = F.col("creator") < last["creator"]
    elif order == "size-desc":
        inside = (F.col("size") < last["size"]) | ((F.col("size") == last["size"]) & later)
    else:
        name = "lifetime" if order == "lifetime-desc" else "death"
        col, at = F.col(name), last[name]
        nulls_first = order == "lifetime-desc"
        if at is None:
            rest = col.isNull() & later
            inside = (rest | col.isNotNull()) if nulls_first else rest
        else:
            inside = (col < at) | ((col == at) & later)
            inside = inside if nulls_first else inside | col.isNull()
    keep = beyond_trace | (same_trace & inside)
    return allocations.filter(keep).orderBy(*ordering(order)).limit(limit)
