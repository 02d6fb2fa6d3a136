"""M rows: the address space as rows of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.functions.u64 import int_div
from lifetrace.operators.live import live_at
from lifetrace.plans import prefix, ranges
from lifetrace.plans.expand import expanded
from lifetrace.plans.small import per_trace
from lifetrace.session import staged
from lifetrace.trace import Trace

# Fixed value: in M6, spans over more rows count with their first and last only.
ENDS_ONLY = 65536


def bases(trace: Trace, row_bytes: int) -> DataFrame:
    """M1: per trace the lowest address, down to a multiple of the row size."""
    seen = trace.allocations.groupBy("trace_id").agg(F.min("addr").alias("addr_min"))
    arena = F.when(F.col("arena_base") != 0, F.col("arena_base"))
    lowest = F.coalesce(F.least("addr_min", arena.cast(trace.allocations.schema["addr"].dataType)), F.lit(0))
    return per_trace(
        trace.headers.select("trace_id", "arena_base").join(seen, "trace_id").select(
            "trace_id", (lowest - lowest % row_bytes).alias("base")
        ),
        "bases",
    )


def placed(trace: Trace, row_bytes: int, allocations: DataFrame | None = None) -> DataFrame:
    """M1: first and last row of each allocation."""
    rows = allocations if allocations is not None else trace.allocations
    row = lambda a: int_div(
        F.greatest(a - F.col("base"), F.lit(0)), F.lit(row_bytes).cast("bigint")
    ).cast("bigint")
    return rows.join(bases(trace, row_bytes), "trace_id").withColumns(
        {"row_first": row(F.col("addr")), "row_last": row(F.col("end_span") - 1)}
    )


def segments(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Depth of cover between consecutive end points of [start, stop).

    Equal end points are summed before the shuffle, so a block of the order
    holds at most its width in distinct points however many intervals share
    them; each point closes the segment begun by the one before it.
    """
    edge = lambda c, by: F.struct(F.col(c).alias("pos"), F.lit(by).alias("by"))
    points = (
        df.select("trace_id", F.explode(F.array(edge(start, 1), edge(stop, -1))).alias("e"))
        .groupBy("trace_id", F.col("e.pos").alias("pos"))
        .agg(F.sum("e.by").alias("by"))
    )
    runs = [
        prefix.Run("depth", "sum", F.col("by"), inclusive=False),
        prefix.Run("begin", "last", F.col("pos"), inclusive=False),
    ]
    block = int_div(F.col("pos"), F.lit(1 << prefix.SPARSE_BITS).cast(points.schema["pos"].dataType))
    return prefix.scan(points, ["trace_id"], ["pos"], block.cast("bigint"), runs, levels=2).filter(
        "depth > 0"
    ).select("trace_id", F.col("begin").alias("start"), F.col("pos").alias("stop"), "depth")


def _marked(rows: DataFrame, ends_only: int | None = None) -> DataFrame:
    """Row intervals an allocation marks; with ``ends_only`` one over more rows only its ends."""
    if ends_only is None:
        return rows.select("trace_id", F.col("row_first").alias("r0"), (F.col("row_last") + 1).alias("r1"))
    wide = F.col("row_last") - F.col("row_first") > ends_only
    piece = lambda a, b: F.struct(a.alias("r0"), (b + 1).alias("r1"))
    first, last = F.col("row_first"), F.col("row_last")
    pieces = F.when(wide, F.array(piece(first, first), piece(last, last))).otherwise(
        F.array(piece(first, last))
    )
    return rows.select("trace_id", F.explode(pieces).alias("p")).select("trace_id", "p.r0", "p.r1")


def occupied_runs(trace: Trace, row_bytes: int, n: int | None = None) -> DataFrame:
    """M2, M3 as runs of rows [start, stop) of one depth, however wide."""
    rows = placed(trace, row_bytes)
    if n is not None:
        rows = rows.filter(live_at(n))
    return segments(_marked(rows), "r0", "r1")


def occupancy(trace: Trace, row_bytes: int, n: int | None = None) -> DataFrame:
    """M2: live allocations per row at position n; M3 (n None): over the trace.

    One row for each row of bytes; where only runs are wanted, read ``occupied_runs``.
    """
    runs = staged(occupied_runs(trace, row_bytes, n), "runs")
    rows = runs.select("trace_id", "start", (F.col("stop") - 1).alias("_last"), F.col("depth").alias("allocations"))
    return expanded(rows, "start", "_last", "row").select("trace_id", "row", "allocations")


def collapse_rows(collapse_bytes: int, row_bytes: int) -> int:
    """M5: a threshold in bytes as rows, at least one."""
    return max(-(-collapse_bytes // row_bytes), 1)


def layout(occupied: DataFrame, collapse_min: int, pins: DataFrame | None = None) -> DataFrame:
    """M4: the rows shown. Short empty runs are filled, long ones collapse.

    ``gaps_before`` counts the collapsed runs above a row; ``pins`` (trace_id,
    row) keeps rows that hold nothing.
    """
    rows = occupied.select("trace_id", "row")
    if pins is not None:
        rows = rows.unionByName(pins.select("trace_id", "row"))
    rows = rows.distinct()
    lagged = prefix.scan(
        rows, ["trace_id"], ["row"], prefix.block_of("row", prefix.SPARSE_BITS),
        [prefix.Run("above", "last", F.col("row"), inclusive=False)], levels=2,
    )
    empty = F.col("row") - F.col("above") - 1
    counted = prefix.scan(
        lagged.withColumn("_gap", F.when(empty >= collapse_min, 1).otherwise(0).cast("bigint")),
        ["trace_id"], ["row"], prefix.block_of("row", prefix.SPARSE_BITS),
        [prefix.Run("gaps_before", "sum", F.col("_gap"))], levels=2,
    )
    empty = F.col("row") - F.col("above") - 1
    filler = F.when(
        (empty > 0) & (empty < collapse_min), F.sequence(F.col("above") + 1, F.col("row"))
    ).otherwise(F.array("row"))
    return counted.select("trace_id", F.explode(filler).alias("shown"), "row", "gaps_before", "_gap").select(
        "trace_id", F.col("shown").alias("row"), "gaps_before", (F.col("shown") != F.col("row")).alias("filler"),
        ((F.col("shown") == F.col("row")) & (F.col("_gap") == 1)).alias("after_gap"),
    )


def gaps(runs: DataFrame, collapse_min: int) -> DataFrame:
    """Collapsed runs as (trace_id, above, below): the rows around each.

    ``runs`` are row intervals [start, stop); rows are never listed one by one.
    """
    lagged = prefix.scan(
        runs.select("trace_id", "start", "stop"), ["trace_id"], ["start"],
        prefix.block_of("start", prefix.SPARSE_BITS),
        [prefix.Run("_end", "last", F.col("stop"), inclusive=False)], levels=2,
    )
    return lagged.filter(F.col("start") - F.col("_end") >= collapse_min).select(
        "trace_id", (F.col("_end") - 1).alias("above"), F.col("start").alias("below")
    )


def covered_gaps(trace: Trace, row_bytes: int, n: int, collapse_min: int) -> DataFrame:
    """M6: collapsed runs that lie inside one live allocation.

    Only spans over ENDS_ONLY rows can hold an unmarked run; the others are
    filtered out before the join.
    """
    marked = segments(_marked(placed(trace, row_bytes).filter(live_at(n)), ENDS_ONLY), "r0", "r1")
    runs = gaps(marked, collapse_min).join(bases(trace, row_bytes), "trace_id")
    inner = runs.select(
        "trace_id", "above", "below",
        (F.col("base") + (F.col("above") + 1) * row_bytes).alias("i_addr"),
        (F.col("base") + F.col("below") * row_bytes).alias("i_end"),
    )
    live = trace.allocations.filter(live_at(n) & (F.col("span") >= row_bytes * collapse_min)).select(
        "trace_id", "creator", "addr", "end_span"
    )
    return ranges.covered(inner, live).select("trace_id", "above", "below")


def slices(trace: Trace, row_bytes: int, allocations: DataFrame) -> DataFrame:
    """M7: the byte range of each allocation inside each row it touches."""
    spans = placed(trace, row_bytes, allocations).select("trace_id", "creator", "addr", "end_span", "base", "row_first", "row_last")
    rows = expanded(spans, "row_first", "row_last", "row")
    start = F.col("base") + F.col("row") * row_bytes
    return rows.select(
        "trace_id", "creator", "row",
        (F.greatest(F.col("addr"), start) - start).cast("bigint").alias("lo"),
        (F.least(F.col("end_span"), start + row_bytes) - start).cast("bigint").alias("hi"),
    )


def shared_bytes(allocations: DataFrame, n: int) -> DataFrame:
    """M8: address segments that two or more live allocations cover."""
    return segments(allocations.filter(live_at(n)), "addr", "end_span").filter("depth >= 2")


def ghosts(trace: Trace, n: int, pair_limit: int = ranges.PAIR_LIMIT) -> DataFrame:
    """Allocations born inside a live one and already gone.

    One row per ghost: its innermost holder (``parent``) and how many hold it.
    Candidates are those that met a live region at birth; a holder is older and
    still live at the position.
    """
    return ranges.innermost(*_ghosts_and_holders(trace, n), pair_limit)


def ghost_pairs(trace: Trace, n: int) -> DataFrame:
    """J6 in full: one row per ghost (``child``) and each of its holders (``parent``)."""
    return ranges.contained(*_ghosts_and_holders(trace, n)).select(
        "trace_id", F.col("creator").alias("parent"), "child"
    )


def _ghosts_and_holders(trace: Trace, n: int) -> tuple[DataFrame, DataFrame]:
    born = trace.overlaps.select("trace_id", "creator")
    gone = (
        trace.allocations.filter(F.col("death") < n)
        .join(born, ["trace_id", "creator"], "left_semi")
        .select(
            "trace_id", F.col("creator").alias("child"), F.col("addr").alias("i_addr"),
            F.col("end_span").alias("i_end"),
        )
    )
    holders = trace.allocations.filter(live_at(n)).select("trace_id", "creator", "addr", "end_span")
    return gone, holders


def at_address(allocations: DataFrame, address: int, n: int) -> DataFrame:
    """J4 for one address: a filter the scan prunes by."""
    hit = live_at(n) & (F.col("addr") <= address) & (F.col("end_span") > address)
    return allocations.filter(hit).groupBy("trace_id").agg(*_chosen())


def _chosen() -> list[Column]:
    return [
        F.max("creator").alias("newest"),
        F.max_by("creator", F.struct("addr", "creator")).alias("nearest"),
    ]


def pick(points: DataFrame, allocations: DataFrame, keys: list[str]) -> DataFrame:
    """Who covers each point (trace_id, p_addr, p_pos, keys).

    ``newest`` is the latest born; ``nearest`` the one starting closest below.
    Points nothing covers are absent.
    """
    found = ranges.best_occupants(points, allocations, keys)
    return found.select("trace_id", *keys, "newest", F.col("near.creator").alias("nearest"))
