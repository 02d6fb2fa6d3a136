"""Joins on address intervals and lifetimes, as equi joins on dyadic bins.

An interval belongs to the smallest level (a power of 16) that holds its
width, so it touches at most two bins there however wide it is. A pair of
intersecting intervals meets at the higher of its two levels; the narrower one
is therefore also listed at the levels above its own that occur at all (a
handful: they are read off the data, at most 16 exist).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.functions.u64 import div_pow2, is_compact
from lifetrace.plans import prefix, skew
from lifetrace.plans.small import per_trace
from lifetrace.session import staged

STEP = 4  # bits per level
PAIR_LIMIT = 64  # a bin joins by pairs while its smaller side is within this
PART_ROWS = 200_000  # rows of a bin's larger side that one task pairs
PARTS_BROADCAST = 100_000  # bins in several parts that are sent to every task
CELLS_BROADCAST = 400_000  # cells that are sent to every task
MERGE_POINTS = 8192  # points looked at to choose the levels of addresses
MERGE_ALIVE = 32  # a level joins the one above while so many of it are alive beside a point
STAND_INS = 14  # a stand-in is looked for among the next 2^13 of a start
SLAB_ROWS = 64  # births in a slab of a crowded cell
SLABS = 1 << 16  # slabs of one cell
SLAB_PAIRS = 16  # a slab joins by pairs while its smaller side is within so many times the limit
OPEN = 63  # time level of lifetimes that never end
TREE = 2  # bits per level of the time tree
# Rows listed once per level are many times what the planner takes them for, and a side it
# takes for small would go through the driver; the joins of listed rows are told to shuffle.
SHUFFLED = "merge"


def level_of(width: Column) -> Column:
    """Smallest multiple of STEP bits (at least STEP) that holds ``width``."""
    bits = F.length(F.bin(F.greatest((width - 1).cast("bigint"), F.lit(1).cast("bigint"))))
    return (F.ceil(bits / F.lit(float(STEP))) * STEP).cast("int")


def levels_in(df: DataFrame, level: Column) -> list[int]:
    """The levels that occur: at most 17 numbers."""
    return sorted(r[0] for r in df.select(level.alias("l")).distinct().collect() if r[0] is not None)


def _per_level(levels: list[int], make) -> Column:
    return F.flatten(F.array(*[make(level) for level in levels]))


def _bins_at(addr: Column, last: Column, level: int, compact: bool) -> tuple[Column, Column]:
    if level > 62:
        zero = F.lit(0).cast("bigint")
        return zero, zero
    return div_pow2(addr, level, compact), div_pow2(last, level, compact)


def _shift(value: Column, level: Column) -> Column:
    """value div 2^level for a level that differs from row to row."""
    return F.when(level > 62, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftright", value, level)
    )


def _own_bins(levels: list[int], compact: bool) -> tuple[Column, Column]:
    """First and last bin of a row's interval at its own level."""
    own = F.col("_lv")
    if compact:
        return _shift(F.col("addr"), own), _shift(F.col("_last"), own)
    lo, hi = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for level in levels:
        first, last = _bins_at(F.col("addr"), F.col("_last"), level, compact)
        lo, hi = F.when(own == level, first).otherwise(lo), F.when(own == level, last).otherwise(hi)
    return lo, hi


def _spread(df: DataFrame, cells: list[Column], names: list[str]) -> DataFrame:
    """One row per cell that is not null; plain structs keep to compiled code."""
    return (
        df.withColumn("_cell", F.explode(F.array(*cells)))
        .filter("_cell is not null")
        .select("*", *[f"_cell.{n}" for n in names])
        .drop("_cell")
    )


def listed(df: DataFrame, levels: list[int], compact: bool) -> DataFrame:
    """One row per (level >= own, bin) an address interval touches."""
    own = F.col("_lv")
    cells = []
    for level in levels:
        lo, hi = _bins_at(F.col("addr"), F.col("_last"), level, compact)
        cell = lambda b: F.struct(
            F.lit(level).alias("level"), b.alias("bin"), (own == level).alias("own")
        )
        cells += [F.when(own <= level, cell(lo)), F.when((own <= level) & (hi != lo), cell(hi))]
    return _spread(df, cells, ["level", "bin", "own"]).drop("_lv", "_last")


def listed_own(df: DataFrame, levels: list[int], compact: bool) -> DataFrame:
    """The same at the own level alone."""
    lo, hi = _own_bins(levels, compact)
    cell = lambda b: F.struct(F.col("_lv").alias("level"), b.alias("bin"))
    return _spread(df, [cell(lo), F.when(hi != lo, cell(hi))], ["level", "bin"]).drop("_lv", "_last")


def _with_levels(df: DataFrame, compact: bool) -> DataFrame:
    one = F.lit(1).cast(df.schema["addr"].dataType)
    last = F.greatest(F.col("end_span") - one, F.col("addr")).cast(df.schema["addr"].dataType)
    return df.withColumn("_last", last).withColumn(
        "_lv", level_of((F.col("end_span") - F.col("addr")))
    )


CELL = ["trace_id", "side", "level", "bin"]
TIMED = [*CELL, "tlevel", "tbin"]


def births_in_live(
    allocations: DataFrame, pair_limit: int = PAIR_LIMIT, hot_rows: int = skew.HOT_ROWS,
    block_bits: int = prefix.BLOCK_BITS,
) -> DataFrame:
    """Allocations whose interval meets another one live at their birth.

    First, allocations of one start are settled among themselves, see
    ``_same_start``. Three steps follow, each only for what the one before leaves
    over. Address bins where one side is small join by pairs, at most ``pair_limit``
    per row of the larger side. In the other bins lifetimes are binned as well, so an
    address used again and again only meets the uses near in time. What is
    still crowded then is stacked up alive at one place; it forms no pairs but
    goes through ``_stacked``, which sorts. Usually the second and third step
    find nothing and are not planned.
    """
    compact = is_compact(allocations)
    slim = staged(
        _with_levels(_same_start(allocations, hot_rows, block_bits), compact), "starts"
    )
    over = slim.filter("_asks or _counts")
    levels = levels_in(over, F.col("_lv"))
    kept = ("trace_id", "creator", "addr", "end_span")
    met = slim.filter("not _asks").select(*kept)
    if not levels:
        return met
    rows = listed(over, levels, compact)
    # side 0: the live one is at its own level; side 1: the newborn is, and
    # the live one is narrower. Each intersecting pair meets on one side.
    newborn = rows.filter("_asks").select(
        "trace_id", "level", "bin", "creator", "addr", "end_span",
        F.explode(F.when(F.col("own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("side"),
    )
    living = rows.filter("_counts").select(
        "trace_id", "level", "bin", F.col("creator").alias("b_creator"),
        F.col("addr").alias("b_addr"), F.col("end_span").alias("b_end"), "death",
        F.when(F.col("own"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
    )
    more, newborn, living = _paired(newborn, living, CELL, pair_limit)
    met = met.unionByName(more)
    if newborn is not None:
        newborn, living = _timed(newborn, living)
        more, newborn, living = _paired(newborn, living, TIMED, pair_limit)
        met = met.unionByName(more)
    if newborn is not None:
        met = met.unionByName(
            _stacked(
                newborn.drop("tlevel", "tbin").distinct(), living.drop("tlevel", "tbin").distinct(),
                allocations,
            )
        )
    return met.distinct()


def _same_start(allocations: DataFrame, hot_rows: int, block_bits: int) -> DataFrame:
    """Each allocation, whether it still has to be asked for (``_asks``), and whether
    others have to be asked about it (``_counts``).

    Two allocations of one start intersect, so one that is born while an older one
    of its start lives has met it. And whoever meets one that an older one of its
    start, never freed and no shorter, goes along with meets that one too. Both
    are running maxima along births: an address used again and again leaves a few
    rows, however many are stacked up there.
    """
    keys = ["trace_id", "addr"]
    rows = allocations.select("trace_id", "creator", "addr", "end_span", "death")
    hot = skew.hot_keys(rows, keys, rows.count(), "creator", hot_rows)
    marked = skew.mark_hot(rows, keys, hot)
    until = F.coalesce("death", F.lit((1 << 63) - 1))
    scanned = prefix.scan(
        marked, keys, ["creator"], skew.hot_block(prefix.block_of("creator", block_bits)),
        [
            prefix.Run("_until", "max", until, inclusive=False),
            prefix.Run("_reach", "max", F.when(F.col("death").isNull(), F.col("end_span")), inclusive=False),
        ],
        carried=F.col("_hot"),
    )
    return scanned.select(
        *rows.columns,
        F.coalesce(F.col("_until") <= F.col("creator"), F.lit(True)).alias("_asks"),
        F.coalesce(F.col("_reach") < F.col("end_span"), F.lit(True)).alias("_counts"),
    )


def _met_at_birth() -> Column:
    return (
        (F.col("b_creator") < F.col("creator"))
        & (F.col("death").isNull() | (F.col("death") > F.col("creator")))
        & (F.col("b_addr") < F.col("end_span"))
        & (F.col("b_end") > F.col("addr"))
    )


def _paired(
    newborn: DataFrame, living: DataFrame, cell: list[str], limit: int, meets=_met_at_birth,
    kept: tuple[str, ...] = ("trace_id", "creator", "addr", "end_span"), by: tuple[str, str] = ("creator", "b_creator"),
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Matches from the cells with a small side, and the rows of the others.

    Where the other side is large it is dealt over parts of the cell, and the
    at most ``limit`` rows of the small side are copied to each of them.
    """
    counted = staged(
        newborn.select(*cell, F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(living.select(*cell, F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(*cell)
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .filter((F.least("a", "b") > limit) | (F.greatest("a", "b") > PART_ROWS)),
        "large-bins",
    )
    crowded = counted.filter(F.least("a", "b") > limit).select(*cell)
    large = counted.filter(F.least("a", "b") <= limit).select(
        *cell, F.ceil(F.greatest("a", "b") / PART_ROWS).cast("int").alias("_parts"), (F.col("a") > F.col("b")).alias("_born")
    )
    n_large = large.count()
    left_over = not crowded.isEmpty()
    some, others = newborn, living
    if left_over:
        some = newborn.join(crowded, cell, "left_anti")
        others = living.join(crowded, cell, "left_anti")
    key = cell
    if n_large:
        key = [*cell, "_part"]
        large = F.broadcast(large) if n_large <= PARTS_BROADCAST else large
        some = _in_parts(some, large, cell, by[0], F.col("_born"))
        others = _in_parts(others, large, cell, by[1], ~F.col("_born"))
    met = some.join(others.hint(SHUFFLED), key).filter(meets()).select(*kept)
    if not left_over:
        return met, None, None
    return (
        met,
        newborn.join(crowded, cell, "left_semi"),
        living.join(crowded, cell, "left_semi"),
    )


def _in_parts(rows: DataFrame, large: DataFrame, cell: list[str], by: str, dealt: Column) -> DataFrame:
    """Rows with the part of their cell: one where ``dealt``, else every part."""
    one = F.array(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    part = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(dealt, one).otherwise(every)
    return rows.join(large, cell, "left").withColumn("_part", F.explode(part)).drop("_parts", "_born")


def _timed(newborn: DataFrame, living: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with time bins: a lifetime touches at most two of its level,
    a birth is one point on each level that occurs."""
    level = lifetime_level(F.col("b_creator"), F.col("death"))
    leveled = living.withColumn("tlevel", level)
    present = levels_in(leveled, F.col("tlevel"))
    first, last = _shift(F.col("b_creator"), F.col("tlevel")), _shift(F.col("death"), F.col("tlevel"))
    points = F.array(
        *[
            F.struct(
                F.lit(x).alias("tlevel"),
                (F.lit(0).cast("bigint") if x == OPEN else F.shiftright("creator", x)).alias("tbin"),
            )
            for x in present
        ]
    )
    born = newborn.withColumn("_t", F.explode(points)).select("*", "_t.tlevel", "_t.tbin").drop("_t")
    ends = [F.struct(first.alias("tbin")), F.when(last != first, F.struct(last.alias("tbin")))]
    return born, _spread(leveled, ends, ["tbin"])


def _stacked(newborn: DataFrame, living: DataFrame, allocations: DataFrame) -> DataFrame:
    """The same test by sorting, for any number of rows at one place.

    A lifetime is a few nodes of a tree over the order of events, a birth is
    one node per level. Inside a node every live interval covers every birth,
    so time is settled and one running maximum along addresses is left: a
    newborn meets some live interval when the furthest end among those that
    start below its own end lies beyond its start.
    """
    top = int(allocations.agg(F.greatest(F.max("creator"), F.max("death"))).first()[0]) + 2
    depth = 0
    while (1 << (TREE * depth)) < top:
        depth += 1
    lo = F.col("b_creator") + 1
    hi = F.coalesce(F.col("death"), F.lit(top).cast("bigint"))

    def cover(level: int) -> Column:
        width = F.lit(1 << (TREE * level)).cast("bigint")
        up = F.lit(1 << (TREE * (level + 1))).cast("bigint")
        div = lambda x, y: F.call_function("div", x, y)
        first, stop = div(lo + width - 1, width), div(hi, width)
        pfirst, pstop = div(lo + up - 1, up) * (1 << TREE), div(hi, up) * (1 << TREE)
        inside = pfirst < pstop
        none = F.array().cast("array<bigint>")
        span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
        nodes = F.when(
            inside, F.concat(span(first, pfirst), span(pstop, stop))
        ).otherwise(span(first, stop))
        return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("tlevel"), n.alias("node")))

    inserts = living.withColumn(
        "_n", F.explode(_per_level(list(range(depth + 1)), cover))
    ).select(
        *CELL, "_n.tlevel", "_n.node", F.col("b_addr").alias("pos"), F.lit(1).alias("kind"),
        F.col("b_creator").alias("who"), F.col("b_end").alias("reach"), F.lit(None).cast(
            living.schema["b_addr"].dataType).alias("start"),
    )
    asks = newborn.withColumn(
        "_n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("tlevel"), F.shiftright("creator", TREE * k).alias("node")
                    )
                    for k in range(depth + 1)
                ]
            )
        ),
    ).select(
        *CELL, "_n.tlevel", "_n.node", F.col("end_span").alias("pos"), F.lit(0).alias("kind"),
        F.col("creator").alias("who"),
        F.lit(None).cast(newborn.schema["addr"].dataType).alias("reach"), F.col("addr").alias("start"),
    )
    node = [*CELL, "tlevel", "node"]
    order = [*node, "pos", "kind", "who"]
    placed = prefix.dense_index(inserts.unionByName(asks).withColumn("_one", F.lit(0)), ["_one"], order, "place")
    reached = prefix.scan(
        placed, node, ["place"], prefix.block_of("place"),
        [prefix.Run("furthest", "max", F.col("reach"), inclusive=False)],
    )
    return reached.filter((F.col("kind") == 0) & (F.col("furthest") > F.col("start"))).select(
        "trace_id", F.col("who").alias("creator"), F.col("start").alias("addr"),
        F.col("pos").alias("end_span"),
    )


def lifetime_level(creator: Column, death: Column) -> Column:
    return F.when(death.isNull(), F.lit(OPEN)).otherwise(level_of(death - creator + 1))


def best_occupants(
    points: DataFrame, allocations: DataFrame, keys: list[str], pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """Per point (trace_id, ``keys``) the latest born and the nearest cover.

    ``points`` has p_addr and p_pos (events applied). A point is listed once for each
    level of ``_merged_levels``, most often once in all, and cells with a small side
    join by pairs. In the others only those count that no later one stands in for
    (``_needed``), and time is cut into slabs, as many as leave an allocation in three
    of them on average: a point is in one slab. What is stacked up alive in a slab
    makes no pairs: see ``_best_by_nodes``. The result is ``newest`` (creator) and
    ``near`` (addr, creator); uncovered points are absent.
    """
    compact = is_compact(allocations)
    slim = _with_levels(
        allocations.select("trace_id", "creator", "addr", "end_span", "death"), compact
    )
    best = [F.max("creator").alias("newest"), F.max(F.struct("addr", "creator")).alias("near")]
    asked = points.select("trace_id", *keys, "p_addr", "p_pos")
    levels = levels_in(slim, F.col("_lv"))
    if not levels:
        return asked.join(slim, ["trace_id"]).groupBy("trace_id", *keys).agg(*best)
    merged = _merged_levels(asked, slim, levels, compact)
    used = sorted(set(merged.values()))
    cell = ["trace_id", "level", "bin"]
    left = _by_start(asked, used, compact, "p_addr")
    lv = F.element_at(F.create_map(*[F.lit(x) for kv in merged.items() for x in kv]), F.col("_lv"))
    right = listed_own(slim.withColumn("_lv", lv), used, compact).withColumnRenamed("death", "until")
    full = _cells(right.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pair_limit), cell)
    crowded = full and _cells(
        left.join(full, cell, "left_semi").groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pair_limit), cell
    )
    slab = F.lit(0).cast("bigint")
    stacked = None
    if crowded is None:
        left, right = left.withColumn("slab", slab), right.withColumn("slab", slab)
    else:
        needed = staged(_needed(right.join(crowded, cell, "left_semi"), cell, slim.count()), "needed")
        top = points.agg(F.max("p_pos")).first()[0]
        left, dense = _in_slabs(left, needed, cell, int(top))
        right = right.join(crowded, cell, "left_anti").withColumn("slab", slab).unionByName(dense)
        cell = [*cell, "slab"]
        stacked = _cells(
            left.join(crowded, cell[:-1], "left_semi").select(*cell, F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(dense.select(*cell, F.lit(0).alias("a"), F.lit(1).alias("b")))
            .groupBy(*cell).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
            .filter(F.least("a", "b") > SLAB_PAIRS * pair_limit),
            cell,
        )
    few, others = left, right
    if stacked is not None:
        few, others = left.join(stacked, cell, "left_anti"), right.join(stacked, cell, "left_anti")
    found = (
        few.join(others.hint(SHUFFLED), [*cell, "slab"] if crowded is None else cell)
        .filter(
            (F.col("addr") <= F.col("p_addr"))
            & (F.col("end_span") > F.col("p_addr"))
            & (F.col("creator") < F.col("p_pos"))
            & (F.col("until").isNull() | (F.col("until") >= F.col("p_pos")))
        )
        .groupBy("trace_id", *keys).agg(*best)
    )
    if stacked is not None:
        rows = right.join(stacked, cell, "left_semi").select(
            "trace_id", "creator", "addr", "end_span", F.col("until").alias("death")
        )
        here = left.join(stacked, cell, "left_semi").select("trace_id", *keys, "p_addr", "p_pos").distinct()
        found = found.unionByName(
            _best_by_nodes(here, staged(rows.distinct(), "dense"), keys, compact)
        ).groupBy("trace_id", *keys).agg(F.max("newest").alias("newest"), F.max("near").alias("near"))
    return found


def _cells(counted: DataFrame, cell: list[str]) -> DataFrame | None:
    """The cells of ``counted`` as a stored table, sent to every task while they are
    few; None when there are none."""
    table = staged(counted.select(*cell), "cells")
    n = table.count()
    if not n:
        return None
    return F.broadcast(table) if n <= CELLS_BROADCAST else table


def _merged_levels(points: DataFrame, slim: DataFrame, levels: list[int], compact: bool) -> dict[int, int]:
    """For each level of addresses the one its allocations are listed at.

    Every level kept lists all points once more; a level listed higher up than its own
    lets a point meet more allocations. From the top, a level joins the one above it
    while the allocations alive beside a point there stay few, or at most double. A
    hash sample of the points decides, which cuts the work only.
    """
    if len(levels) == 1:
        return {levels[0]: levels[0]}
    some = points.select("trace_id", "p_addr", "p_pos").filter(
        F.pmod(F.xxhash64("trace_id", "p_addr", "p_pos"), F.lit(max(1, points.count() // MERGE_POINTS))) == 0
    )
    asks = per_trace(
        _by_start(some, levels, compact, "p_addr").groupBy("trace_id", "level", "bin").agg(F.count(F.lit(1)).alias("asks")),
        "asks",
    )
    ends = per_trace(
        slim.groupBy("trace_id").agg(
            F.min("creator").alias("_from"), F.max(F.greatest("creator", "death")).alias("_to")
        ),
        "ends",
    )
    alive = (F.coalesce("death", "_to") - F.col("creator")) / (F.col("_to") - F.col("_from") + 1)
    beside = (
        listed(slim.withColumn("_own", F.col("_lv")), levels, compact)
        .join(asks, ["trace_id", "level", "bin"]).join(ends, "trace_id")
        .groupBy("level", F.col("_own").alias("own")).agg(F.sum(alive * F.col("asks")).alias("n"))
    )
    n = {(r["level"], r["own"]): r["n"] or 0.0 for r in beside.collect()}
    sampled = max(1, some.count())
    merged: dict[int, int] = {}
    for own in reversed(levels):
        top = min(merged.values(), default=own)
        here = sum(n.get((top, x), 0.0) for x, at in merged.items() if at == top) / sampled
        fits = n.get((top, own), 0.0) / sampled <= max(MERGE_ALIVE, here)
        merged[own] = top if fits else own
    return merged


def _needed(
    rows: DataFrame, cell: list[str], count: int, hot_rows: int = skew.HOT_ROWS, block_bits: int = prefix.BLOCK_BITS
) -> DataFrame:
    """The rows with ``until`` brought forward to where a later one stands in for them.

    From its birth on, an allocation of the same start that is never freed and no
    shorter answers for every older one: it covers whatever those cover, and is newer
    and as near. The first such one is looked for among the next 1, 2, 4, ... of the
    start; taking a later birth than the first one's only keeps a row longer.
    """
    keys = [*cell, "addr"]
    hot = skew.hot_keys(rows, keys, count, "creator", hot_rows)
    if hot is None:
        return _stood_in(rows, keys)
    # A start too large for a task goes by blocks first; what is left over at their ends is little.
    marked = skew.mark_hot(rows, keys, hot).withColumn("_block", skew.hot_block(prefix.block_of("creator", block_bits)))
    local = staged(_stood_in(marked, [*keys, "_block"]).drop("_block"), "blocks")
    again = F.col("_hot") & F.col("until").isNull()
    return local.filter(~again).unionByName(_stood_in(local.filter(again), keys)).drop("_hot")


def _stood_in(rows: DataFrame, keys: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy("creator")
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_end = F.when(F.col("until").isNull(), F.col("end_span"))
    found = rows.withColumns({
        "_reach": F.lead(open_end).over(window), "_last": F.last("creator").over(whole),
        "_by": F.lit(None).cast("bigint"),
    })
    for k in range(STAND_INS):
        at = F.when(F.col("_reach") >= F.col("end_span"), F.coalesce(F.lead("creator", 1 << k).over(window), "_last"))
        found = found.withColumns({
            "_by": F.coalesce("_by", at),
            "_reach": F.greatest("_reach", F.lead("_reach", 1 << k).over(window)),
        })
    return found.withColumn("until", F.least("until", "_by")).drop("_reach", "_last", "_by")


def _in_slabs(left: DataFrame, needed: DataFrame, cell: list[str], top: int) -> tuple[DataFrame, DataFrame]:
    """Points with their slab (0 in other cells), and the needed rows of the crowded
    cells in every slab they are alive in.

    A cell has at most one slab per SLAB_ROWS births and per birth that is alive at a
    time, so its rows are listed three times on average at most, however long they live.
    """
    until = F.least("until", F.lit(top).cast("bigint"))
    needed = needed.filter(until > F.col("creator"))
    first = F.min("creator")
    alive = F.sum((until - F.col("creator")).cast("double")) / (F.lit(top) - first)
    slabs = F.greatest(F.lit(1.0), F.least(F.lit(float(SLABS)), F.count(F.lit(1)) / F.greatest(alive, F.lit(float(SLAB_ROWS)))))
    width = F.greatest((F.lit(top) - first) / slabs, F.lit(1.0))
    cut = staged(needed.groupBy(*cell).agg(F.ceil(F.log2(width)).cast("int").alias("_bits")), "slabs")
    cut = F.broadcast(cut) if cut.count() <= CELLS_BROADCAST else cut
    at = lambda c: F.call_function("shiftright", c, F.col("_bits"))
    points = left.join(cut, cell, "left").withColumn("slab", F.coalesce(at(F.col("p_pos")), F.lit(0).cast("bigint"))).drop("_bits")
    rows = needed.join(cut, cell).withColumn("slab", F.explode(F.sequence(at(F.col("creator") + 1), at(until)))).drop("_bits")
    return points, rows


def _cover(lo: Column, hi: Column, depth: int) -> Column:
    """[lo, hi) as (level, node) of a tree with TREE bits a level; a level has few."""

    def up(bits: int) -> Column:
        exact = lo.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) == 0
        return F.shiftright(lo, bits) + F.when(exact, 0).otherwise(1)

    def at(level: int) -> Column:
        bits = TREE * level
        first, stop = up(bits), F.shiftright(hi, bits)
        none = F.array().cast("array<bigint>")
        span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
        if level == depth:
            nodes = span(first, stop)
        else:
            p_first = F.shiftleft(up(bits + TREE), TREE)
            p_stop = F.shiftleft(F.shiftright(hi, bits + TREE), TREE)
            nodes = F.when(p_first < p_stop, F.concat(span(first, p_first), span(p_stop, stop))).otherwise(span(first, stop))
        return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("l"), n.alias("n")))

    return _per_level(list(range(depth + 1)), at)


def _best_by_nodes(points: DataFrame, dense: DataFrame, keys: list[str], compact: bool) -> DataFrame:
    """The same answer without pairs, for any number of rows at one place.

    An interval of addresses is a few nodes of a tree over addresses, a
    lifetime a few of a tree over positions; of all allocations that cover the
    same two nodes only the best ones are kept, by a partial aggregate. A point
    asks each pair of nodes above it, on the levels that occur, for at most one
    row.
    """
    # unsigned addresses beyond 63 bits keep their order and nodes when moved by 2^63
    whole = lambda c: F.col(c) if compact else (
        F.col(c).cast("decimal(38,0)") - F.lit(Decimal(1 << 63)).cast("decimal(38,0)")
    ).cast("bigint")
    latest, widest = dense.agg(F.max(F.greatest("creator", "death")), F.max(whole("end_span") - whole("addr"))).first()
    top = max(latest, points.agg(F.max("p_pos")).first()[0]) + 2
    stop = F.coalesce(F.col("death") + 1, F.lit(1 << int(top).bit_length()).cast("bigint"))
    deep = lambda n: min(-(-int(n).bit_length() // TREE), 62 // TREE)
    rows = dense.withColumn(
        "x", F.explode(_cover(whole("addr"), whole("end_span"), deep(widest)))
    ).withColumn("t", F.explode(_cover(F.col("creator") + 1, stop, deep(top))))
    nodes = staged(
        rows.groupBy("trace_id", "x", "t").agg(
            F.max("creator").alias("newest"), F.max(F.struct("addr", "creator")).alias("near")
        ).select("trace_id", F.col("x.l").alias("xl"), F.col("x.n").alias("xn"), F.col("t.l").alias("tl"), F.col("t.n").alias("tn"), "newest", "near"),
        "nodes",
    )
    levels = nodes.select("xl", "tl").distinct().collect()  # at most one per pair of tree levels
    asks = F.array(
        *[
            F.struct(
                F.lit(r["xl"]).alias("xl"), F.shiftright(whole("p_addr"), TREE * r["xl"]).alias("xn"),
                F.lit(r["tl"]).alias("tl"), F.shiftright(F.col("p_pos"), TREE * r["tl"]).alias("tn"),
            )
            for r in levels
        ]
    )
    return (
        points.select("trace_id", *keys, F.inline(asks))
        .join(nodes.hint(SHUFFLED), ["trace_id", "xl", "xn", "tl", "tn"])
        .groupBy("trace_id", *keys).agg(F.max("newest").alias("newest"), F.max("near").alias("near"))
    )


def innermost(children: DataFrame, holders: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Who holds each child: the innermost holder, and how many there are.

    ``children`` has trace_id, child (its position), i_addr and i_end; ``holders`` has
    trace_id, creator, addr and end_span. A holder is older than the child and covers
    all of it; the innermost one starts last, then ends first, then is the latest born.
    Children that nothing holds are absent.

    A holder is at least as wide as the child, so a child is listed by its start on
    every level that occurs, and each pair meets in one bin. Bins with a small side
    join by pairs; the others form none, see ``_held_by_nodes``.
    """
    compact = is_compact(holders)
    out = _with_levels(holders.select("trace_id", "creator", "addr", "end_span"), compact)
    levels = levels_in(out, F.col("_lv"))
    inner = children.select("trace_id", "child", "i_addr", "i_end")
    best = F.max(F.struct("addr", (-F.col("end_span")).alias("nearer"), "creator"))
    names = [F.count(F.lit(1)).alias("holders"), best.alias("best")]
    if not levels:
        found = inner.join(out, "trace_id").groupBy("trace_id", "child").agg(*names)
        return found.select("trace_id", "child", F.col("best.creator").alias("parent"), "holders")
    cell = ["trace_id", "level", "bin"]
    right = listed_own(out, levels, compact)
    left = _by_start(inner, levels, compact)
    met, left, right = _paired(
        left, right, cell, pair_limit, _holds, ("trace_id", "child", "addr", "end_span", "creator"), ("child", "creator")
    )
    found = met.groupBy("trace_id", "child").agg(*names)
    if left is not None:
        found = found.unionByName(_held_by_nodes(left, right, cell)).groupBy("trace_id", "child").agg(
            F.sum("holders").alias("holders"), F.max("best").alias("best")
        )
    return found.select("trace_id", "child", F.col("best.creator").alias("parent"), "holders")


def contained(children: DataFrame, holders: DataFrame) -> DataFrame:
    """Every pair of a child and one that holds it, as (trace_id, creator, child).

    The rules are those of ``innermost``. The result itself has a row per pair; a bin's
    larger side is dealt over parts of PART_ROWS rows, so one place is many tasks.
    """
    compact = is_compact(holders)
    out = _with_levels(holders.select("trace_id", "creator", "addr", "end_span"), compact)
    levels = levels_in(out, F.col("_lv"))
    inner = children.select("trace_id", "child", "i_addr", "i_end")
    if not levels:
        return inner.join(out, "trace_id").select("trace_id", "creator", "child")
    met, _, _ = _paired(
        _by_start(inner, levels, compact), listed_own(out, levels, compact), ["trace_id", "level", "bin"],
        (1 << 63) - 1, _holds, ("trace_id", "creator", "child"), ("child", "creator"),
    )
    return met


def _by_start(children: DataFrame, levels: list[int], compact: bool, start: str = "i_addr") -> DataFrame:
    """Each child once per level, in the bin of its start."""
    starts = F.array(
        *[
            F.struct(F.lit(lv).alias("level"), _bins_at(F.col(start), F.col(start), lv, compact)[0].alias("bin"))
            for lv in levels
        ]
    )
    return children.select("*", F.inline(starts))


def _holds() -> Column:
    return (
        (F.col("creator") < F.col("child"))
        & (F.col("addr") <= F.col("i_addr"))
        & (F.col("end_span") >= F.col("i_end"))
    )


def _held_by_nodes(children: DataFrame, holders: DataFrame, cell: list[str]) -> DataFrame:
    """The same without pairs, for any number of holders stacked at one place.

    Both sides are ranked by birth and by end, so that the holders of a child are
    those with smaller ranks. The ranks below a number are a few nodes of a binary
    tree, left children all, and a rank is below a few of those. In a pair of nodes
    age and end are settled; what is left is a running count, and a running best,
    along the addresses: N log^2 N rows in all.
    """
    row = lambda df, side, who, addr, end: df.select(
        *cell, F.lit(side).alias("side"), F.col(who).alias("who"), F.col(addr).alias("addr"), F.col(end).alias("end"),
    )
    rows = row(holders, 0, "creator", "addr", "end_span").unionByName(row(children, 1, "child", "i_addr", "i_end"))
    # at one position the child comes first, at one end the holder does
    rows = rows.withColumns({"_one": F.lit(0), "_nearer": -F.col("end"), "_before": -F.col("side")})
    ranked = dense(rows, ["who", "_before"], "_age")
    ranked = dense(ranked, ["_nearer", "side", "who"], "_reach")
    ranked = staged(ranked, "ranked")
    bits = max(1, int(ranked.count()).bit_length())

    def nodes(rank: str, level: str, node: str) -> Column:
        at = lambda k: F.call_function("shiftright", F.col(rank), k)
        right = lambda k: at(k).bitwiseAND(1) == F.col("side")
        every = F.filter(F.lit(list(range(bits))), right)
        return F.transform(every, lambda k: F.struct(k.alias(level), (at(k) - F.col("side")).alias(node)))

    placed = (
        ranked.select("*", F.inline(nodes("_age", "_al", "_an")))
        .select("*", F.inline(nodes("_reach", "_rl", "_rn")))
        .select(*cell, "_al", "_an", "_rl", "_rn", "addr", "side", "who", "_nearer", "_one")
    )
    node = [*cell, "_al", "_an", "_rl", "_rn"]
    placed = dense(placed, [*node, "addr", "side", "who"], "_place")
    holder = F.col("side") == 0
    best = F.struct("addr", F.col("_nearer").alias("nearer"), F.col("who").alias("creator"))
    reached = prefix.scan(
        placed, node, ["_place"], prefix.block_of("_place"),
        [
            prefix.Run("held", "sum", F.when(holder, 1).otherwise(0).cast("bigint"), inclusive=False),
            prefix.Run("best", "max", F.when(holder, best), inclusive=False),
        ],
    )
    return reached.filter((F.col("side") == 1) & (F.col("held") > 0)).groupBy(
        "trace_id", F.col("who").alias("child")
    ).agg(F.sum("held").alias("holders"), F.max("best").alias("best"))


def dense(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """All rows of ``df`` numbered along ``order`` (``_one`` is a constant column)."""
    return prefix.dense_index(df, ["_one"], order, out)


def covered(spans: DataFrame, holders: DataFrame) -> DataFrame:
    """The ``spans`` (trace_id, i_addr, i_end, more) that one holder covers whole.

    Along the starts, the furthest end so far decides: one blocked scan, no pairs.
    Holders of one start enter it as the furthest of them.
    """
    kind = holders.schema["addr"].dataType
    names = [c for c in spans.columns if c != "trace_id"]
    ends = holders.groupBy("trace_id", F.col("addr").alias("pos")).agg(F.max("end_span").alias("reach"))
    asked = spans.select("trace_id", F.col("i_addr").cast(kind).alias("pos"), F.struct(*names).alias("span"), F.monotonically_increasing_id().alias("no"))
    asked = staged(asked, "spans")
    none = F.lit(None).cast(asked.schema["span"].dataType)
    rows = ends.select("*", none.alias("span"), F.lit(-1).cast("bigint").alias("no")).unionByName(
        asked.withColumn("reach", F.lit(None).cast(kind))
    )
    rows = dense(rows.withColumn("_one", F.lit(0)), ["trace_id", "pos", "no"], "_place")
    scanned = prefix.scan(
        rows, ["trace_id"], ["_place"], prefix.block_of("_place"), [prefix.Run("furthest", "max", F.col("reach"))], levels=2
    )
    return scanned.filter(F.col("span").isNotNull() & (F.col("furthest") >= F.col("span.i_end"))).select("trace_id", "span.*")
