"""W rows, A2: running totals and the live set at a position.

Position n means "after n events". An allocation is live there when it was
born before and not yet ended: an interval test, no replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.plans import prefix, ranges, skew
from lifetrace.plans.expand import expanded
from lifetrace.plans.small import per_trace
from lifetrace.session import staged

WIDE = "decimal(38,0)"
PLAYHEADS_BROADCAST = 100_000  # cells of playheads that are sent to every task


def live_at(n: int | Column) -> Column:
    """Whether an allocation is live after n events."""
    n = F.lit(n).cast("bigint") if isinstance(n, int) else n
    return (F.col("creator") < n) & (F.col("death").isNull() | (F.col("death") >= n))


def live_at_time(t: int | Column) -> Column:
    """Live once every event with time <= t has been applied.

    Times never fall along the stream, so the position test turns into one on
    the two times.
    """
    t = F.lit(t) if isinstance(t, int) else t
    return (F.col("birth_t") <= t) & (F.col("death_t").isNull() | (F.col("death_t") > t))


def deltas(events: DataFrame) -> DataFrame:
    """Change of live count and bytes per event; a resize does both at once."""
    born, ended = F.col("op").isin("M", "R"), F.col("target").isNotNull()
    return events.select(
        "trace_id", "seq", "t", "op",
        (born.cast("bigint") - ended.cast("bigint")).alias("d_count"),
        (
            F.when(born, F.col("size").cast(WIDE)).otherwise(F.lit(0).cast(WIDE))
            - F.when(ended, F.col("target_size").cast(WIDE)).otherwise(F.lit(0).cast(WIDE))
        ).cast(WIDE).alias("d_bytes"),
    )


def running(events: DataFrame, block_bits: int = prefix.BLOCK_BITS) -> DataFrame:
    """Live count and bytes after each event."""
    return prefix.scan(
        deltas(events), ["trace_id"], ["seq"], prefix.block_of("seq", block_bits),
        [
            prefix.Run("live_count", "sum", F.col("d_count")),
            prefix.Run("live_bytes", "sum", F.col("d_bytes")),
        ],
    ).select("trace_id", "seq", "t", "live_count", F.col("live_bytes").cast(WIDE).alias("live_bytes"))


def peak(events: DataFrame, block_bits: int = prefix.BLOCK_BITS) -> DataFrame:
    """A2: the highest live bytes of each trace and the first position there."""
    best = running(events, block_bits).groupBy("trace_id").agg(
        F.max(F.struct("live_bytes", (-F.col("seq")).alias("back"), "t")).alias("p")
    )
    some = F.col("p.live_bytes") > 0
    return best.select(
        "trace_id",
        F.when(some, F.col("p.live_bytes")).otherwise(0).alias("peak_bytes"),
        F.when(some, 1 - F.col("p.back")).otherwise(0).alias("events_applied"),
        F.col("p.t").alias("peak_t"),
    )


def totals_at(playheads: DataFrame, events: DataFrame) -> DataFrame:
    """Live totals at many positions (trace_id, n) in one pass.

    Positions are dense, so the state after n events is the row n - 1.
    """
    rows = running(events).select(
        "trace_id", (F.col("seq") + 1).alias("n"), "live_count", "live_bytes"
    )
    zero = F.lit(0).cast(WIDE)
    return playheads.join(rows, ["trace_id", "n"], "left").select(
        "trace_id", "n", F.coalesce("live_count", F.lit(0)).alias("live_count"),
        F.coalesce("live_bytes", zero).alias("live_bytes"),
    )


def sets_at(playheads: DataFrame, allocations: DataFrame, keep: list[str]) -> DataFrame:
    """The live sets of many positions (trace_id, n, more).

    A few positions are sent to every task, by lifetime bins, and allocations stay
    where they are. Beyond PLAYHEADS_BROADCAST see ``_sets_by_ranks``.
    """
    slim = allocations.select(*dict.fromkeys(["trace_id", "creator", "death", *keep])).withColumn(
        "_tl", ranges.lifetime_level(F.col("creator"), F.col("death"))
    )
    levels = ranges.levels_in(slim, F.col("_tl"))
    first = F.when(F.col("_tl") == ranges.OPEN, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftright", F.col("creator"), F.col("_tl"))
    )
    last = F.when(F.col("_tl") == ranges.OPEN, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftright", F.col("death"), F.col("_tl"))
    )
    right = slim.withColumn("_b", F.explode(F.sequence(first, last)))
    cells = F.array(
        *[
            F.struct(
                F.lit(x).alias("_tl"),
                (F.lit(0).cast("bigint") if x == ranges.OPEN else F.shiftright("n", x)).alias("_b"),
            )
            for x in levels
        ]
    )
    left = playheads.withColumn("_c", F.explode(cells)).select("*", "_c._tl", "_c._b").drop("_c")
    left = staged(left, "playheads")
    if left.count() > PLAYHEADS_BROADCAST:
        return _sets_by_ranks(playheads, slim.drop("_tl"))
    return (
        F.broadcast(left).join(right, ["trace_id", "_tl", "_b"])
        .filter(live_at(F.col("n")))
        .drop("_tl", "_b")
    )


def _sets_by_ranks(playheads: DataFrame, slim: DataFrame) -> DataFrame:
    """The same for any number of positions, by shuffles.

    Distinct positions are numbered per trace; those at which an allocation lives are a
    range of numbers, from two counts of positions ahead of its birth and of its death.
    Ranges become rows in bounded pieces, so a key of the last join is one position and
    holds its live set, never all open allocations.
    """
    heads = staged(playheads.select("trace_id", "n").distinct(), "positions")
    numbered = staged(prefix.dense_index(heads, ["trace_id"], ["n"], "_k"), "playheads")
    spans = slim.join(_ranks(numbered, slim), ["trace_id", "creator"])
    met = expanded(spans, "_lo", "_hi", "_k")
    return playheads.join(numbered, ["trace_id", "n"]).join(met, ["trace_id", "_k"]).drop("_k")


def _ranks(numbered: DataFrame, slim: DataFrame) -> DataFrame:
    """(trace_id, creator, _lo, _hi): the numbers of the positions an allocation lives at."""
    spot = lambda pos, kind: F.struct(F.col(pos).alias("pos"), F.lit(kind).alias("kind"))
    ends = F.array_compact(F.array(spot("creator", 1), F.when(F.col("death").isNotNull(), spot("death", 2))))
    rows = slim.select("trace_id", "creator", F.inline(ends)).unionByName(
        # a position counts ahead of what happens at it: it is the state after n events
        numbered.select("trace_id", F.lit(-1).cast("bigint").alias("creator"), F.col("n").alias("pos"), F.lit(0).alias("kind"))
    )
    counted = prefix.scan(
        rows, ["trace_id"], ["pos", "kind", "creator"], prefix.block_of("pos"),
        [prefix.Run("ahead", "sum", F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint"))],
    )
    total = per_trace(numbered.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_all")), "positions-of")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ahead")))
    per = counted.filter("kind > 0").groupBy("trace_id", "creator").agg(of(1).alias("_lo"), of(2).alias("_to"))
    return per.join(total, "trace_id").select("trace_id", "creator", "_lo", (F.coalesce("_to", "_all") - 1).alias("_hi"))


def diff(allocations: DataFrame, a: int, b: int) -> DataFrame:
    """Born, died or survived between two positions."""
    lo, hi = min(a, b), max(a, b)
    at_lo, at_hi = live_at(lo), live_at(hi)
    label = (
        F.when(at_lo & at_hi, "survived").when(at_lo, "died").when(at_hi, "born")
    )
    return allocations.withColumn("change", label).filter("change is not null")


def prefix_counts(events: DataFrame, block_bits: int = prefix.BLOCK_BITS) -> DataFrame:
    """Creators and frees ahead of each event (a resize counts as both)."""
    return prefix.scan(
        events.select("trace_id", "seq", "op"), ["trace_id"], ["seq"],
        prefix.block_of("seq", block_bits),
        [
            prefix.Run("births_before", "sum", F.col("op").isin("M", "R").cast("bigint"), False),
            prefix.Run("frees_before", "sum", F.col("op").isin("F", "R").cast("bigint"), False),
        ],
    )


def time_at(events: DataFrame, n: int) -> DataFrame:
    """The time at position n (the trace's first time at 0)."""
    # positions are dense: one row of each trace, which footer statistics find; a trace
    # that ends before n shows its last time, as times never fall
    at = max(n - 1, 0)
    here = events.filter(F.col("seq") == at).select("trace_id", "t")
    ended = events.groupBy("trace_id").agg(F.max("seq").alias("_last"), F.max("t").alias("t")).filter(F.col("_last") < at)
    return here.unionByName(ended.select("trace_id", "t"))


def position_at(events: DataFrame, t: int) -> DataFrame:
    """Per trace, the number of events with time <= t."""
    found = events.filter(F.col("t") <= t).groupBy("trace_id").agg(F.max("seq").alias("s"))
    return (
        events.select("trace_id").distinct().join(found, "trace_id", "left")
        .select("trace_id", (F.coalesce("s", F.lit(-1)) + 1).alias("n"))
    )


def ages(allocations: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """Each live allocation's age against the oldest, on a log scale."""
    live = allocations.filter(live_at(n))
    oldest = live.groupBy("trace_id").agg(F.min("birth_t").alias("oldest_t"))
    now = time_at(events, n).withColumnRenamed("t", "now")
    frame = per_trace(oldest.join(now, "trace_id"), "ages")
    age = F.greatest(F.col("now") - F.col("birth_t"), F.lit(0)).cast("double")
    top = F.log(1.0 + F.greatest(F.col("now") - F.col("oldest_t"), F.lit(0)).cast("double"))
    return live.join(frame, "trace_id").select(
        "trace_id", "creator", "oldest_t",
        F.when(top > 0, F.log(1.0 + age) / top).otherwise(0.0).alias("age_fraction"),
    )


def widest(allocations: DataFrame, n: int) -> DataFrame:
    """The widest span live at a position."""
    return allocations.filter(live_at(n)).groupBy("trace_id").agg(F.max("span").alias("widest"))


def reuse_chains(
    allocations: DataFrame, rows: int, hot_rows: int = skew.HOT_ROWS,
    block_bits: int = prefix.BLOCK_BITS,
) -> DataFrame:
    """The allocations of each address in birth order.

    ``generation`` counts from 1; ``gap`` is the events between the previous
    end and this birth (negative or null when the previous one still lived).
    """
    keys = ["trace_id", "addr"]
    slim = allocations.select(*keys, "creator", "id", "size", "site", "death", "birth_t")
    marked = skew.mark_hot(slim, keys, skew.hot_keys(slim, keys, rows, "creator", hot_rows))
    chained = prefix.scan(
        marked, keys, ["creator"], skew.hot_block(prefix.block_of("creator", block_bits)),
        [
            prefix.Run("generation", "sum", F.lit(1).cast("bigint")),
            prefix.Run("before", "last", F.struct("creator", "death", "size"), inclusive=False),
        ],
        carried=F.col("_hot"),
    )
    return chained.select(
        *keys, "creator", "id", "size", "site", "death", "generation",
        F.col("before.creator").alias("previous"),
        F.col("before.death").alias("previous_death"),
        (F.col("creator") - F.col("before.death")).alias("gap"),
    )


def bursts(events: DataFrame) -> DataFrame:
    """Times that several events share."""
    return (
        events.groupBy("trace_id", "t")
        .agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        .filter("events > 1")
    )
