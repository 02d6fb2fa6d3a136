"""L rows: detail, resize chains, event neighbourhoods, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.operators import address, annotate
from lifetrace.plans import prefix
from lifetrace.session import staged
from lifetrace.trace import Trace

# Operation names of the report form.
OPERATIONS = {"M": "malloc", "F": "free", "R": "realloc", "E": "event"}


def operation(op: str | Column = "op") -> Column:
    col = F.col(op) if isinstance(op, str) else op
    out = F.lit(None).cast("string")
    for code, name in OPERATIONS.items():
        out = F.when(col == code, name).otherwise(out)
    return out


def detail(
    allocations: DataFrame, notes: DataFrame | None = None, members: DataFrame | None = None
) -> DataFrame:
    """L1: the long form of allocations (filter them first).

    With ``notes`` it carries its name and colour, with ``members`` its tags.
    """
    end = F.col("death").isNotNull()
    rows = _detail(allocations, end)
    rows = rows if notes is None else annotate.with_notes(rows, notes)
    return rows if members is None else annotate.with_tags(rows, members)


def _detail(allocations: DataFrame, end: Column) -> DataFrame:
    return allocations.select(
        "trace_id", "creator", "id", "addr", "size", "usable", "lifetime", "site",
        F.col("thr").alias("thread"),
        operation().alias("operation"),
        F.col("end_req").alias("end"),
        "stack",
        F.col("extras").alias("fields"),
        F.col("death_extras").alias("death_fields"),
        F.struct(
            F.col("realloc_from").alias("reallocated_from"), F.col("realloc_to").alias("reallocated_to")
        ).alias("relations"),
        F.struct(
            F.col("creator").alias("seq"), F.col("birth_t").alias("time"),
            operation().alias("operation"), "site", F.col("thr").alias("thread"), "stack",
            F.col("extras").alias("fields"),
        ).alias("creator_event"),
        F.when(
            end,
            F.struct(
                F.col("death").alias("seq"), F.col("death_t").alias("time"),
                operation("death_op").alias("operation"), F.col("death_extras").alias("fields"),
            ),
        ).alias("death_event"),
    )


def chains(allocations: DataFrame) -> DataFrame:
    """L2: ``root`` and ``generation`` of every allocation in a resize chain.

    Pointer doubling: after k rounds a row knows its ancestor 2^k - 1 steps
    up, so the rounds are the logarithm of the longest chain. A chain is a
    path, so both sides of each join have unique keys. Each round is written.
    """
    nodes = allocations.filter("realloc_from is not null or realloc_to is not null")
    state = staged(
        nodes.select(
            "trace_id", "creator", F.col("creator").alias("root"),
            F.lit(0).cast("bigint").alias("generation"), F.col("realloc_from").alias("jump"),
        ),
        "chain",
    )
    while not state.filter("jump is not null").isEmpty():
        up = state.select(
            "trace_id", F.col("creator").alias("jump"), F.col("root").alias("_root"),
            F.col("generation").alias("_gen"), F.col("jump").alias("_jump"),
        )
        moving = state.filter("jump is not null").join(up, ["trace_id", "jump"]).select(
            "trace_id", "creator", F.col("_root").alias("root"),
            (F.col("generation") + 1 + F.col("_gen")).alias("generation"), F.col("_jump").alias("jump"),
        )
        state = staged(state.filter("jump is null").unionByName(moving), "chain")
    return state.drop("jump")


def chain_summary(allocations: DataFrame) -> DataFrame:
    """L2: per chain its length, first and last size, and whether it lives."""
    sizes = allocations.select("trace_id", "creator", "size", "freed")
    rows = chains(allocations).join(sizes, ["trace_id", "creator"])
    return rows.groupBy("trace_id", "root").agg(
        F.count(F.lit(1)).alias("length"),
        F.max_by("creator", "generation").alias("tail"),
        F.min_by("size", "generation").alias("first_size"),
        F.max_by("size", "generation").alias("last_size"),
        (~F.max_by("freed", "generation")).alias("live"),
    )


def _creator() -> Column:
    return F.when(F.col("op") == "F", F.col("target")).when(F.col("op") != "E", F.col("seq"))


def event_rows(events: DataFrame) -> DataFrame:
    """Each event with the allocation it is about."""
    free = F.col("op") == "F"
    return events.select(
        "trace_id", "seq", "t", operation().alias("operation"),
        _creator().alias("creator"),
        F.when(F.col("op") == "R", F.col("target")).alias("replaces"),
        F.when(F.col("op") != "E", F.col("id")).alias("id"),
        F.when(free, F.col("target_size")).when(F.col("op") != "E", F.col("size")).alias("size"),
        F.when(free, F.col("target_site")).when(F.col("op") != "E", F.col("site")).alias("site"),
        "title",
    )


def touching(events: DataFrame, matched: DataFrame, landmarks: bool = True) -> DataFrame:
    """Events that create, end or resize a matched allocation."""
    keys = matched.select("trace_id", "creator")
    links = events.filter("op <> 'E'").select(
        "trace_id", "seq", F.explode(F.array_compact(F.array(_creator(), F.col("target")))).alias("creator")
    )
    hit = links.join(keys, ["trace_id", "creator"], "left_semi").select("trace_id", "seq").distinct()
    found = events.join(hit, ["trace_id", "seq"], "left_semi")
    return found.unionByName(events.filter("op = 'E'")) if landmarks else found


def context(
    trace: Trace, matched: DataFrame, center: int, before: int, after: int, landmarks: bool = True
) -> DataFrame:
    """L4: the events around a position that touch matched allocations."""
    window = trace.events.filter(
        (F.col("seq") >= max(center - before, 0)) & (F.col("seq") <= center + after)
    )
    return event_rows(touching(window, matched, landmarks))


def contexts(
    centers: DataFrame, events: DataFrame, before: int, after: int
) -> DataFrame:
    """The neighbourhoods of many positions (trace_id, center).

    Bins as wide as the window: a neighbourhood touches two of them at most.
    """
    width = before + after + 1
    bin_of = lambda c: F.floor(c / width).cast("bigint")
    left = centers.select(
        "trace_id", "center",
        F.explode(
            F.sequence(
                bin_of(F.greatest(F.col("center") - before, F.lit(0))), bin_of(F.col("center") + after)
            )
        ).alias("_bin"),
    )
    right = event_rows(events).withColumn("_bin", bin_of(F.col("seq")))
    return (
        left.join(right, ["trace_id", "_bin"])
        .filter(
            (F.col("seq") >= F.col("center") - before) & (F.col("seq") <= F.col("center") + after)
        )
        .drop("_bin")
    )


def landmarks(events: DataFrame) -> DataFrame:
    """L7."""
    return events.filter("op = 'E'").select(
        "trace_id", "seq", "t", "title", F.col("thr").alias("thread"), F.col("extras").alias("fields")
    )


def phases(events: DataFrame, block_bits: int = prefix.BLOCK_BITS) -> DataFrame:
    """Every event with the latest landmark at or before it."""
    mark = F.when(F.col("op") == "E", F.struct("seq", "title"))
    run = prefix.scan(
        events, ["trace_id"], ["seq"], prefix.block_of("seq", block_bits),
        [prefix.Run("_mark", "last", mark)],
    )
    return run.withColumns(
        {"phase_seq": F.col("_mark.seq"), "phase": F.col("_mark.title")}
    ).drop("_mark")


def pointer_owners(points: DataFrame, allocations: DataFrame) -> DataFrame:
    """Who owned a pointer when it was used, and when it was taken.

    ``points`` has trace_id, seq, ptr and since (positions). Two different
    owners, or one that is gone, make the reference stale.
    """
    both = points.select(
        "trace_id", "seq", F.col("ptr").alias("p_addr"),
        F.explode(
            F.array(
                F.struct(F.lit("now").alias("which"), F.col("seq").alias("p_pos")),
                F.struct(F.lit("then").alias("which"), F.col("since").alias("p_pos")),
            )
        ).alias("_w"),
    ).select("trace_id", "seq", "p_addr", "_w.which", "_w.p_pos")
    owner = address.pick(both, allocations, ["seq", "which"])
    wide = owner.groupBy("trace_id", "seq").agg(
        F.max(F.when(F.col("which") == "now", F.col("newest"))).alias("owner_now"),
        F.max(F.when(F.col("which") == "then", F.col("newest"))).alias("owner_then"),
    )
    out = points.join(wide, ["trace_id", "seq"], "left")
    return out.withColumn(
        "stale",
        F.col("owner_then").isNotNull()
        & ~F.coalesce(F.col("owner_now") == F.col("owner_then"), F.lit(False)),
    )
