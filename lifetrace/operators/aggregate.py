"""A rows: overview, grouped summaries, rankings.

Every grouping is a plain ``groupBy``: rows are combined before the shuffle,
so one site or thread holding most of a trace costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifetrace.functions.buckets import bucket
from lifetrace.functions.u64 import byte_sum
from lifetrace.plans import prefix
from lifetrace.plans.small import per_trace
from lifetrace.trace import Trace


def _n(condition: Column | None = None) -> Column:
    return F.count(F.lit(1) if condition is None else F.when(condition, 1))


def overview(trace: Trace) -> DataFrame:
    """A1: one row of totals per trace, beside its title and unit of time."""
    op = F.col("op")
    seen = trace.events.select("trace_id", "ord", "t", "t_raw", "op").unionByName(
        trace.rejects.filter("reason not in ('malformed', 'header')").select(
            "trace_id", "ord", F.col("t_raw").alias("t"), "t_raw", F.lit(None).alias("op")
        )
    )
    # Records that gave no event still move the clock.
    zero = F.lit(0).cast(trace.events.schema["t"].dataType)
    counts = seen.groupBy("trace_id").agg(
        _n(op.isNotNull()).alias("events"),
        _n(op.isin("M", "R")).alias("allocations"),
        _n(op == "F").alias("frees"),
        _n(op == "R").alias("reallocations"),
        _n(op == "E").alias("custom_events"),
        F.min_by(F.coalesce("t_raw", zero), "ord").alias("t_min"),
        F.max("t").alias("t_max"),
    )
    live = ~F.col("freed")
    sizes = trace.allocations.groupBy("trace_id").agg(
        F.min("addr").alias("addr_min"),
        F.max("end_span").alias("addr_max"),
        _n(live).alias("live_count"),
        byte_sum(F.when(live, F.col("size"))).alias("live_bytes"),
        byte_sum("size").alias("total_bytes"),
        F.max("span").alias("max_span"),
    )
    named = per_trace(trace.headers.select("trace_id", "title", "unit"), "titles")
    return counts.join(sizes, "trace_id", "left").join(named, "trace_id", "left")


# Grouping keys of a summary, by name.
GROUPINGS = {
    "site": lambda: F.coalesce("site", F.lit("(none)")),
    "thread": lambda: F.coalesce(F.col("thr").cast("string"), F.lit("(none)")),
    "freed": lambda: F.when(F.col("freed"), "freed").otherwise("live-at-end"),
    "size-bucket": lambda: bucket(F.col("size")),
    "lifetime-bucket": lambda: F.coalesce(bucket(F.col("lifetime")), F.lit("live-at-end")),
}


def measures() -> list[Column]:
    return [
        _n().alias("allocations"),
        byte_sum("size").alias("requested"),
        byte_sum("usable").alias("usable"),
        _n(F.col("usable").isNotNull()).alias("usable_known"),
        _n(F.col("freed")).alias("freed"),
        _n(~F.col("freed")).alias("live_at_end"),
    ]


def summarize(allocations: DataFrame, by: str | Column) -> DataFrame:
    """The measures by a grouping or by any key column."""
    key = GROUPINGS[by]() if isinstance(by, str) else by
    return allocations.groupBy("trace_id", key.alias("key")).agg(*measures())


def summarize_by_tag(allocations: DataFrame, members: DataFrame) -> DataFrame:
    """One row per membership counts; ``(untagged)`` for those with none."""
    keyed = allocations.join(
        members.select("trace_id", "tag", "creator"), ["trace_id", "creator"], "left"
    )
    return summarize(keyed, F.coalesce("tag", F.lit("(untagged)")))


def top(groups: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The first k groups of each trace, with how many were left out.

    The rank filter lets each task keep k rows before the shuffle.
    """
    order = order or [F.col("requested").desc(), F.col("allocations").desc(), F.col("key").asc()]
    totals = groups.groupBy("trace_id").agg(_n().alias("_groups"))
    ranked = groups.withColumn(
        "place", F.row_number().over(Window.partitionBy("trace_id").orderBy(*order))
    ).filter(F.col("place") <= k)
    return ranked.join(totals, "trace_id").withColumn(
        "omitted", F.greatest(F.col("_groups") - k, F.lit(0))
    ).drop("_groups")


def matched_totals(allocations: DataFrame) -> DataFrame:
    """Totals of a match set."""
    return allocations.groupBy("trace_id").agg(*measures()[:4])


def _catalog_rows(trace: Trace) -> DataFrame:
    """Records that name a site or thread; dropped creators name theirs too."""
    creator = F.col("op").isin("M", "R")
    events = trace.events.select(
        "trace_id", "ord", "op", "site", "thr",
        creator.alias("counts"), F.when(creator, F.col("size")).alias("bytes"),
    )
    gone = trace.rejects.filter("reason = 'no-addr'").select(
        "trace_id", "ord", "op", "site", "thr", F.lit(False).alias("counts"),
        F.lit(None).cast(trace.events.schema["size"].dataType).alias("bytes"),
    )
    return events.unionByName(gone)


def site_catalog(trace: Trace) -> DataFrame:
    """Sites with their creators, bytes and first record; some have none."""
    named = _catalog_rows(trace).filter("op <> 'E' and site is not null")
    return named.groupBy("trace_id", F.col("site").alias("key")).agg(
        _n(F.col("counts")).alias("allocations"),
        byte_sum("bytes").alias("requested"),
        F.min("ord").alias("first_ord"),
    )


def thread_catalog(trace: Trace) -> DataFrame:
    named = _catalog_rows(trace).filter("thr is not null")
    return named.groupBy("trace_id", F.col("thr").alias("key")).agg(
        _n(F.col("counts")).alias("allocations"), F.min("ord").alias("first_ord")
    )


def top_sites(trace: Trace, k: int) -> DataFrame:
    """A3."""
    return top(site_catalog(trace), k)


def slack(allocations: DataFrame, by: str = "site") -> DataFrame:
    """Slack where the usable size is known; null where it is not."""
    known = F.col("usable").isNotNull()
    asked = F.sum(F.when(known, F.col("size")).cast("decimal(20,0)"))
    given = F.sum(F.col("usable").cast("decimal(20,0)"))
    return allocations.groupBy("trace_id", GROUPINGS[by]().alias("key")).agg(
        _n().alias("allocations"),
        _n(known).alias("known"),
        asked.alias("requested_known"),
        given.alias("usable_known"),
        (given - asked).alias("slack"),
        (given.cast("double") / asked.cast("double")).alias("amplification"),
    )


def retention(allocations: DataFrame, cycle: Column) -> DataFrame:
    """What each cycle left behind, and the running total.

    ``cycle`` is an integer; the running sum goes over one row per cycle.
    """
    live = ~F.col("freed")
    per = allocations.withColumn("cycle", cycle.cast("bigint")).filter("cycle is not null")
    per = per.groupBy("trace_id", "cycle").agg(
        _n().alias("allocations"),
        _n(live).alias("retained"),
        byte_sum(F.when(live, F.col("size"))).alias("retained_bytes"),
    )
    return prefix.scan(
        per, ["trace_id"], ["cycle"], prefix.block_of("cycle", prefix.SPARSE_BITS),
        [prefix.Run("total_bytes", "sum", F.col("retained_bytes"))], levels=2,
    )


def leaders(groups: DataFrame, k: int) -> DataFrame:
    """The leaders by bytes and by count, side by side."""
    window = Window.partitionBy("trace_id")
    by_bytes = groups.withColumn(
        "bytes_rank", F.rank().over(window.orderBy(F.col("requested").desc()))
    ).filter(F.col("bytes_rank") <= k)
    by_count = groups.withColumn(
        "count_rank", F.rank().over(window.orderBy(F.col("allocations").desc()))
    ).filter(F.col("count_rank") <= k)
    return by_bytes.select("trace_id", "key", "requested", "bytes_rank").join(
        by_count.select("trace_id", "key", F.col("allocations"), "count_rank"),
        ["trace_id", "key"], "full_outer",
    )
