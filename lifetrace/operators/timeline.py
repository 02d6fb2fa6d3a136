"""T rows: binned activity over the event order or over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.functions.u64 import byte_sum
from lifetrace.plans import prefix
from lifetrace.trace import Trace

WIDE = "decimal(38,0)"
COUNTS = ["allocations", "frees", "reallocations", "custom_events"]
BYTES = ["allocated_bytes", "freed_bytes"]


def bin_of(coordinate: Column, lo: int, hi: int, bins: int) -> Column:
    width = max(hi - lo, 1)
    scaled = (coordinate.cast(WIDE) - lo) * bins
    return F.least(F.call_function("div", scaled, F.lit(width).cast(WIDE)), F.lit(bins - 1)).cast("bigint")


def _zero() -> Column:
    return F.lit(0).cast(WIDE)


def _steps(trace: Trace, matched: DataFrame | None) -> DataFrame:
    """What each event adds: seq, t, four counts and two byte amounts.

    With a match set the two sides of a resize count on their own: bytes come
    from the matched allocations' births and deaths, so events are not joined;
    only resizes are brought together once, to count each a single time.
    """
    op = F.col("op")
    one = lambda c: F.when(c, 1).otherwise(0)
    if matched is None:
        hit = F.col("target").isNotNull()
        born = op.isin("M", "R")
        return trace.events.select(
            "trace_id", "seq", "t",
            one(op == "M").alias("allocations"), one((op == "F") & hit).alias("frees"),
            one(op == "R").alias("reallocations"), one(op == "E").alias("custom_events"),
            F.when(born, F.col("size")).alias("allocated_bytes"),
            F.when(hit, F.col("target_size")).alias("freed_bytes"),
        )
    none = F.lit(None).cast(trace.allocations.schema["size"].dataType)
    births = matched.select(
        "trace_id", F.col("creator").alias("seq"), F.col("birth_t").alias("t"), "op",
        F.col("size").alias("allocated_bytes"), none.alias("freed_bytes"),
    )
    deaths = matched.filter("death is not null").select(
        "trace_id", F.col("death").alias("seq"), F.col("death_t").alias("t"),
        F.col("death_op").alias("op"), none.alias("allocated_bytes"), F.col("size").alias("freed_bytes"),
    )
    marks = trace.events.filter("op = 'E'").select(
        "trace_id", "seq", "t", "op", none.alias("allocated_bytes"), none.alias("freed_bytes")
    )
    both = births.unionByName(deaths)
    resizes = both.filter("op = 'R'").groupBy("trace_id", "seq", "t").agg(
        F.first("op").alias("op"), F.max("allocated_bytes").alias("allocated_bytes"),
        F.max("freed_bytes").alias("freed_bytes"),
    )
    rows = both.filter("op <> 'R'").unionByName(resizes).unionByName(marks)
    return rows.select(
        "trace_id", "seq", "t",
        one(op == "M").alias("allocations"), one(op == "F").alias("frees"),
        one(op == "R").alias("reallocations"), one(op == "E").alias("custom_events"),
        "allocated_bytes", "freed_bytes",
    )


def timeline(
    trace: Trace, lo: int, hi: int, bins: int, domain: str = "sequence",
    matched: DataFrame | None = None,
) -> DataFrame:
    """``bins`` rows per trace over [lo, hi), empty bins included."""
    at = F.col("t" if domain == "time" else "seq")
    inside = _steps(trace, matched).filter((at >= lo) & (at < hi))
    filled = inside.groupBy("trace_id", bin_of(at, lo, hi, bins).alias("bin")).agg(
        *[F.sum(c).alias(c) for c in COUNTS], *[byte_sum(c).alias(c) for c in BYTES]
    )
    width = max(hi - lo, 1)
    edge = lambda i: F.lit(lo) + F.call_function(
        "div", F.lit(width).cast(WIDE) * i, F.lit(bins).cast(WIDE)
    ).cast("bigint")
    every = trace.headers.select(
        "trace_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
    )
    rows = every.join(filled, ["trace_id", "bin"], "left")
    return rows.select(
        "trace_id", "bin", edge(F.col("bin")).alias("from"), edge(F.col("bin") + 1).alias("to"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        *[F.coalesce(c, _zero()).alias(c) for c in BYTES],
        (F.coalesce("allocated_bytes", _zero()) - F.coalesce("freed_bytes", _zero())).alias("net_live_bytes"),
    )


def cumulated(rows: DataFrame) -> DataFrame:
    """Live bytes at the end of each bin, from the bins alone."""
    return prefix.scan(
        rows, ["trace_id"], ["bin"], prefix.block_of("bin"),
        [prefix.Run("live_bytes", "sum", F.col("net_live_bytes"))],
    )


def column_of(value: Column, lo: float, hi: float, width: int, domain: str) -> Column:
    """The pixel column of a value; null outside [lo, hi).

    An edge is lo + (hi - lo) * c / width, rounded for positions and rounded
    up for times; the column is guessed by division and then settled by the
    edges themselves.
    """
    x = value.cast("double")
    settle = F.round if domain == "sequence" else F.ceil
    lo_, hi_ = F.lit(float(lo)), F.lit(float(hi))

    def edge(c: Column) -> Column:
        raw = lo_ + (hi_ - lo_) * c.cast("double") / F.lit(float(width))
        if domain == "sequence":
            raw = F.greatest(settle(raw), F.lit(0.0))
            return raw
        return settle(raw).cast("double")

    guess = F.floor((x - lo_) * float(width) / (hi_ - lo_)).cast("bigint")
    fits = lambda c: (
        (c >= 0) & (c < width) & (edge(c) <= x) & (x < edge(c + 1))
    )
    return (
        F.when(fits(guess), guess).when(fits(guess - 1), guess - 1).when(fits(guess + 1), guess + 1)
    )


def density(events: DataFrame, lo: float, hi: float, width: int, domain: str) -> DataFrame:
    """T4: creators and frees per pixel column (columns with none are absent)."""
    at = F.col("seq" if domain == "sequence" else "t")
    return (
        events.withColumn("column", column_of(at, lo, hi, width, domain))
        .filter("column is not null")
        .groupBy("trace_id", "column")
        .agg(
            F.count(F.when(F.col("op").isin("M", "R"), 1)).alias("births"),
            F.count(F.when(F.col("op").isin("F", "R"), 1)).alias("frees"),
        )
        .filter("births > 0 or frees > 0")
    )


def tag_lanes(tagged: DataFrame, lo: float, hi: float, width: int) -> DataFrame:
    """Per column the first tagged birth and first tagged death.

    ``tagged`` has a sorted ``tags`` array; an allocation shows its first tag.
    """
    some = tagged.filter(F.size("tags") > 0).withColumn("tag", F.element_at("tags", 1))
    births = some.select("trace_id", F.col("creator").alias("seq"), "tag", F.lit("birth").alias("lane"))
    deaths = some.filter("death is not null").select(
        "trace_id", F.col("death").alias("seq"), "tag", F.lit("death").alias("lane")
    )
    return (
        births.unionByName(deaths)
        .withColumn("column", column_of(F.col("seq"), lo, hi, width, "sequence"))
        .filter("column is not null")
        .groupBy("trace_id", "lane", "column")
        .agg(F.min("seq").alias("seq"), F.min_by("tag", "seq").alias("tag"))
    )
