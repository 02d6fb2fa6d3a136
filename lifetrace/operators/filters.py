"""Facet selections, crops and the filtered event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.functions import exact

UNTAGGED = ""  # stands for "no tag" in a tag selection


def facets(
    sites: list[str] | None = None,
    threads: list[int] | None = None,
    tags: list[str] | None = None,
    size_min: int = 0,
    size_max: int = 0,
    address_ranges: list[tuple[int, int]] | None = None,
) -> Column:
    """A conjunction of selections over an allocation.

    None is no constraint. An empty selection hides every allocation that has
    the attribute; one without it always stays. Any selected tag will do, and
    ``UNTAGGED`` selects those with none (needs a ``tags`` column).
    """
    keep = F.lit(True)
    if sites is not None:
        keep = keep & (F.col("site").isNull() | (F.col("site").isin(*sites) if sites else F.lit(False)))
    if threads is not None:
        keep = keep & (F.col("thr").isNull() | (F.col("thr").isin(*threads) if threads else F.lit(False)))
    if tags is not None:
        named = [t for t in tags if t != UNTAGGED]
        hit = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in named])) if named else F.lit(False)
        bare = F.size("tags") == 0
        keep = keep & (F.when(bare, F.lit(UNTAGGED in tags)).otherwise(hit))
    if size_min > 0:
        keep = keep & (F.col("size") >= exact.integer(size_min))
    if size_max > 0:
        keep = keep & (F.col("size") <= exact.integer(size_max))
    valid = [(lo, hi) for lo, hi in address_ranges or [] if hi > lo]
    if valid:
        any_range = F.lit(False)
        for lo, hi in valid:
            any_range = any_range | (
                (F.col("addr") < exact.integer(hi)) & (F.col("end_span") > exact.integer(lo))
            )
        keep = keep & any_range
    return F.coalesce(keep, F.lit(False))


def visibility(
    allocations: DataFrame, passes: Column, hide: bool, crop: tuple[int, int] | None = None
) -> DataFrame:
    """``hidden`` and ``dimmed`` per allocation; a crop only ever dims."""
    inside = F.lit(True)
    if crop is not None and crop[0] >= 0 and crop[1] > crop[0]:
        inside = (F.col("creator") >= crop[0]) & (F.col("creator") < crop[1])
    passed = F.coalesce(passes, F.lit(False))
    return allocations.select(
        "trace_id", "creator",
        (F.lit(hide) & ~passed).alias("hidden"),
        (~passed | ~inside).alias("dimmed"),
    )


def filtered_events(events: DataFrame, matched: DataFrame) -> DataFrame:
    """Creators that match, and the frees of allocations that do.

    Landmarks and frees of nothing have no allocation to match and drop out.
    """
    touching = events.filter("op <> 'E'").withColumn(
        "_creator", F.when(F.col("op") == "F", F.col("target")).otherwise(F.col("seq"))
    ).filter(F.col("_creator").isNotNull())
    keys = matched.select("trace_id", F.col("creator").alias("_creator"))
    return touching.join(keys, ["trace_id", "_creator"], "left_semi").select(*events.columns)


def filtered_position(events: DataFrame, matched: DataFrame, seq: int) -> DataFrame:
    """per trace, how many events of the filtered stream precede ``seq``."""
    before = filtered_events(events.filter(F.col("seq") < seq), matched)
    counts = before.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        events.select("trace_id").distinct().join(counts, "trace_id", "left")
        .select("trace_id", F.coalesce("n", F.lit(0)).alias("position"))
    )
