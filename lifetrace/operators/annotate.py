"""E rows, J9, A14: tag membership as a table of (trace_id, tag, creator)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBER = ["trace_id", "tag", "creator"]


def with_tags(allocations: DataFrame, members: DataFrame) -> DataFrame:
    """A sorted ``tags`` array per allocation (at most 255 tags exist)."""
    lists = members.groupBy("trace_id", "creator").agg(
        F.array_sort(F.collect_set("tag")).alias("tags")
    )
    empty = F.array().cast("array<string>")
    return allocations.join(lists, ["trace_id", "creator"], "left").withColumn(
        "tags", F.coalesce("tags", empty)
    )


def having(allocations: DataFrame, members: DataFrame, tag: str) -> DataFrame:
    """the allocations with one tag. Only that tag's members are read, and no
    other allocation's tags are put together."""
    one = members.filter(F.col("tag") == tag).select("trace_id", "creator")
    return allocations.join(one, ["trace_id", "creator"], "left_semi")


def exactly(allocations: DataFrame, members: DataFrame, *sets: list[str]) -> DataFrame:
    """the allocations whose tags are one of these sets (an empty one: untagged).

    Members are reduced to a flag per allocation by a partial aggregate; no list of
    tags is put together.
    """
    tag = F.col("tag")

    def equal(names: list[str]):
        test = F.bool_and(tag.isin(names))
        for name in names:
            test = test & F.bool_or(tag == name)
        return test

    wanted = [sorted(set(s)) for s in sets]
    test = F.lit(False)
    for names in filter(None, wanted):
        test = test | equal(names)
    flags = members.groupBy("trace_id", "creator").agg(test.alias("_exact"))
    none = F.lit([] in wanted)
    return allocations.join(flags, ["trace_id", "creator"], "left").filter(F.coalesce("_exact", none)).drop("_exact")


def tagged(matched: DataFrame, tag: str) -> DataFrame:
    return matched.select("trace_id", F.lit(tag).alias("tag"), "creator")


def add(members: DataFrame, matched: DataFrame, tag: str) -> DataFrame:
    """The tag's members and the matched allocations."""
    return members.select(*MEMBER).unionByName(tagged(matched, tag)).distinct()


def remove(members: DataFrame, matched: DataFrame, tag: str) -> DataFrame:
    """The tag's members without the matched allocations."""
    return members.select(*MEMBER).join(tagged(matched, tag), MEMBER, "left_anti")


def replace(members: DataFrame, matched: DataFrame, tag: str) -> DataFrame:
    """Exactly the matched allocations."""
    return members.select(*MEMBER).filter(F.col("tag") != tag).unionByName(tagged(matched, tag).distinct())


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per tag, how many memberships differ between two tables."""
    a = before.select(*MEMBER).distinct().withColumn("_a", F.lit(1))
    b = after.select(*MEMBER).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, MEMBER, "full_outer")
    return both.groupBy("trace_id", "tag").agg(
        F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("changed")
    )


def born_in(allocations: DataFrame, lo: int, hi: int) -> DataFrame:
    """E5: creators with ``lo <= seq < hi``."""
    return allocations.filter((F.col("creator") >= lo) & (F.col("creator") < hi))


def freed_in(allocations: DataFrame, lo: int, hi: int) -> DataFrame:
    """Creators ended by an event with ``lo <= seq < hi``."""
    return allocations.filter((F.col("death") >= lo) & (F.col("death") < hi))


def in_time(allocations: DataFrame, lo: int, hi: int, freed: bool = False) -> DataFrame:
    """Born (or freed) at ``lo <= t <= hi``, both ends included.

    Clamped time never falls along the stream, so the time bounds select the
    same run of events the positions would.
    """
    col = F.col("death_t" if freed else "birth_t")
    return allocations.filter((col >= lo) & (col <= hi))


def retag(members: DataFrame, old: str, new: str | None) -> DataFrame:
    """Turn one tag into another, or drop it (``new`` None)."""
    if new is None:
        return members.select(*MEMBER).filter(F.col("tag") != old)
    name = F.when(F.col("tag") == old, F.lit(new)).otherwise(F.col("tag"))
    return members.select("trace_id", name.alias("tag"), "creator").distinct()


def set_tags(members: DataFrame, trace_id: str, creator: int, tags: list[str]) -> DataFrame:
    """Replace the tags of one allocation."""
    same = (F.col("trace_id") == trace_id) & (F.col("creator") == creator)
    kept = members.select(*MEMBER).filter(~same)
    rows = [(trace_id, t, creator) for t in sorted(set(tags))]
    new = members.sparkSession.createDataFrame(rows, "trace_id string, tag string, creator bigint")
    return kept.unionByName(new)


def export_members(members: DataFrame) -> DataFrame:
    """Each tag with its creators, one row per member, in order.

    A tag may hold most of a trace, so the list is rows with a place inside
    the tag and not one array value.
    """
    from lifetrace.plans.prefix import dense_index

    return dense_index(members.select(*MEMBER).distinct(), ["trace_id", "tag"], ["creator"], "place")


def import_members(members: DataFrame, incoming: DataFrame, allocations: DataFrame) -> DataFrame:
    """Add memberships; what names no allocation is ignored."""
    valid = incoming.select(*MEMBER).join(
        allocations.select("trace_id", "creator"), ["trace_id", "creator"], "left_semi"
    )
    return members.select(*MEMBER).unionByName(valid.select(*MEMBER)).distinct()


def tag_counts(allocations: DataFrame, members: DataFrame) -> DataFrame:
    """Members per tag, and ``(untagged)``."""
    creators = allocations.select("trace_id", "creator")
    held = members.select(*MEMBER).distinct().join(creators, ["trace_id", "creator"], "left_semi")
    some = members.select("trace_id", "creator", F.lit(True).alias("_some")).distinct()
    bare = creators.join(some, ["trace_id", "creator"], "left").groupBy("trace_id").agg(
        F.count(F.when(F.col("_some").isNull(), 1)).alias("allocations")
    )
    # The untagged count is reported even when it is zero.
    return (
        held.groupBy("trace_id", "tag")
        .agg(F.count(F.lit(1)).alias("allocations"))
        .unionByName(bare.withColumn("tag", F.lit("(untagged)")))
    )


def with_notes(allocations: DataFrame, notes: DataFrame) -> DataFrame:
    """Names and colours; ``notes`` has (trace_id, creator, name, color)."""
    return allocations.join(
        notes.select("trace_id", "creator", "name", "color"), ["trace_id", "creator"], "left"
    )
