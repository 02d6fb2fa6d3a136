"""Following the change log.

Memberships are kept as the last explicit write of each pair and the last
reset of each tag and allocation, which merge by maximum revision. A batch
writes its own facts only; they are merged when the state is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrace.operators import changes
from lifetrace.streaming.runs import merged_state, write_changes

STATE = "trace_id string, what string, tag string, creator bigint, at bigint, present boolean"
KEY = ["trace_id", "what", "tag", "creator"]


def _facts(log: DataFrame) -> DataFrame:
    """Writes and resets of a batch in one shape."""
    wrote = lambda df, tag, creator, present: df.select(
        "trace_id", F.lit("pair").alias("what"), tag.alias("tag"), creator.alias("creator"),
        F.col("revision").alias("at"), present.alias("present"),
    )
    one = log.filter(F.col("type") == changes.SET_TAG)
    alloc = log.filter(F.col("type") == changes.REPLACE_TAGS)
    tag = log.filter(F.col("type") == changes.REPLACE_MEMBERS)
    gone = log.filter(F.col("type") == changes.DELETES["tag"])
    true = F.lit(True)
    none_tag, none_creator = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    reset = lambda df, what, t, c: df.select(
        "trace_id", F.lit(what).alias("what"), t.alias("tag"), c.alias("creator"),
        F.col("revision").alias("at"), true.alias("present"),
    )
    return (
        wrote(one, F.col("id"), F.col("creator"), F.col("present"))
        .unionByName(wrote(alloc.withColumn("_t", F.explode("tag_ids")), F.col("_t"), F.col("creator"), true))
        .unionByName(wrote(tag.withColumn("_c", F.explode("creators")), F.col("id"), F.col("_c"), true))
        .unionByName(reset(tag.unionByName(gone), "tag", F.col("id"), none_creator))
        .unionByName(reset(alloc, "allocation", none_tag, F.col("creator")))
    )


def feed_sink(state: str):
    """A foreachBatch sink adding the facts of valid changes to the state."""

    def sink(batch: DataFrame, number: int) -> None:
        write_changes(_merged(_facts(batch)), state, number, STATE, _merged, KEY)

    return sink


def _merged(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*KEY).agg(
        F.max("at").alias("at"), F.max_by("present", "at").alias("present")
    )


def state_after(spark: SparkSession, state: str, batches: int) -> DataFrame:
    """The merged state after so many batches."""
    return merged_state(spark, state, batches, STATE, _merged, KEY)


def members(state: DataFrame) -> DataFrame:
    """Memberships in force for a state table."""
    pairs = state.filter("what = 'pair' and present").select("trace_id", "tag", "creator", "at")
    tags = state.filter("what = 'tag'").select("trace_id", "tag", F.col("at").alias("_t"))
    allocs = state.filter("what = 'allocation'").select("trace_id", "creator", F.col("at").alias("_a"))
    return (
        pairs.join(tags, ["trace_id", "tag"], "left")
        .join(allocs, ["trace_id", "creator"], "left")
        .filter("at >= coalesce(_t, 0) and at >= coalesce(_a, 0)")
        .select("trace_id", "tag", "creator")
    )
