"""The two derived traces, resolved once per session and input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lifetrace.operators import lifecycle
from lifetrace.session import staged
from lifetrace.sources import derive
from lifetrace.trace import Trace

_BUILT: dict[tuple[str, str, str], Trace] = {}


def build_trace(spark: SparkSession, sf_dir: str, name: str) -> Trace:
    if name == "orders":
        records = derive.orders_records(spark, sf_dir)
        return lifecycle.build(records, derive.header_row(spark, "orders", "s", "orders"))
    records = derive.events_records(spark, sf_dir)
    return lifecycle.build(records, derive.header_row(spark, "events", "us", "events"))


def trace(spark: SparkSession, sf_dir: str, name: str) -> Trace:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build_trace(spark, sf_dir, name)
    return _BUILT[key]


def orders(spark: SparkSession, sf_dir: str) -> Trace:
    return trace(spark, sf_dir, "orders")


def dirty(spark: SparkSession, sf_dir: str) -> Trace:
    return trace(spark, sf_dir, "events")


def size_of(t: Trace) -> int:
    """Events of the trace, from the footers."""
    return t.events.count()


def half(t: Trace) -> int:
    return size_of(t) // 2


def quarter(t: Trace) -> int:
    return size_of(t) // 4


def times(t: Trace) -> tuple[int, int]:
    """[first, last + 1) of the clamped time."""
    from pyspark.sql import functions as F

    row = t.events.agg(F.min("t"), F.max("t")).first()
    return row[0], row[1] + 1


_MEMBERS: dict[int, DataFrame] = {}


def members(t: Trace) -> DataFrame:
    """Tags used by the registered queries, by rule over the allocations.

    Stored once per trace, a tag's members together, as a user's tags would be.
    """
    if id(t) not in _MEMBERS:
        _MEMBERS[id(t)] = staged(_members(t).sortWithinPartitions("tag", "creator"), "members")
    return _MEMBERS[id(t)]


def _members(t: Trace) -> DataFrame:
    from pyspark.sql import functions as F

    a = t.allocations
    rules = (
        ("hot", F.col("creator") % 7 == 0),
        ("cold", F.col("creator") % 11 == 0),
        ("odd", F.col("size") % 10 >= 6),
    )
    # One pass: each allocation gives a row per rule it meets.
    given = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return a.select("trace_id", F.explode(given).alias("tag"), "creator")


MEMBERS_SQL = """
mem AS (
  SELECT trace_id, 'hot' AS tag, creator FROM al WHERE creator % 7 = 0
  UNION ALL SELECT trace_id, 'cold', creator FROM al WHERE creator % 11 = 0
  UNION ALL SELECT trace_id, 'odd', creator FROM al WHERE size % 10 >= 6),
tagsof AS (SELECT creator, list(tag ORDER BY tag) AS tags FROM mem GROUP BY creator),
alt AS (SELECT al.*, coalesce(tagsof.tags, []) AS tags FROM al LEFT JOIN tagsof USING (creator))"""


def notes(t: Trace) -> DataFrame:
    """A name for every allocation at a thousandth position, and ``anchor``
    for the first one born in the second half."""
    from pyspark.sql import functions as F

    spaced = t.allocations.filter("creator % 1000 = 0").select(
        "trace_id", "creator", F.concat(F.lit("n"), F.col("creator").cast("string")).alias("name"),
    )
    anchor = t.allocations.filter(F.col("creator") >= half(t)).groupBy("trace_id").agg(
        F.min("creator").alias("creator")
    )
    named = spaced.unionByName(anchor.withColumn("name", F.lit("anchor")))
    return named.withColumn("color", F.lit("#aabbcc"))


NOTES_SQL = """
note AS (
  SELECT trace_id, creator, 'n' || CAST(creator AS VARCHAR) AS name FROM al WHERE creator % 1000 = 0
  UNION ALL SELECT trace_id, min(creator), 'anchor' FROM al WHERE creator >= (SELECT h FROM pos) GROUP BY trace_id)"""
