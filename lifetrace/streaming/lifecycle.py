"""R2: resolving ids on a stream.

A batch is resolved like a whole trace: along one id a free succeeds exactly
when the step before it is a create. What came before the batch enters as one
or two steps per id that the batch touches: its latest create, and the kill
that ended it. A batch must hold later events than the ones before it.

The state has one row per id: the latest creator and whether it is dead. A dead
id is kept, because a later free of it is a double free and not an unknown one.
A batch writes the rows of the ids it touched. Numbers keep the types of the
input, so a trace kept as DECIMAL(20,0) streams as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifetrace.plans import prefix
from lifetrace.streaming.runs import merged_state, write_batch, write_changes

KEY = ["trace_id", "key"]
_CARRIED = ("t", "addr", "size")


def steps(events: DataFrame) -> DataFrame:
    """Kill and create steps of accepted events, a resize giving both."""
    kill, make = F.col("op").isin("F", "R"), F.col("op").isin("M", "R")
    parts = F.array_compact(
        F.array(
            F.when(kill & F.col("kid").isNotNull(), F.struct(F.col("kid").alias("key"), F.lit(0).alias("sub"))),
            F.when(make & F.col("registered"), F.struct(F.col("id").alias("key"), F.lit(1).alias("sub"))),
        )
    )
    return events.select("trace_id", "seq", "t", "addr", "size", F.explode(parts).alias("p")).select(
        "trace_id", "p.key", "seq", "p.sub", "t", "addr", "size"
    )


def without_id(events: DataFrame) -> DataFrame:
    """Frees and resizes that name no id: unknown, whatever came before."""
    none = lambda like, name: F.lit(None).cast(events.schema[like].dataType).alias(name)
    return events.filter(F.col("op").isin("F", "R") & F.col("kid").isNull()).select(
        "trace_id", "seq", F.lit("kill").alias("what"), F.lit("unknown").alias("status"),
        none("seq", "target"), *[none(c, f"target_{c}") for c in _CARRIED], "t",
    )


def _state_schema(rows: DataFrame) -> T.StructType:
    kind = lambda c: rows.schema[c].dataType
    return T.StructType(
        [T.StructField(c, kind(c)) for c in KEY]
        + [T.StructField("at", T.LongType()), T.StructField("creator", T.LongType())]
        + [T.StructField(c, kind(c)) for c in _CARRIED]
        + [T.StructField("dead", T.BooleanType())]
    )


def _latest(state: DataFrame) -> DataFrame:
    """The last row of each id among the batches that wrote one."""
    rest = [c for c in state.columns if c not in KEY]
    return state.groupBy(*KEY).agg(F.max(F.struct(*rest)).alias("s")).select(*KEY, "s.*")


def _order(seq: Column, sub: Column) -> Column:
    return seq.cast("bigint") * 4 + sub


def _earlier(state: DataFrame) -> DataFrame:
    """State rows as steps ahead of a batch: a create, and a kill where it is dead."""
    subs = F.when(F.col("dead"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return state.select(
        *KEY, F.col("creator").alias("seq"), F.explode(subs).alias("sub"), *_CARRIED, F.lit(True).alias("known")
    )


def resolve_sink(out: str, state: str):
    """R2: a foreachBatch sink writing one row per step of accepted events
    (trace_id, seq, op, t, id, kid, addr, size, registered): kills with status and
    target, creates with reuse."""

    def sink(batch: DataFrame, number: int) -> None:
        now = steps(batch)
        schema = _state_schema(now)
        before = merged_state(batch.sparkSession, state, number, schema, _latest, KEY, now)
        touched = before.join(now.select(*KEY).distinct(), KEY, "left_semi")
        every = now.withColumn("known", F.lit(False)).unionByName(_earlier(touched))
        every = every.withColumn("pos", _order(F.col("seq"), F.col("sub"))).withColumn(
            "made", F.when(F.col("sub") == 1, F.struct(F.col("seq").alias("creator"), *_CARRIED))
        )
        linked = prefix.scan(
            every, KEY, ["pos"], prefix.block_of("pos", prefix.SPARSE_BITS),
            [
                prefix.Run("ahead", "last", F.col("sub"), inclusive=False),
                prefix.Run("create", "last", F.col("made"), inclusive=False),
            ],
            levels=2,
        ).filter("not known")
        write_batch(_status(linked).unionByName(without_id(batch)), out, number)
        write_changes(_after(every).select(*schema.names), state, number, schema, _latest, KEY)

    return sink


def _status(linked: DataFrame) -> DataFrame:
    kill, live = F.col("sub") == 0, F.coalesce(F.col("ahead") == 1, F.lit(False))
    status = (
        F.when(kill & live, "ok").when(kill & F.col("create").isNotNull(), "double").when(kill, "unknown")
        .when(live, "reused").otherwise("new")
    )
    target = lambda c: F.when(kill & live, F.col(f"create.{c}"))
    return linked.select(
        "trace_id", "seq", F.when(kill, "kill").otherwise("create").alias("what"), status.alias("status"),
        target("creator").alias("target"), *[target(c).alias(f"target_{c}") for c in _CARRIED], "t",
    )


def _after(every: DataFrame) -> DataFrame:
    """The state of the touched ids; an id that was only ever freed has none."""
    return (
        every.groupBy(*KEY)
        .agg(
            F.max("seq").alias("at"),
            F.max_by("made", F.when(F.col("made").isNotNull(), F.col("pos"))).alias("m"),
            (F.max_by("sub", "pos") != 1).alias("dead"),
        )
        .filter("m is not null")
        .select(*KEY, "at", "m.creator", *[f"m.{c}" for c in _CARRIED], "dead")
    )
