"""G rows: a revisioned log of annotations, checked and folded to state.

One row per change:

  trace_id, revision, type, creator, id (tag, bookmark, mark or filter),
  tag_ids (array), creators (array), present, name, color, seq, t, addr, source

Nothing is replayed: an object's state is its last write, and a membership is
its last explicit write unless its tag or its allocation was reset later.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.plans import prefix
from lifetrace.plans.small import per_trace
from lifetrace.session import staged

# Change types and the limits on what they carry.
PUTS = {"tag": "putTag", "bookmark": "putBookmark", "mark": "putAddressMark", "filter": "putSavedFilter"}
DELETES = {
    "tag": "deleteTag", "bookmark": "deleteBookmark", "mark": "deleteAddressMark",
    "filter": "deleteSavedFilter",
}
SET_NAME, SET_COLOR, SET_TAG = "setAllocationName", "setAllocationColor", "setAllocationTag"
REPLACE_TAGS, REPLACE_MEMBERS = "replaceAllocationTags", "replaceTagMembers"
MAX_TAGS = 255
MAX_ID = 64
MAX_NAME_BYTES = 256
MAX_SOURCE_BYTES = 16 << 10
# Why a change is refused.
BAD_ID, BAD_NAME, BAD_COLOR, BAD_TIME = "invalid persistent id", "invalid name", "invalid color", "invalid time"
BAD_ADDRESS, TOO_LARGE, TOO_MANY = "invalid address", "filter is too large", "too many tags"
NO_ALLOCATION, NO_TAG, BAD_BOOKMARK = "allocation not found", "unknown tag", "invalid bookmark"
# Ours: the line is no change at all.
NO_TYPE, NO_FIELD = "unknown type", "missing field"

# What a change of each type must carry besides its type.
REQUIRED = {
    "putTag": ["id", "name", "color"], "putBookmark": ["id", "name", "seq", "t"],
    "putAddressMark": ["id", "name", "addr_given"], "putSavedFilter": ["id", "name", "source"],
    "deleteTag": ["id"], "deleteBookmark": ["id"], "deleteAddressMark": ["id"], "deleteSavedFilter": ["id"],
    "setAllocationName": ["creator"], "setAllocationColor": ["creator"],
    "setAllocationTag": ["creator", "id", "present"],
    "replaceAllocationTags": ["creator", "tag_ids"], "replaceTagMembers": ["id", "creators"],
}

SCHEMA = (
    "trace_id string, revision bigint, type string, creator bigint, id string, tag_ids array<string>, "
    "creators array<bigint>, present boolean, name string, color string, seq bigint, t double, "
    "addr string, source string"
)
_KEEP = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]


def _trim(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")  # white space of all of Unicode


def normalised(changes: DataFrame) -> DataFrame:
    """Trimmed ids and names, lower-case colours, canonical addresses."""
    digits = F.regexp_extract(_trim("addr"), "^0[xX]([0-9a-fA-F]+)$", 1)
    short = F.regexp_replace(F.lower(digits), "^0+(?=.)", "")
    return changes.withColumns(
        {
            "addr_given": F.col("addr"),
            "id": _trim("id"),
            "name": _trim("name"),
            "color": F.lower("color"),
            "addr": F.when(digits != "", F.concat(F.lit("0x"), short)),
            "tag_ids": F.array_sort(F.array_distinct(F.transform("tag_ids", _trim))),
        }
    )


def _id_ok(col: Column) -> Column:
    return F.coalesce((F.length(col) <= MAX_ID) & col.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def _shape_problem() -> Column:
    """Why a normalised change is invalid on its own, else null."""
    kind = F.col("type")
    known = F.coalesce(kind.isin(*REQUIRED), F.lit(False))
    complete = F.lit(True)
    for name, fields in REQUIRED.items():
        there = F.lit(True)
        for field in fields:
            there = there & F.col(field).isNotNull()
        complete = complete & ((kind != name) | there)
    # arrays may hold nothing that is missing either
    whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(True))
    complete = complete & whole("tag_ids") & whole("creators")
    puts, deletes = list(PUTS.values()), list(DELETES.values())
    named = kind.isin(*puts) | ((kind == SET_NAME) & F.col("name").isNotNull())
    coloured = (kind == PUTS["tag"]) | ((kind == SET_COLOR) & F.col("color").isNotNull())
    name_ok = F.coalesce(
        (F.octet_length("name") > 0) & (F.octet_length("name") <= MAX_NAME_BYTES), F.lit(False)
    )
    color_ok = F.coalesce(F.col("color").rlike("^#[0-9a-f]{6}$"), F.lit(False))
    with_id = kind.isin(*puts, *deletes, SET_TAG, REPLACE_MEMBERS)
    addr_ok = F.coalesce(F.length("addr") <= 18, F.lit(False))
    time_ok = F.coalesce(~F.isnan("t") & (F.abs("t") != float("inf")), F.lit(False))
    return (
        F.when(~known, NO_TYPE)
        .when(~complete, NO_FIELD)
        .when(with_id & ~_id_ok(F.col("id")), BAD_ID)
        .when((kind == REPLACE_TAGS) & ~F.forall("tag_ids", _id_ok), BAD_ID)
        .when(named & ~name_ok, BAD_NAME)
        .when(coloured & ~color_ok, BAD_COLOR)
        .when((kind == PUTS["bookmark"]) & ~time_ok, BAD_TIME)
        .when((kind == PUTS["mark"]) & ~addr_ok, BAD_ADDRESS)
        .when((kind == PUTS["filter"]) & (F.octet_length("source") > MAX_SOURCE_BYTES), TOO_LARGE)
    )


def validated(
    changes: DataFrame, allocations: DataFrame, events: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Clean changes, and rejects with a ``reason``.

    References are checked by joins: creators against the allocations, tags
    against the definitions in force at the change's own revision. The log is read and
    checked for shape once; the checks that follow, and both results, read written tables.
    """
    rows = staged(normalised(changes).withColumn("reason", _shape_problem()), "shaped-changes")
    key = ["trace_id", "revision"]
    fine = rows.filter("reason is null")

    counts = per_trace(events.groupBy("trace_id").agg((F.max("seq") + 1).alias("_events")))
    marks = fine.filter(F.col("type") == PUTS["bookmark"]).join(counts, "trace_id", "left")
    late = marks.filter(F.col("seq") > F.coalesce("_events", F.lit(0))).select(
        *key, F.lit(BAD_BOOKMARK).alias("why")
    )
    named = fine.select(
        *key,
        F.explode(
            F.when(F.col("type").isin(SET_NAME, SET_COLOR, SET_TAG, REPLACE_TAGS), F.array("creator"))
            .when(F.col("type") == REPLACE_MEMBERS, F.col("creators"))
            .otherwise(F.array().cast("array<bigint>"))
        ).alias("creator"),
    )
    missing = named.join(
        allocations.select("trace_id", "creator"), ["trace_id", "creator"], "left_anti"
    ).select(*key, F.lit(NO_ALLOCATION).alias("why"))

    uses = fine.select(
        *key,
        F.explode(
            F.when(F.col("type").isin(SET_TAG, REPLACE_MEMBERS), F.array("id"))
            .when(F.col("type") == REPLACE_TAGS, F.col("tag_ids"))
            .otherwise(F.array().cast("array<string>"))
        ).alias("id"),
        F.lit(None).cast("boolean").alias("defined"),
    )
    kinds = [PUTS["tag"], DELETES["tag"]]
    definitions = fine.filter(F.col("type").isin(*kinds)).select(
        *key, "id", (F.col("type") == kinds[0]).alias("defined")
    )
    excess = staged(_too_many(definitions), "excess-tags")
    definitions = definitions.join(excess, key, "left_anti")
    excess = excess.select(*key, F.lit(TOO_MANY).alias("why"))
    known = prefix.scan(
        definitions.unionByName(uses), ["trace_id", "id"], ["revision"],
        prefix.block_of("revision"), [prefix.Run("known", "last", F.col("defined"))],
    )
    unknown = known.filter("defined is null and not coalesce(known, false)").select(
        *key, F.lit(NO_TAG).alias("why")
    )
    order = {NO_ALLOCATION: 0, NO_TAG: 1, BAD_BOOKMARK: 2, TOO_MANY: 3}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    found = (
        missing.unionByName(unknown).unionByName(late).unionByName(excess)
        .groupBy(*key).agg(F.min_by("why", rank[F.col("why")]).alias("why"))
    )
    joined = rows.join(found, key, "left").withColumn("reason", F.coalesce("reason", "why"))
    joined = staged(joined.select(*_KEEP, "reason"), "checked-changes")
    return joined.filter("reason is null").select(*_KEEP), joined.filter("reason is not null").select(*_KEEP, "reason")


def _too_many(definitions: DataFrame, limit: int = MAX_TAGS) -> DataFrame:
    """New tags put while ``limit`` are already defined.

    If every put were accepted the tags in force would be a running count, and
    a trace where it never passes the limit has no such put. In the others one
    refused put changes what follows, so their definitions (and no other
    changes) are read in order with the at most ``limit`` ids in force.
    """
    by_id = prefix.scan(
        definitions, ["trace_id", "id"], ["revision"], prefix.block_of("revision"),
        [prefix.Run("before", "last", F.col("defined"), inclusive=False)],
    )
    was = F.coalesce("before", F.lit(False))
    step = F.when(F.col("defined") & ~was, 1).when(~F.col("defined") & was, -1).otherwise(0)
    counted = prefix.scan(
        by_id.withColumn("step", step.cast("bigint")), ["trace_id"], ["revision"],
        prefix.block_of("revision"), [prefix.Run("tags", "sum", F.col("step"))],
    )
    full = counted.groupBy("trace_id").agg(F.max("tags").alias("top")).filter(F.col("top") > limit)
    affected = definitions.join(full.select("trace_id"), "trace_id", "left_semi")

    def refused(batches):
        trace, ids = None, set()
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.trace_id != trace:
                    trace, ids = r.trace_id, set()
                if not r.defined:
                    ids.discard(r.id)
                elif r.id in ids or len(ids) < limit:
                    ids.add(r.id)
                else:
                    out.append((r.trace_id, r.revision))
            yield pd.DataFrame(out, columns=["trace_id", "revision"])

    ordered = affected.select("trace_id", "revision", "id", "defined").repartition(
        "trace_id"
    ).sortWithinPartitions("trace_id", "revision")
    return ordered.mapInPandas(refused, "trace_id string, revision bigint")


@dataclass
class State:
    """The folded annotations; every table is keyed by ``trace_id``."""

    tags: DataFrame
    members: DataFrame
    notes: DataFrame
    bookmarks: DataFrame
    marks: DataFrame
    filters: DataFrame


def _objects(changes: DataFrame, what: str, columns: list[str]) -> DataFrame:
    put, delete = PUTS[what], DELETES[what]
    last = changes.filter(F.col("type").isin(put, delete)).groupBy("trace_id", "id").agg(
        F.max_by(F.struct("type", *columns), "revision").alias("v")
    )
    return last.filter(F.col("v.type") == put).select(
        "trace_id", "id", *[F.col(f"v.{c}").alias(c) for c in columns]
    )


def memberships(changes: DataFrame) -> DataFrame:
    """(trace_id, tag, creator) in force after the last change."""
    explicit = changes.filter(F.col("type") == SET_TAG).select(
        "trace_id", "revision", F.col("id").alias("tag"), "creator", "present"
    )
    of_alloc = changes.filter(F.col("type") == REPLACE_TAGS)
    of_tag = changes.filter(F.col("type") == REPLACE_MEMBERS)
    written = explicit.unionByName(
        of_alloc.select("trace_id", "revision", F.explode("tag_ids").alias("tag"), "creator", F.lit(True).alias("present"))
    ).unionByName(
        of_tag.select("trace_id", "revision", F.col("id").alias("tag"), F.explode("creators").alias("creator"), F.lit(True).alias("present"))
    )
    last = written.groupBy("trace_id", "tag", "creator").agg(
        F.max("revision").alias("at"), F.max_by("present", "revision").alias("present")
    ).filter("present")
    tag_reset = changes.filter(F.col("type").isin(REPLACE_MEMBERS, DELETES["tag"])).groupBy(
        "trace_id", F.col("id").alias("tag")
    ).agg(F.max("revision").alias("tag_reset"))
    alloc_reset = of_alloc.groupBy("trace_id", "creator").agg(F.max("revision").alias("alloc_reset"))
    return (
        last.join(tag_reset, ["trace_id", "tag"], "left")
        .join(alloc_reset, ["trace_id", "creator"], "left")
        .filter("at >= coalesce(tag_reset, 0) and at >= coalesce(alloc_reset, 0)")
        .select("trace_id", "tag", "creator")
    )


def fold(changes: DataFrame) -> State:
    """G1: the state after valid changes, whatever order they arrive in."""
    last = lambda kind, col: F.max_by(
        F.when(F.col("type") == kind, F.col(col)), F.when(F.col("type") == kind, F.col("revision"))
    )
    notes = (
        changes.filter(F.col("type").isin(SET_NAME, SET_COLOR))
        .groupBy("trace_id", "creator")
        .agg(last(SET_NAME, "name").alias("name"), last(SET_COLOR, "color").alias("color"))
        .filter("name is not null or color is not null")
    )
    return State(
        tags=_objects(changes, "tag", ["name", "color"]),
        members=memberships(changes),
        notes=notes,
        bookmarks=_objects(changes, "bookmark", ["name", "seq", "t"]),
        marks=_objects(changes, "mark", ["name", "addr"]),
        filters=_objects(changes, "filter", ["name", "source"]),
    )


def counts(state: State) -> DataFrame:
    """How many annotations of each kind a trace has."""
    parts = {
        "named": state.notes.filter("name is not null"), "tags": state.tags,
        "bookmarks": state.bookmarks, "marks": state.marks, "filters": state.filters,
    }
    out = None
    for what, df in parts.items():
        part = df.select("trace_id", F.lit(what).alias("what"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("trace_id", "what").agg(F.count(F.lit(1)).alias("n"))


def since(changes: DataFrame, after: int, page: int | None = None) -> DataFrame:
    """Everything that changed after a revision, or one ``reset`` row.

    Reset when the log no longer reaches back that far, when ``after`` lies
    ahead of it, or when a change without payload (``type`` null) intervened.
    With ``page`` the first that many changes of a trace come, and ``next`` on
    the last of them is the revision to ask from for the rest.
    """
    later = F.col("revision") > after
    state = changes.groupBy("trace_id").agg(
        F.max("revision").alias("current"),
        F.min(F.when(later, F.col("revision"))).alias("first"),
        F.count(F.when(later & F.col("type").isNull(), 1)).alias("bulk"),
    )
    gone = (F.lit(after) > F.col("current")) | (
        (F.lit(after) < F.col("current")) & ~F.coalesce(F.col("first") == after + 1, F.lit(False))
    ) | (F.col("bulk") > 0)
    verdict = state.select("trace_id", "current", gone.alias("reset"))
    rows = changes.filter(later)
    if page is None:
        rows = rows.withColumn("next", F.lit(None).cast("bigint"))
    else:
        # revisions of a log that needs no reset are dense, so a page is a range of them
        stop = F.lit(after).cast("bigint") + page
        last = (F.col("revision") == stop) & (F.col("current") > stop)
        rows = rows.filter(F.col("revision") <= stop).join(
            per_trace(verdict.select("trace_id", "current"), "current"), "trace_id"
        ).withColumn("next", F.when(last, F.col("revision"))).drop("current")
    keeps = per_trace(verdict.filter("not reset").select("trace_id"), "delta")
    return verdict.join(rows.join(keeps, "trace_id", "left_semi"), "trace_id", "left")


def apply_saved(allocations: DataFrame, filters: dict, name: str) -> DataFrame:
    """A saved predicate by its name."""
    from lifetrace.functions.predicates import where

    return where(allocations, filters[name]())
