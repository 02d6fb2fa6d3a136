"""F rows: projections, predicates, facets and the field catalog."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lifetrace.functions.predicates import (
    KiB, alloc, duration, free, malloc, where, with_allocation, with_named,
)
from lifetrace.operators import annotate, fields, filters
from lifetrace.session import staged
from lifetrace.suite.sql import HALF, QUARTER, over
from lifetrace.suite.tables import MEMBERS_SQL, NOTES_SQL, dirty, half, members, notes, orders, quarter

ENTRIES = {}
_T = {"orders": orders, "events": dirty}


def _pick(name, trace, test, condition, extra=""):
    """A predicate as a filter, against the same condition in SQL."""
    ENTRIES[name] = (
        lambda s, d: where(_T[trace](s, d).allocations, test()).select("creator"),
        over(trace, f"SELECT creator FROM al WHERE {condition}", extra),
    )


def _project(name, trace, columns, text, extra=""):
    ENTRIES[name] = (
        lambda s, d: _T[trace](s, d).allocations.select("creator", *columns()),
        over(trace, f"SELECT creator, {text} FROM al", extra),
    )


_pick("F1_filter_not_freed", "orders", lambda: ~alloc.freed, "NOT freed")
_project(
    "F2_alloc_fields", "events",
    lambda: ["id", "addr", "end_span", "span", "size", "usable", "freed", "lifetime"],
    "id, addr, end_span, span, size, usable, freed, lifetime",
)
_project(
    "F3_malloc_fields", "events",
    lambda: [F.col("creator").alias("seq"), "birth_t", "site", "thr", "stack"],
    "creator AS seq, birth_t, site, thr, stack",
)
_project("F4_free_fields", "events", lambda: ["death", "death_t"], "death, death_t")


_K = "CAST(json_extract('{' || extras || '}', '$.k') AS BIGINT)"
_LANE = "json_extract_string('{' || extras || '}', '$.lane')"
_HOT = "CAST(json_extract('{' || extras || '}', '$.hot') AS VARCHAR)"
_LOAD = "CAST(json_extract('{' || extras || '}', '$.load') AS DOUBLE)"
_REASON = "json_extract_string('{' || death_extras || '}', '$.reason')"
_project(
    "F5_custom_fields", "events",
    lambda: [
        malloc.field("k", "int").col.cast("bigint").alias("k"),
        malloc.field("lane", "string").col.alias("lane"),
        malloc.field("hot", "bool").raw.alias("hot"),
        F.coalesce(
            malloc.field("load", "float").double, malloc.field("load", "float").col.cast("double")
        ).alias("load"),
        free.field("reason", "string").col.alias("reason"),
    ],
    f"{_K} AS k, {_LANE} AS lane, CASE {_HOT} WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS hot, "
    f"{_LOAD} AS load, {_REASON} AS reason",
)


def _pick_of(name, trace, test, condition):
    """As ``_pick``; the test looks its fields up in the trace's catalog."""
    ENTRIES[name] = (
        lambda s, d: where(_T[trace](s, d).allocations, test(_T[trace](s, d))).select("creator"),
        over(trace, f"SELECT creator FROM al WHERE {condition}"),
    )


_pick_of("F5_filter_on_field", "events", lambda t: malloc.of(t).field("k") == 42, f"{_K} = 42")
_pick_of("F5_filter_on_death_field", "events", lambda t: free.of(t).field("reason") == "r1", f"{_REASON} = 'r1'")
_pick_of("F5_float_field_range", "events", lambda t: malloc.of(t).field("load").between(3, 17.5), f"{_LOAD} >= 3 AND {_LOAD} < 17.5")
_pick_of("F5_flag_and_string", "events", lambda t: malloc.of(t).field("hot") & (malloc.of(t).field("lane") != "L1"),
         f"{_HOT} = 'true' AND {_LANE} <> 'L1'")


def _two_kinds(s, d):
    """The trace as two: in one ``k`` is a number, in the other a string."""
    t = dirty(s, d)

    def split(df, position):
        odd = F.col(position) % 2 == 1
        text = F.regexp_replace("extras", '"k":([0-9]+)', '"k":"$1"')
        out = df.withColumn("trace_id", F.when(odd, "odd").otherwise("even"))
        return out.withColumn("extras", F.when(odd, text).otherwise(F.col("extras"))).withColumn("custom", fields.parsed("extras"))

    events, rejects = split(t.events, "seq"), t.rejects.filter("false")
    kinds = replace(t, events=events, allocations=split(t.allocations, "creator"), rejects=rejects)
    return replace(kinds, fields=staged(fields.catalog_of(events, rejects), "fields"))


def _either_kind(s, d):
    t = _two_kinds(s, d)
    k = malloc.of(t).field("k")
    return where(t.allocations, (k == 42) | k.startswith("4")).select("trace_id", "creator")


ENTRIES["F5_kinds_by_trace"] = (
    _either_kind,
    over("events", f"""SELECT CASE WHEN creator % 2 = 1 THEN 'odd' ELSE 'even' END AS trace_id, creator FROM al
         WHERE (creator % 2 = 0 AND {_K} = 42) OR (creator % 2 = 1 AND starts_with(CAST({_K} AS VARCHAR), '4'))"""),
)
ENTRIES["F27_kinds_by_trace"] = (
    lambda s, d: _two_kinds(s, d).fields.filter("name IN ('k', 'lane')").select("trace_id", "name", "type", "events"),
    over("events", """SELECT CASE WHEN seq % 2 = 1 THEN 'odd' ELSE 'even' END AS trace_id, key AS name,
           CASE WHEN key = 'k' AND seq % 2 = 0 THEN 'int' ELSE 'string' END AS type, count(*) AS events
         FROM (SELECT seq, unnest(json_keys('{' || extras || '}')) AS key FROM ev WHERE extras IS NOT NULL)
         WHERE key IN ('k', 'lane') GROUP BY ALL"""),
)
_pick("F6_equal", "events", lambda: malloc.site == "site_3", "site = 'site_3'")
_pick("F6_not_equal_missing_false", "events", lambda: malloc.site != "site_3", "site IS NOT NULL AND site <> 'site_3'")
_pick("F6_float_literal_exact", "orders", lambda: (alloc.size > 100000.5) & (alloc.size != 200000.0),
      "size >= 100001 AND size <> 200000")
_pick("F7_order_numbers", "orders", lambda: alloc.size >= KiB(256), "size >= 262144")
_pick("F7_order_strings", "events", lambda: malloc.site < "site_4", "site < 'site_4'")
_pick("F8_chained", "orders", lambda: alloc.size.between(1000, 50000), "1000 <= size AND size < 50000")
_pick(
    "F9_boolean", "events",
    lambda: (~(malloc.site == "site_1") & (alloc.size > 100)) | ~(alloc.usable == 64),
    "(NOT coalesce(site = 'site_1', FALSE) AND size > 100) OR NOT coalesce(usable = 64, FALSE)",
)
_pick(
    "F9_not_missing_flag", "events", lambda: ~malloc.field("hot", "bool"),
    f"NOT coalesce({_HOT} = 'true', FALSE)",
)
_pick("F10_in_threads", "events", lambda: malloc.thread.isin([2, 4]), "thr IN (2, 4)")
_pick(
    "F10_in_mixed_numbers", "events", lambda: malloc.field("load", "float").isin([17.5, 3, 2.0]),
    f"{_LOAD} IN (17.5, 3, 2)",
)
_pick("F11_in_range", "orders", lambda: malloc.time.between(800000000, 900000000),
      "birth_t >= 800000000 AND birth_t < 900000000")
_pick("F12_substring", "events", lambda: malloc.stack.contains("step_3"), "contains(stack, 'step_3')")
_pick("F13_starts_ends", "orders", lambda: malloc.site.startswith("1-") | malloc.site.endswith("LOW"),
      "starts_with(site, '1-') OR suffix(site, 'LOW')")
_pick("F14_span_overlaps", "orders", lambda: alloc.span.overlaps(16777216 * 10, 16777216 * 20),
      "addr < 335544320 AND end_span > 167772160")
_pick("F15_is_none", "events", lambda: malloc.thread.is_none() | free.seq.is_none(), "thr IS NULL OR death IS NULL")
_pick("F15_is_not_none", "events", lambda: alloc.usable.is_not_none() & alloc.lifetime.is_not_none(),
      "usable IS NOT NULL AND lifetime IS NOT NULL")
_pick("F16_arithmetic", "events", lambda: (alloc.usable - alloc.size > 20) | (abs(malloc.seq - 5000) <= 100),
      "usable - size > 20 OR abs(creator - 5000) <= 100")
_pick("F16_float_widens", "events", lambda: malloc.field("load", "float") + 0.5 > 24,
      f"{_LOAD} + 0.5 > 24")
ENTRIES["F17_tag_count"] = (
    lambda s, d: where(
        annotate.with_tags(orders(s, d).allocations, members(orders(s, d))), alloc.tags.length() >= 2
    ).select("creator"),
    over("orders", "SELECT creator FROM alt WHERE len(tags) >= 2", MEMBERS_SQL),
)
ENTRIES["F18_tag_member"] = (
    lambda s, d: annotate.having(orders(s, d).allocations, members(orders(s, d)), "hot").select("creator"),
    over("orders", "SELECT creator FROM alt WHERE list_contains(tags, 'hot')", MEMBERS_SQL),
)
ENTRIES["F18_tag_in_predicate"] = (
    lambda s, d: where(
        annotate.with_tags(dirty(s, d).allocations, members(dirty(s, d))), alloc.tags.has("hot") & ~alloc.freed
    ).select("creator"),
    over("events", "SELECT creator FROM alt WHERE list_contains(tags, 'hot') AND NOT freed", MEMBERS_SQL),
)
ENTRIES["F19_tags_equal"] = (
    lambda s, d: annotate.exactly(dirty(s, d).allocations, members(dirty(s, d)), ["hot", "cold"], []).select("creator"),
    over("events", "SELECT creator FROM alt WHERE tags = ['cold','hot'] OR len(tags) = 0", MEMBERS_SQL),
)
ENTRIES["F19_same_set_in_predicate"] = (
    lambda s, d: where(
        annotate.with_tags(dirty(s, d).allocations, members(dirty(s, d))),
        alloc.tags.same_set(["hot", "cold"]) | alloc.tags.same_set([]),
    ).select("creator"),
    over("events", "SELECT creator FROM alt WHERE tags = ['cold','hot'] OR len(tags) = 0", MEMBERS_SQL),
)


def _near_named(s, d):
    t = orders(s, d)
    allocations, anchor = with_named(t.allocations, notes(t), "anchor")
    return where(allocations, abs(malloc.seq - anchor.seq) <= 1000).select("creator")


def _larger_than_id(s, d):
    allocations, one = with_allocation(orders(s, d).allocations, 77)
    return where(allocations, alloc.size > one.size).select("creator")


ENTRIES["F20_named"] = (
    lambda s, d: _near_named(s, d),
    over(
        "orders",
        "SELECT creator FROM al WHERE abs(creator - (SELECT creator FROM note WHERE name = 'anchor')) <= 1000",
        NOTES_SQL,
    ),
)
ENTRIES["F21_allocation_by_id"] = (
    lambda s, d: _larger_than_id(s, d),
    over("orders", "SELECT creator FROM al WHERE size > (SELECT size FROM al WHERE id = 77)"),
)
_pick("F22_unit_literals", "events", lambda: alloc.lifetime >= duration(90, "s", "us"), "lifetime >= 90000000")
ENTRIES["F23_facets"] = (
    lambda s, d: annotate.with_tags(dirty(s, d).allocations, members(dirty(s, d)))
    .filter(
        filters.facets(
            sites=["site_1", "site_2", "site_3"], threads=[1, 2, 3], tags=["hot", filters.UNTAGGED],
            size_min=10, size_max=450, address_ranges=[(0, 200000), (300000, 400000)],
        )
    )
    .select("creator"),
    over(
        "events",
        """SELECT creator FROM alt WHERE (site IS NULL OR site IN ('site_1','site_2','site_3'))
           AND (thr IS NULL OR thr IN (1,2,3)) AND (len(tags) = 0 OR list_contains(tags,'hot'))
           AND size BETWEEN 10 AND 450 AND ((addr < 200000 AND end_span > 0) OR (addr < 400000 AND end_span > 300000))""",
        MEMBERS_SQL,
    ),
)
ENTRIES["F23_empty_selection"] = (
    lambda s, d: dirty(s, d).allocations.filter(filters.facets(sites=[])).select("creator"),
    over("events", "SELECT creator FROM al WHERE site IS NULL"),
)
ENTRIES["F24_crop"] = (
    lambda s, d: filters.visibility(
        dirty(s, d).allocations, (alloc.size >= 100).column(), hide=True, crop=(quarter(dirty(s, d)), half(dirty(s, d)))
    ),
    over(
        "events",
        f"SELECT trace_id, creator, NOT size >= 100 AS hidden, (NOT size >= 100) OR NOT (creator >= {QUARTER} AND creator < {HALF}) AS dimmed FROM al",
    ),
)
_HALF = "((op IN ('M','R') AND size >= 250) OR (op = 'F' AND target_size >= 250))"
ENTRIES["F25_filtered_events"] = (
    lambda s, d: filters.filtered_events(
        dirty(s, d).events, where(dirty(s, d).allocations, alloc.size >= 250)
    ).select("seq", "op"),
    over("events", f"SELECT seq, op FROM ev WHERE {_HALF}"),
)
ENTRIES["F26_filtered_position"] = (
    lambda s, d: filters.filtered_position(
        dirty(s, d).events, where(dirty(s, d).allocations, alloc.size >= 250), half(dirty(s, d))
    ),
    over("events", f"SELECT 'events' AS trace_id, count(*) AS position FROM ev WHERE seq < {HALF} AND {_HALF}"),
)
ENTRIES["F27_field_catalog"] = (
    lambda s, d: fields.catalog(dirty(s, d)),
    over(
        "events",
        """SELECT 'events' AS trace_id, key AS name,
             CASE WHEN bool_or(ty IN ('OBJECT','ARRAY')) THEN NULL
                  WHEN bool_and(ty = 'NULL') THEN NULL
                  WHEN bool_and(ty IN ('UBIGINT','BIGINT','NULL')) THEN 'int'
                  WHEN bool_and(ty IN ('UBIGINT','BIGINT','DOUBLE','NULL')) THEN 'float'
                  WHEN bool_and(ty IN ('VARCHAR','NULL')) THEN 'string'
                  WHEN bool_and(ty IN ('BOOLEAN','NULL')) THEN 'bool' END AS type,
             bool_or(ty = 'NULL') AS optional, count(*) AS events, min(ord) AS first_ord
           FROM (SELECT ord, key, json_type('{' || extras || '}', '$.' || key) AS ty
                 FROM (SELECT ord, extras, unnest(json_keys('{' || extras || '}')) AS key FROM mk
                       WHERE extras IS NOT NULL AND (ok OR (op IN ('M','R') AND addr IS NULL))))
           GROUP BY key""",
    ),
)
