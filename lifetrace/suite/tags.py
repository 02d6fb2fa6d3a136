"""E rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.functions.predicates import alloc, where
from lifetrace.operators import annotate
from lifetrace.suite.sql import HALF, QUARTER, over
from lifetrace.suite.tables import MEMBERS_SQL, dirty, half, members, orders, quarter, times

ENTRIES = {}


def _entry(name, fn, sql, trace="orders"):
    t = orders if trace == "orders" else dirty
    ENTRIES[name] = (
        lambda s, d: fn(t(s, d), members(t(s, d))),
        over(trace, sql, MEMBERS_SQL),
    )


def _big(t):
    return where(t.allocations, alloc.size >= 300000)


_entry(
    "E1_add", lambda t, m: annotate.add(m, _big(t), "hot").select("tag", "creator"),
    "SELECT tag, creator FROM mem UNION SELECT 'hot', creator FROM al WHERE size >= 300000",
)
_entry(
    "E2_remove", lambda t, m: annotate.remove(m, _big(t), "hot").select("tag", "creator"),
    "SELECT tag, creator FROM mem EXCEPT SELECT 'hot', creator FROM al WHERE size >= 300000",
)
_entry(
    "E3_replace", lambda t, m: annotate.replace(m, _big(t), "hot").select("tag", "creator"),
    "SELECT tag, creator FROM mem WHERE tag <> 'hot' UNION ALL SELECT 'hot', creator FROM al WHERE size >= 300000",
)
_entry(
    "E4_changed", lambda t, m: annotate.changed(m, annotate.replace(m, _big(t), "hot")).select("tag", "changed"),
    """SELECT tag, CASE WHEN tag = 'hot' THEN (SELECT count(*) FROM al WHERE (creator % 7 = 0) <> (size >= 300000)) ELSE 0 END AS changed
       FROM (SELECT DISTINCT tag FROM mem)""",
)
_entry(
    "E5_tag_born_in_range",
    lambda t, m: annotate.tagged(annotate.born_in(_big(t), quarter(t), half(t)), "range").select("tag", "creator"),
    f"SELECT 'range' AS tag, creator FROM al WHERE size >= 300000 AND creator >= {QUARTER} AND creator < {HALF}",
)
_entry(
    "E6_tag_freed_in_range",
    lambda t, m: annotate.tagged(annotate.freed_in(t.allocations, quarter(t), half(t)), "gone").select("tag", "creator"),
    f"SELECT 'gone' AS tag, target AS creator FROM ev WHERE target IS NOT NULL AND seq >= {QUARTER} AND seq < {HALF}", "events",
)
_entry(
    "E7_tag_time_range",
    lambda t, m: annotate.in_time(t.allocations, times(t)[0], sum(times(t)) // 2, freed=True).select("creator"),
    """SELECT target AS creator FROM ev, (SELECT count(*) FILTER (t < (SELECT t0 FROM pos)) AS lo, count(*) FILTER (t <= (SELECT (t0 + t1) // 2 FROM pos)) AS hi FROM ev)
       WHERE target IS NOT NULL AND seq >= lo AND seq < hi""",
)
_entry(
    "E8_tag_matches", lambda t, m: annotate.add(m, where(t.allocations, ~alloc.freed), "live").select("tag", "creator"),
    "SELECT tag, creator FROM mem UNION SELECT 'live', creator FROM al WHERE NOT freed",
)
_entry(
    "E9_retag", lambda t, m: annotate.retag(m, "hot", "cold").select("tag", "creator"),
    "SELECT DISTINCT CASE WHEN tag = 'hot' THEN 'cold' ELSE tag END AS tag, creator FROM mem",
)
_entry(
    "E9_delete", lambda t, m: annotate.retag(m, "hot", None).select("tag", "creator"),
    "SELECT tag, creator FROM mem WHERE tag <> 'hot'",
)
_entry(
    "E10_set_tags", lambda t, m: annotate.set_tags(m, "orders", 77, ["a", "b"]).select("tag", "creator"),
    "SELECT tag, creator FROM mem WHERE creator <> 77 UNION ALL SELECT 'a', 77 UNION ALL SELECT 'b', 77",
)
_entry(
    "E11_export", lambda t, m: annotate.export_members(m).select("tag", "creator", "place"),
    "SELECT tag, creator, row_number() OVER (PARTITION BY tag ORDER BY creator) - 1 AS place FROM mem",
)
_entry(
    "E12_import",
    lambda t, m: annotate.import_members(
        m, t.events.filter("seq % 13 = 0").select("trace_id", F.lit("bulk").alias("tag"), F.col("seq").alias("creator")),
        t.allocations,
    ).select("tag", "creator"),
    "SELECT tag, creator FROM mem UNION SELECT 'bulk', seq FROM ev WHERE seq % 13 = 0 AND op IN ('M','R')", "events",
)
