"""O rows: total orders in full, and pages of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.functions.predicates import alloc, where
from lifetrace.operators import aggregate, paging
from lifetrace.suite.aggregates import MEASURES_SQL, longs
from lifetrace.suite.sql import over
from lifetrace.suite.tables import MEMBERS_SQL, NOTES_SQL, dirty, members, notes, orders

ENTRIES = {}

_BY = {
    "O1_creator_asc": ("creator-asc", "creator"),
    "O2_birth_desc": ("birth-desc", "creator DESC"),
    "O3_size_desc": ("size-desc", "size DESC, creator"),
    "O4_lifetime_desc": ("lifetime-desc", "lifetime DESC NULLS FIRST, creator"),
    "O5_death_desc": ("death-desc", "death DESC NULLS LAST, creator"),
}
for _key, (_order, _text) in _BY.items():
    ENTRIES[_key] = (
        lambda s, d, o=_order: paging.positions(dirty(s, d).allocations, o).select("position", "creator"),
        over(
            "events",
            f"""SELECT row_number() OVER (ORDER BY {_text}) - 1 AS position, creator FROM al""",
        ),
    )
ENTRIES["O6_page_with_totals"] = (
    lambda s, d: longs(
        paging.page(where(orders(s, d).allocations, alloc.size >= 100000), "size-desc", 200, 50),
        "matched_bytes", "position",
    ).select("position", "creator", "matched", "matched_bytes", "next"),
    over(
        "orders",
        """SELECT row_number() OVER (ORDER BY size DESC, creator) - 1 AS position, creator,
           (SELECT count(*) FROM al WHERE size >= 100000) AS matched,
           (SELECT CAST(sum(size) AS BIGINT) FROM al WHERE size >= 100000) AS matched_bytes,
           CAST(250 AS BIGINT) AS next FROM al WHERE size >= 100000 ORDER BY size DESC, creator LIMIT 50 OFFSET 200""",
    ),
)
ENTRIES["O6_keyset_page"] = (
    lambda s, d: paging.after(
        dirty(s, d).allocations, "death-desc", {"trace_id": "events", "creator": 5000, "death": 5001}, 100
    ).select("creator", "death"),
    over(
        "events",
        """SELECT creator, death FROM al WHERE death < 5001 OR (death = 5001 AND creator > 5000) OR death IS NULL
           ORDER BY death DESC NULLS LAST, creator LIMIT 100""",
    ),
)
ENTRIES["O7_top_groups"] = (
    lambda s, d: longs(
        aggregate.top(aggregate.summarize(dirty(s, d).allocations, "site"), 5),
        "requested", "usable", "place",
    ).drop("trace_id"),
    over(
        "events",
        f"""SELECT *, row_number() OVER (ORDER BY requested DESC, allocations DESC, key) AS place,
            (SELECT count(DISTINCT coalesce(site,'(none)')) FROM al) - 5 AS omitted
            FROM (SELECT coalesce(site,'(none)') AS key, {MEASURES_SQL} FROM al GROUP BY 1)
            ORDER BY requested DESC, allocations DESC, key LIMIT 5""",
    ),
)
_COMPACT = "trace_id creator id addr size usable birth_t death death_t lifetime site thr"
ENTRIES["O8_compact_rows"] = (
    lambda s, d: paging.compact(
        orders(s, d).allocations, notes(orders(s, d)), members(orders(s, d))
    ).withColumn("tags", F.concat_ws(",", "tags")),
    over(
        "orders",
        f"""SELECT {', '.join('alt.' + c for c in _COMPACT.split())}, note.name, CASE WHEN note.name IS NOT NULL THEN '#aabbcc' END AS color,
            array_to_string(tags, ',') AS tags FROM alt LEFT JOIN note USING (trace_id, creator)""",
        MEMBERS_SQL + "," + NOTES_SQL,
    ),
)
