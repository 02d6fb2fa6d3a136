"""J rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.functions.predicates import malloc, where
from lifetrace.operators import address, annotate, lineage, overlap
from lifetrace.plans import asof
from lifetrace.suite.sql import HALF, over
from lifetrace.suite.tables import MEMBERS_SQL, dirty, half, members, orders

ENTRIES = {}

ENTRIES["J1_kill_to_creator"] = (
    lambda s, d: dirty(s, d).events.filter("target is not null").select("seq", "kid", "target", "target_site"),
    over("events", "SELECT seq, kid, target, target_site FROM ev WHERE target IS NOT NULL"),
)
ENTRIES["J2_creator_to_death_event"] = (
    lambda s, d: dirty(s, d).allocations.select("creator", "site", F.col("death").alias("seq")).join(
        dirty(s, d).events.select("seq", F.col("op").alias("death_op"), F.col("t").alias("death_t"), F.col("site").alias("death_site")),
        "seq", "left",
    ),
    over(
        "events",
        """SELECT a.death AS seq, a.creator, a.site, e.op AS death_op, e.t AS death_t, e.site AS death_site
           FROM al a LEFT JOIN ev e ON e.seq = a.death""",
    ),
)
ENTRIES["J3_resize_relations"] = (
    lambda s, d: dirty(s, d).allocations.filter("realloc_from is not null or realloc_to is not null")
    .select("creator", "realloc_from", "realloc_to"),
    over("events", "SELECT creator, realloc_from, realloc_to FROM al WHERE realloc_from IS NOT NULL OR realloc_to IS NOT NULL"),
)
for _n, _t in (("orders", orders), ("events", dirty)):
    ENTRIES[f"J4_pick_{_n}"] = (
        lambda s, d, t=_t: address.pick(
            t(s, d).allocations.select(
                "trace_id", F.col("creator").alias("point"),
                (F.col("addr") + F.floor(F.col("size") / 2).cast("bigint")).alias("p_addr"),
                (F.col("creator") + 400).alias("p_pos"),
            ),
            t(s, d).allocations, ["point"],
        ).drop("trace_id"),
        over(
            _n,
            """SELECT p.point, max(a.creator) AS newest, arg_max(a.creator, {'a': a.addr, 'c': a.creator}) AS nearest
               FROM (SELECT creator AS point, addr + size // 2 AS p_addr, creator + 400 AS p_pos FROM al) p
               JOIN al a ON a.addr <= p.p_addr AND a.end_span > p.p_addr AND a.creator < p.p_pos
                AND (a.death IS NULL OR a.death >= p.p_pos) GROUP BY p.point""",
        ),
    )
ENTRIES["J5_overlap_semi"] = (
    lambda s, d: overlap.births_meeting_live(orders(s, d).allocations).select("creator"),
    over(
        "orders",
        """SELECT DISTINCT a.creator FROM al a JOIN al b ON b.addr < a.end_span AND b.end_span > a.addr AND b.creator < a.creator
           AND (b.death IS NULL OR b.death > a.creator)""",
    ),
)
ENTRIES["J6_ghosts_orders"] = (
    lambda s, d: address.ghosts(orders(s, d), half(orders(s, d))).drop("trace_id"),
    over(
        "orders",
        f"""SELECT g.creator AS child, count(*) AS holders,
                 arg_max(p.creator, {{'a': p.addr, 'e': -p.end_span, 'c': p.creator}}) AS parent
               FROM al g SEMI JOIN ovl o ON o.creator = g.creator
               JOIN al p ON p.addr <= g.addr AND g.end_span <= p.end_span AND g.creator > p.creator
               WHERE g.death < {HALF} AND p.creator < {HALF} AND (p.death IS NULL OR p.death >= {HALF}) GROUP BY ALL""",
    ),
)
ENTRIES["J6_ghosts_events"] = (
    lambda s, d: address.ghost_pairs(dirty(s, d), half(dirty(s, d))).drop("trace_id"),
    over(
        "events",
        f"""SELECT p.creator AS parent, g.creator AS child FROM al g SEMI JOIN ovl o ON o.creator = g.creator
               JOIN al p ON p.addr <= g.addr AND g.end_span <= p.end_span AND g.creator > p.creator
               WHERE g.death < {HALF} AND p.creator < {HALF} AND (p.death IS NULL OR p.death >= {HALF})""",
    ),
)
ENTRIES["J7_events_touching"] = (
    lambda s, d: lineage.touching(
        dirty(s, d).events, where(dirty(s, d).allocations, malloc.site == "site_4"), landmarks=False
    ).select("seq", "op"),
    over(
        "events",
        """SELECT seq, op FROM ev WHERE (op IN ('M','R') AND site = 'site_4') OR (target_site = 'site_4')""",
    ),
)
ENTRIES["J8_time_to_position"] = (
    lambda s, d: asof.positions_at(
        orders(s, d).events.select("trace_id", (F.col("t") + 12345).alias("t"), "seq"), orders(s, d).events
    ).select("seq", "n"),
    over(
        "orders",
        """SELECT q.seq, s.n FROM (SELECT seq, t + 12345 AS t FROM ev) q
           ASOF JOIN (SELECT t, max(seq) + 1 AS n FROM ev GROUP BY t) s ON s.t <= q.t""",
    ),
)
ENTRIES["J9_tags_of_allocations"] = (
    lambda s, d: annotate.with_tags(orders(s, d).allocations, members(orders(s, d)))
    .select("creator", F.concat_ws(",", "tags").alias("tags")),
    over("orders", "SELECT creator, array_to_string(tags, ',') AS tags FROM alt", MEMBERS_SQL),
)


def pointers(t):
    """Landmarks' pointers, and a position 500 events back when they were taken."""
    return t.events.filter("op = 'E'").select(
        "trace_id", "seq", malloc.of(t).field("ptr").col.cast("bigint").alias("ptr"),
        F.greatest(F.col("seq") - 500, F.lit(0)).alias("since"),
    )


POINTERS_SQL = """
pts AS (SELECT seq, CAST(json_extract('{' || extras || '}', '$.ptr') AS BIGINT) AS ptr, greatest(seq - 500, 0) AS since
        FROM ev WHERE op = 'E'),
own AS (SELECT p.seq, p.ptr, p.since,
  (SELECT max(a.creator) FROM al a WHERE a.addr <= p.ptr AND a.end_span > p.ptr AND a.creator < p.seq AND (a.death IS NULL OR a.death >= p.seq)) AS owner_now,
  (SELECT max(a.creator) FROM al a WHERE a.addr <= p.ptr AND a.end_span > p.ptr AND a.creator < p.since AND (a.death IS NULL OR a.death >= p.since)) AS owner_then
  FROM pts p)"""
ENTRIES["J10_pointer_owners"] = (
    lambda s, d: lineage.pointer_owners(pointers(dirty(s, d)), dirty(s, d).allocations).drop("trace_id"),
    over(
        "events",
        "SELECT *, owner_then IS NOT NULL AND owner_now IS DISTINCT FROM owner_then AS stale FROM own",
        POINTERS_SQL,
    ),
)
