"""L rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.functions.predicates import alloc, where
from lifetrace.operators import lineage
from lifetrace.suite.sql import over
from lifetrace.suite.tables import MEMBERS_SQL, NOTES_SQL, dirty, members, notes

ENTRIES = {}
OP_SQL = "CASE {} WHEN 'M' THEN 'malloc' WHEN 'F' THEN 'free' WHEN 'R' THEN 'realloc' WHEN 'E' THEN 'event' END"

ENTRIES["L1_detail"] = (
    lambda s, d: lineage.detail(
        where(dirty(s, d).allocations, alloc.size >= 100), notes(dirty(s, d)), members(dirty(s, d))
    ).select(
        "name", "color", F.concat_ws(",", "tags").alias("tags"), "creator", "operation", "end", "fields", "death_fields",
        "relations.reallocated_from", "relations.reallocated_to",
        F.col("creator_event.time").alias("birth_time"), F.col("creator_event.stack").alias("birth_stack"),
        F.col("death_event.seq").alias("death_seq"), F.col("death_event.operation").alias("death_operation"),
        F.col("death_event.time").alias("death_time"),
    ),
    over(
        "events",
        f"""SELECT creator, {OP_SQL.format('op')} AS operation, end_req AS "end", extras AS fields, death_extras AS death_fields,
            realloc_from AS reallocated_from, realloc_to AS reallocated_to, birth_t AS birth_time, stack AS birth_stack,
            death AS death_seq, {OP_SQL.format('death_op')} AS death_operation, death_t AS death_time,
            note.name, CASE WHEN note.name IS NOT NULL THEN '#aabbcc' END AS color, array_to_string(tags, ',') AS tags
            FROM alt LEFT JOIN note USING (trace_id, creator) WHERE size >= 100""",
        MEMBERS_SQL + "," + NOTES_SQL,
    ),
)
CHAIN_SQL = """
walk AS (
  SELECT creator, creator AS root, CAST(0 AS BIGINT) AS generation FROM al WHERE realloc_from IS NULL AND realloc_to IS NOT NULL
  UNION ALL SELECT a.creator, w.root, w.generation + 1 FROM walk w JOIN al a ON a.realloc_from = w.creator)"""
ENTRIES["L2_chains"] = (
    lambda s, d: lineage.chains(dirty(s, d).allocations).drop("trace_id"),
    over("events", "SELECT * FROM walk", CHAIN_SQL),
)
ENTRIES["L2_chain_summary"] = (
    lambda s, d: lineage.chain_summary(dirty(s, d).allocations).drop("trace_id"),
    over(
        "events",
        """SELECT root, count(*) AS length, arg_max(w.creator, generation) AS tail, arg_min(size, generation) AS first_size,
           arg_max(size, generation) AS last_size, NOT arg_max(freed, generation) AS live
           FROM walk w JOIN al USING (creator) GROUP BY root""",
        CHAIN_SQL,
    ),
)
_ROW = f"""seq, t, {OP_SQL.format('op')} AS operation,
  CASE WHEN op = 'F' THEN target WHEN op <> 'E' THEN seq END AS creator, CASE WHEN op = 'R' THEN target END AS replaces,
  CASE WHEN op <> 'E' THEN id END AS id, CASE WHEN op = 'F' THEN target_size ELSE size END AS size,
  CASE WHEN op = 'F' THEN target_site ELSE site END AS site, title"""
ENTRIES["L4_context"] = (
    lambda s, d: lineage.context(
        dirty(s, d), where(dirty(s, d).allocations, alloc.size >= 100), 4000, 60, 39
    ).drop("trace_id"),
    over(
        "events",
        f"""SELECT {_ROW} FROM ev WHERE seq BETWEEN 3940 AND 4039
            AND (op = 'E' OR (op IN ('M','R') AND size >= 100) OR target_size >= 100)""",
    ),
)
ENTRIES["L5_contexts"] = (
    lambda s, d: lineage.contexts(
        dirty(s, d).events.filter("kill_status = 'double'").select("trace_id", F.col("seq").alias("center")),
        dirty(s, d).events, 5, 3,
    ).drop("trace_id"),
    over(
        "events",
        f"""SELECT center, {_ROW} FROM (SELECT seq AS center FROM ev WHERE kill_status = 'double') c
            JOIN ev ON seq BETWEEN center - 5 AND center + 3""",
    ),
)
ENTRIES["L6_event_to_allocation"] = (
    lambda s, d: lineage.event_rows(dirty(s, d).events).drop("trace_id"),
    over("events", f"SELECT {_ROW} FROM ev"),
)
ENTRIES["L7_landmarks"] = (
    lambda s, d: lineage.landmarks(dirty(s, d).events).drop("trace_id"),
    over("events", "SELECT seq, t, title, thr AS thread, extras AS fields FROM ev WHERE op = 'E'"),
)
ENTRIES["L8_phases"] = (
    lambda s, d: lineage.phases(dirty(s, d).events).select("seq", "op", "phase_seq", "phase"),
    over(
        "events",
        """SELECT e.seq, e.op, m.seq AS phase_seq, m.title AS phase FROM ev e
           ASOF LEFT JOIN (SELECT seq, title FROM ev WHERE op = 'E') m ON m.seq <= e.seq""",
    ),
)
