"""S rows. The JSON Lines inputs are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.operators import pages, warnings
from lifetrace.session import scratch_path
from lifetrace.sources import derive, jsonl
from lifetrace.suite.construction import WARN_SQL
from lifetrace.suite.sql import over
from lifetrace.suite.tables import dirty, orders
from lifetrace.trace import Trace

ENTRIES = {}
_WRITTEN: dict = {}
_LOADED: dict = {}
PATTERN = "trace_id=([^/]+)/"


def noisy_lines(records, header):
    """Each record's line, with a header first and lines to skip or reject."""
    o = F.col("ord")
    lines = jsonl.lines_of(records)
    extra = F.array_compact(
        F.array(
            F.when(o == 0, F.lit(header)),
            F.when(o % 29 == 0, F.lit("")),
            F.when(o % 41 == 0, F.lit("# a note")),
            F.when(o % 97 == 5, F.lit("not json {")),
            F.when(o % 113 == 7, F.lit('{"op":"X","later":true}')),
            F.concat(F.lit("  "), F.col("line"), F.lit(" \r")),
        )
    )
    return lines.select("trace_id", "ord", F.posexplode(extra).alias("_i", "line")).select(
        "trace_id", (o * 8 + F.col("_i")).alias("ord"), "line"
    )


def text_folder(s, d):
    key = (s.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        path = scratch_path(s, "jsonl")
        records = derive.events_records(s, d)
        jsonl.write_lines(noisy_lines(records, '{"op":"H","v":2,"unit":"us","title":"events"}'), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def loaded(s, d):
    key = (s.sparkContext.applicationId, d)
    if key not in _LOADED:
        _LOADED[key] = jsonl.load(s, text_folder(s, d), PATTERN)
    return _LOADED[key]


_LINES_SQL = """
noise AS (
  SELECT ord * 8 + i AS place, x.op, x.id FROM (
    SELECT ord, unnest(range(1, len(l) + 1)) AS i, l FROM (
      SELECT ord, list_filter([CASE WHEN ord = 0 THEN {'op': 'H', 'id': NULL::BIGINT} END,
        CASE WHEN ord % 97 = 5 THEN {'op': NULL, 'id': NULL::BIGINT} END,
        CASE WHEN ord % 113 = 7 THEN {'op': 'X', 'id': NULL::BIGINT} END,
        {'op': op, 'id': id}], lambda v: v IS NOT NULL) AS l FROM rec)), LATERAL (SELECT l[i].op AS op, l[i].id AS id) x),
numbered AS (SELECT row_number() OVER (ORDER BY place) - 1 AS ord, op, id FROM noise)"""
ENTRIES["S1_ordered_scan"] = (
    lambda s, d: jsonl.load_decoded(s, text_folder(s, d), PATTERN).select(
        "ord", F.get_json_object("line", "$.op").alias("op"), F.col("id").cast("bigint").alias("id")
    ),
    over("events", "SELECT ord, op, id FROM numbered", _LINES_SQL),
)
_EVENT = "seq op t id addr size usable thr site stack title extras target kill_status".split()
ENTRIES["S2_decoded_events"] = (
    lambda s, d: loaded(s, d).events.filter("op <> 'F'").select(*_EVENT),
    over("events", f"SELECT {', '.join('coalesce(' + c + ', 0) AS ' + c if c in ('addr', 'size') else c for c in _EVENT)} FROM ev WHERE op <> 'F'"),
)
ENTRIES["S3_headers"] = (
    lambda s, d: loaded(s, d).headers.select(
        "trace_id", "has_header", "version", "unit", "title", F.col("row_bytes").cast("bigint").alias("row_bytes"),
        F.col("arena_base").cast("bigint").alias("arena_base"),
    ),
    """SELECT 'events' AS trace_id, TRUE AS has_header, CAST(2 AS BIGINT) AS version, 'us' AS unit, 'events' AS title,
       CAST(0 AS BIGINT) AS row_bytes, CAST(0 AS BIGINT) AS arena_base FROM (SELECT 1 FROM events LIMIT 1)""",
)


def _directory(s, d):
    path = scratch_path(s, "folder")
    both = jsonl.lines_of(derive.events_records(s, d)).unionByName(
        jsonl.lines_of(derive.orders_records(s, d))
    )
    jsonl.write_lines(both, path)
    t = jsonl.load(s, path, PATTERN)
    return t.events.groupBy("trace_id", "op").agg(
        F.count(F.lit(1)).alias("events"), F.count("target").alias("resolved"), F.max("seq").alias("last_seq")
    )


ENTRIES["S5_directory"] = (
    _directory,
    "SELECT * FROM ("
    + over("events", "SELECT trace_id, op, count(*) AS events, count(target) AS resolved, max(seq) AS last_seq FROM ev GROUP BY ALL")
    + ") UNION ALL SELECT * FROM ("
    + over("orders", "SELECT trace_id, op, count(*) AS events, count(target) AS resolved, max(seq) AS last_seq FROM ev GROUP BY ALL")
    + ")",
)


def _round_trip(s, d):
    path = scratch_path(s, "saved")
    orders(s, d).save(path)
    return Trace.load(s, path).allocations.select("creator", "addr", "size", "death", "site", "extras")


ENTRIES["S6_table_round_trip"] = (
    _round_trip,
    over("orders", "SELECT creator, addr, size, death, site, extras FROM al"),
)
ENTRIES["S7_adapter_orders"] = (
    lambda s, d: derive.orders_records(s, d).select("ord", "op", "id", "kid", "addr", "size", "usable", "t", "thr", "site", "extras"),
    over("orders", "SELECT ord, op, id, kid, addr, size, usable, t, thr, site, extras FROM rec"),
)
ENTRIES["S7_adapter_events"] = (
    lambda s, d: derive.events_records(s, d).drop("trace_id"),
    over("events", "SELECT ord, op, id, kid, addr, size, usable, t, dseq, thr, site, stack, title, old_addr, old_size, extras FROM rec"),
)
ENTRIES["S8_event_page"] = (
    lambda s, d: pages.event_page(dirty(s, d).events, 4000, 2000).drop("trace_id"),
    over(
        "events",
        """SELECT seq, op, t, CASE WHEN op <> 'E' THEN id END AS id,
             CASE WHEN op = 'F' AND target IS NOT NULL THEN target WHEN op <> 'E' THEN seq END AS creator,
             CASE WHEN op = 'E' THEN NULL WHEN op = 'F' AND target IS NOT NULL THEN target_addr ELSE coalesce(addr,0) END AS addr,
             CASE WHEN op = 'E' THEN NULL WHEN op = 'F' AND target IS NOT NULL THEN target_size ELSE coalesce(size,0) END AS size,
             CASE WHEN op = 'R' THEN coalesce(target_addr, rec_old_addr, 0) END AS old_addr,
             CASE WHEN op = 'R' THEN coalesce(target_size, rec_old_size, 0) END AS old_size,
             CASE WHEN op = 'F' AND target IS NOT NULL THEN coalesce(target_site, site) WHEN op <> 'E' THEN site END AS site,
             title, CASE WHEN op = 'E' THEN thr END AS thr, CASE WHEN op = 'E' THEN extras END AS extras
           FROM ev WHERE seq >= 4000 AND seq < 6000""",
    ),
)
ENTRIES["S9_warning_page"] = (
    lambda s, d: warnings.page(dirty(s, d), 100).select(
        "position", "seq", "kind", F.col("detail").cast("bigint").alias("detail"), "observed", "retained", "omitted",
    ),
    over(
        "events",
        """SELECT row_number() OVER (ORDER BY ord, emit_rank) - 1 AS position, seq, kind, detail,
             (SELECT count(*) FROM warn) AS observed, (SELECT count(*) FROM warn) AS retained, CAST(0 AS BIGINT) AS omitted
           FROM warn QUALIFY position >= 100""",
        WARN_SQL,
    ),
)
ENTRIES["C9_unknown_version"] = (
    lambda s, d: warnings.of_kind(loaded(s, d), "unknown_version").select(
        "trace_id", "seq", F.col("detail").cast("bigint").alias("detail")
    ),
    """SELECT 'events' AS trace_id, CAST(0 AS BIGINT) AS seq, CAST(2 AS BIGINT) AS detail
       FROM (SELECT 1 FROM events LIMIT 1)""",
)
ENTRIES["A12_warning_counts_of_lines"] = (
    lambda s, d: warnings.counts_by_kind(loaded(s, d)),
    over(
        "events",
        """SELECT 'events' AS trace_id, kind, count(*) AS warnings FROM (
             SELECT kind FROM warn UNION ALL SELECT 'malformed_line' FROM rec WHERE ord % 97 = 5
             UNION ALL (SELECT 'unknown_version' FROM rec LIMIT 1)) GROUP BY kind""",
        WARN_SQL,
    ),
)
