"""C rows: sequencing, clamping, resolution, intervals, warnings, fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.operators import fields, warnings
from lifetrace.suite.sql import over
from lifetrace.suite.tables import dirty, orders

ENTRIES = {}


def _add(name, fn, sql):
    ENTRIES[name] = (fn, sql)


_add(
    "C1_sequence",
    lambda s, d: dirty(s, d).events.select("trace_id", "ord", "seq", "op"),
    over("events", "SELECT trace_id, ord, seq, op FROM ev"),
)
_add(
    "C2_clamped_time",
    lambda s, d: dirty(s, d).events.select("seq", "t", "t_raw", "t_before"),
    over("events", "SELECT seq, t, t_raw, t_before FROM ev"),
)
_RES = "SELECT seq, op, kid, target, target_addr, target_size, target_usable, target_site, kill_status FROM ev WHERE op IN ('F','R')"
for _n, _t in (("dirty", dirty), ("orders", orders)):
    _add(
        f"C3_resolve_{_n}",
        lambda s, d, t=_t: t(s, d).events.filter("op in ('F','R')").select(
            "seq", "op", "kid", "target", "target_addr", "target_size", "target_usable",
            "target_site", "kill_status",
        ),
        over("events" if _n == "dirty" else "orders", _RES),
    )
_add(
    "C4_death_link",
    lambda s, d: dirty(s, d).allocations.filter("freed").select("creator", "death", "death_t", "death_op"),
    over("events", "SELECT creator, death, death_t, death_op FROM al WHERE death IS NOT NULL"),
)
_ALLOC = (
    "trace_id creator op id addr end_req end_span size usable span birth_t death death_t death_op "
    "lifetime freed site thr stack realloc_from realloc_to extras death_extras"
).split()
for _n, _t in (("dirty", dirty), ("orders", orders)):
    _add(
        f"C5_allocations_{_n}",
        lambda s, d, t=_t: t(s, d).allocations.select(*_ALLOC),
        over("events" if _n == "dirty" else "orders", f"SELECT {', '.join(_ALLOC)} FROM al"),
    )
_add(
    "C6_duplicate_ids",
    lambda s, d: dirty(s, d).events.filter("dup_id").select("seq", "id"),
    over(
        "events",
        """SELECT f.seq, f.key AS id FROM found f LEFT JOIN ended x ON x.creator = f.cand
           WHERE f.sub = 1 AND f.cand IS NOT NULL AND (x.death IS NULL OR x.death > f.seq)""",
    ),
)
for _n, _t in (("dirty", dirty), ("orders", orders)):
    _add(
        f"C7_overlap_at_birth_{_n}",
        lambda s, d, t=_t: t(s, d).overlaps.select("creator", "addr", "end_span"),
        over("events" if _n == "dirty" else "orders", "SELECT creator, addr, end_span FROM ovl"),
    )
_add(
    "C8_size_and_slack",
    lambda s, d: dirty(s, d).events.filter("op in ('M','R')").select(
        "seq", "size", "usable", "bad_size", (F.coalesce("usable", "size") - F.col("size")).alias("slack")
    ),
    over(
        "events",
        "SELECT seq, size, usable, bad_size, coalesce(usable, size) - size AS slack FROM ev WHERE op IN ('M','R')",
    ),
)

# Names of the warning kinds, in code order, and the order of emission inside
# one record.
_WARN = """
obsw AS (
  SELECT m.seq, m.ord, coalesce(m.kid,0) AS detail,
    CASE WHEN f.cand IS NOT NULL THEN 'double' ELSE 'unknown' END AS st
  FROM mk m LEFT JOIN found f ON f.obs AND f.ord = m.ord WHERE m.op = 'R' AND m.addr IS NULL),
dups AS (
  SELECT f.seq, f.ord, f.key FROM found f LEFT JOIN ended x ON x.creator = f.cand
  WHERE f.sub = 1 AND f.cand IS NOT NULL AND (x.death IS NULL OR x.death > f.seq)),
warn AS (
  SELECT CAST(seq AS BIGINT) AS seq, 'decreasing_time' AS kind, t AS detail, ord, 1 AS emit_rank FROM mk WHERE op IS NOT NULL AND t < t_before
  UNION ALL (SELECT CAST(seq AS BIGINT), 'sequence_mismatch', dseq, ord, 2 FROM mk WHERE op IS NOT NULL AND dseq <> seq ORDER BY ord LIMIT 1)
  UNION ALL SELECT seq, CASE kill_status WHEN 'double' THEN 'double_free' ELSE 'unknown_id' END, coalesce(kid,0), ord, 3 FROM ev WHERE kill_status IN ('double','unknown')
  UNION ALL SELECT CAST(seq AS BIGINT), CASE st WHEN 'double' THEN 'double_free' ELSE 'unknown_id' END, detail, ord, 3
            FROM obsw o WHERE NOT EXISTS (SELECT 1 FROM found f JOIN ended x ON x.creator = f.cand
                 WHERE f.obs AND f.ord = o.ord AND x.death >= o.seq) AND NOT EXISTS (SELECT 1 FROM found f
                 WHERE f.obs AND f.ord = o.ord AND f.cand IS NOT NULL AND f.cand NOT IN (SELECT creator FROM ended))
  UNION ALL SELECT CAST(greatest(seq-1,0) AS BIGINT), 'malformed_line', coalesce(id,0), ord, 4 FROM mk WHERE op IN ('M','R') AND addr IS NULL
  UNION ALL SELECT seq, 'invalid_size', coalesce(rid,0), ord, 5 FROM ev WHERE bad_size
  UNION ALL SELECT seq, 'duplicate_id', key, ord, 6 FROM dups
  UNION ALL SELECT e.seq, 'overlap', e.addr, e.ord, 7 FROM ev e JOIN ovl o ON o.creator = e.seq)"""
_add(
    "C9_warnings",
    lambda s, d: warnings.warnings(dirty(s, d)).select(
        "seq", "kind", F.col("detail").cast("bigint").alias("detail"), "ord", "emit_rank"
    ),
    over("events", "SELECT seq, kind, detail, ord, emit_rank FROM warn", _WARN),
)
for _kind in (
    "decreasing_time sequence_mismatch unknown_id double_free duplicate_id overlap invalid_size "
    "malformed_line"
).split():
    _add(
        f"C9_{_kind}",
        lambda s, d, k=_kind: warnings.of_kind(dirty(s, d), k).select("seq", F.col("detail").cast("bigint").alias("detail")),
        over("events", f"SELECT seq, detail FROM warn WHERE kind = '{_kind}'", _WARN),
    )
_add(
    "C10_old_geometry",
    lambda s, d: dirty(s, d).events.filter("op = 'R'").select("seq", "old_addr", "old_size"),
    over(
        "events",
        """SELECT seq, CASE WHEN a <> 0 OR b <> 0 THEN a END AS old_addr, CASE WHEN a <> 0 OR b <> 0 THEN b END AS old_size
           FROM (SELECT seq, CASE WHEN target IS NULL THEN coalesce(rec_old_addr,0) ELSE target_addr END AS a,
                 CASE WHEN target IS NULL THEN coalesce(rec_old_size,0) ELSE target_size END AS b FROM ev WHERE op='R')""",
    ),
)
_FIELDS = """
kv AS (
  SELECT seq, key AS name, json_extract('{' || extras || '}', '$.' || key) AS raw
  FROM (SELECT seq, extras, unnest(json_keys('{' || extras || '}')) AS key FROM ev WHERE extras IS NOT NULL))"""
_add(
    "C11_field_values",
    lambda s, d: fields.field_values(dirty(s, d).events).select("seq", "name", "raw"),
    over("events", "SELECT seq, name, CAST(raw AS VARCHAR) AS raw FROM kv", _FIELDS),
)
WARN_SQL = _WARN
FIELDS_SQL = _FIELDS
