"""G rows, over a change log derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.functions.predicates import alloc, malloc
from lifetrace.operators import annotate, changes
from lifetrace.sources import derive
from lifetrace.suite.sql import over
from lifetrace.suite.tables import dirty

ENTRIES = {}
_CLEAN: dict = {}


def checked(s, d):
    """(valid changes, rejects), once per session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _CLEAN:
        t = dirty(s, d)
        _CLEAN[key] = changes.validated(derive.change_log(s, d), t.allocations, t.events)
    return _CLEAN[key]


CHANGES_SQL = """
clog AS (
  SELECT e + 1 AS revision, *, CASE WHEN e % 12 = 10 AND k % 4 <> 0 THEN 'putTag' WHEN e % 12 = 9 AND k = 94 THEN 'putNote' ELSE
    ['putTag','setAllocationName','setAllocationColor','setAllocationTag','setAllocationTag','replaceAllocationTags',
     'replaceTagMembers','putBookmark','putAddressMark','putSavedFilter','deleteTag','deleteBookmark'][e % 12 + 1] END AS type,
    (e*7919 + u*7 + k) % (SELECT count(*) FROM events) AS cr, 't' || CAST(k % 25 AS VARCHAR) AS tg, 't' || CAST((k+1) % 25 AS VARCHAR) AS tg2
  FROM (SELECT event_id AS e, user_id AS u, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)),
shape AS (
  SELECT *, (cr + 3) % (SELECT count(*) FROM events) AS cr3, CASE
    WHEN type = 'putNote' THEN 'unknown type'
    WHEN (k = 91 AND type = 'putSavedFilter') OR (k = 92 AND type = 'setAllocationTag') OR (k = 93 AND type = 'putBookmark') THEN 'missing field'
    WHEN k = 99 AND type IN ('putTag','deleteTag','setAllocationTag','replaceTagMembers') THEN 'invalid persistent id'
    WHEN k = 98 AND type LIKE 'put%' THEN 'invalid name'
    WHEN k = 97 AND type = 'setAllocationColor' THEN 'invalid color'
    WHEN k = 96 AND type = 'putBookmark' THEN 'invalid time'
    WHEN k = 95 AND type = 'putSavedFilter' THEN 'filter is too large'
    WHEN k = 51 AND type = 'putAddressMark' THEN 'invalid address' END AS r0 FROM clog),
refs AS (
  SELECT revision, cr AS creator FROM shape WHERE r0 IS NULL AND type IN ('setAllocationName','setAllocationColor','setAllocationTag','replaceAllocationTags','replaceTagMembers')
  UNION ALL SELECT revision, cr3 FROM shape WHERE r0 IS NULL AND type = 'replaceTagMembers'),
nocre AS (SELECT DISTINCT revision FROM refs WHERE creator NOT IN (SELECT creator FROM al)),
uses AS (
  SELECT revision, tg FROM shape WHERE r0 IS NULL AND type IN ('setAllocationTag','replaceTagMembers','replaceAllocationTags')
  UNION ALL SELECT revision, tg2 FROM shape WHERE r0 IS NULL AND type = 'replaceAllocationTags'),
notag AS (
  SELECT DISTINCT u.revision FROM uses u ASOF LEFT JOIN (SELECT tg, revision, type FROM shape WHERE r0 IS NULL AND type IN ('putTag','deleteTag')) p
    ON p.tg = u.tg AND p.revision <= u.revision WHERE p.type IS DISTINCT FROM 'putTag'),
verdict AS (
  SELECT s.*, coalesce(r0, CASE WHEN n.revision IS NOT NULL THEN 'allocation not found' WHEN g.revision IS NOT NULL THEN 'unknown tag'
    WHEN type = 'putBookmark' AND e * (1 + CASE WHEN k = 50 THEN 1 ELSE 0 END) > (SELECT count(*) FROM ev) THEN 'invalid bookmark' END) AS reason
  FROM shape s LEFT JOIN nocre n ON n.revision = s.revision LEFT JOIN notag g ON g.revision = s.revision),
good AS (SELECT * FROM verdict WHERE reason IS NULL),
pairs AS (
  SELECT revision, tg AS tag, cr AS creator, k % 3 <> 0 AS present FROM good WHERE type = 'setAllocationTag'
  UNION ALL SELECT revision, tg, cr, TRUE FROM good WHERE type = 'replaceAllocationTags'
  UNION ALL SELECT revision, tg2, cr, TRUE FROM good WHERE type = 'replaceAllocationTags'
  UNION ALL SELECT revision, tg, cr, TRUE FROM good WHERE type = 'replaceTagMembers'
  UNION ALL SELECT revision, tg, cr3, TRUE FROM good WHERE type = 'replaceTagMembers'),
wiped AS (
  SELECT p.tag, p.creator, p.revision, p.present,
    NOT EXISTS (SELECT 1 FROM good g WHERE g.revision > p.revision AND ((g.type IN ('replaceTagMembers','deleteTag') AND g.tg = p.tag)
                OR (g.type = 'replaceAllocationTags' AND g.cr = p.creator))) AS stands
  FROM pairs p WHERE p.revision = (SELECT max(q.revision) FROM pairs q WHERE q.tag = p.tag AND q.creator = p.creator))"""
ENTRIES["G1_fold_members"] = (
    lambda s, d: changes.fold(checked(s, d)[0]).members.select("tag", "creator"),
    over("events", "SELECT DISTINCT tag, creator FROM wiped WHERE present AND stands", CHANGES_SQL),
)
ENTRIES["G1_fold_notes"] = (
    lambda s, d: changes.fold(checked(s, d)[0]).notes.drop("trace_id"),
    over(
        "events",
        """SELECT * FROM (SELECT cr AS creator,
             arg_max(CASE WHEN k % 9 <> 0 THEN 'n' || CAST(k AS VARCHAR) ELSE '' END, revision) FILTER (type = 'setAllocationName') AS n0,
             arg_max(CASE WHEN k % 9 <> 0 THEN '#aabb' || CAST(10 + k % 90 AS VARCHAR) ELSE '' END, revision) FILTER (type = 'setAllocationColor') AS c0,
             nullif(n0, '') AS name, nullif(c0, '') AS color
           FROM good WHERE type IN ('setAllocationName','setAllocationColor') GROUP BY cr) WHERE name IS NOT NULL OR color IS NOT NULL""".replace(
            "SELECT * FROM", "SELECT creator, name, color FROM", 1
        ),
        CHANGES_SQL,
    ),
)


def _objects(s, d):
    f = changes.fold(checked(s, d)[0])
    rows = [
        f.tags.select(F.lit("tag").alias("what"), "id", "name", F.col("color").alias("value")),
        f.bookmarks.select(F.lit("bookmark").alias("what"), "id", "name", F.col("seq").cast("string").alias("value")),
        f.marks.select(F.lit("mark").alias("what"), "id", "name", F.col("addr").alias("value")),
        f.filters.select(F.lit("filter").alias("what"), "id", "name", F.col("source").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


ENTRIES["G1_fold_objects"] = (
    _objects,
    over(
        "events",
        """SELECT what, id, name, value FROM (
             SELECT what, id, arg_max(type, revision) AS ty, arg_max(name, revision) AS name, arg_max(value, revision) AS value FROM (
               SELECT 'tag' AS what, tg AS id, type, revision, 'N' || CAST(k AS VARCHAR) AS name, '#ccddee' AS value FROM good WHERE type IN ('putTag','deleteTag')
               UNION ALL SELECT 'bookmark', 'b' || CAST(k % 30 AS VARCHAR), type, revision, 'N' || CAST(k AS VARCHAR),
                 CAST(e * (1 + CASE WHEN k = 50 THEN 1 ELSE 0 END) AS VARCHAR) FROM good WHERE type IN ('putBookmark','deleteBookmark')
               UNION ALL SELECT 'mark', 'a' || CAST(k % 30 AS VARCHAR), type, revision, 'N' || CAST(k AS VARCHAR), printf('0x%x', u*4096 + k) FROM good WHERE type = 'putAddressMark'
               UNION ALL SELECT 'filter', 'f' || CAST(k % 30 AS VARCHAR), type, revision, 'N' || CAST(k AS VARCHAR), 'alloc.size > ' || CAST(k AS VARCHAR) FROM good WHERE type = 'putSavedFilter')
             GROUP BY what, id) WHERE ty LIKE 'put%'""",
        CHANGES_SQL,
    ),
)
ENTRIES["A16_annotation_counts"] = (
    lambda s, d: changes.counts(changes.fold(checked(s, d)[0])).select("what", "n"),
    over(
        "events",
        """SELECT what || 's' AS what, count(*) AS n FROM (
             SELECT what, id, arg_max(type, revision) AS ty FROM (
               SELECT 'tag' AS what, tg AS id, type, revision FROM good WHERE type IN ('putTag','deleteTag')
               UNION ALL SELECT 'bookmark', 'b' || CAST(k % 30 AS VARCHAR), type, revision FROM good WHERE type IN ('putBookmark','deleteBookmark')
               UNION ALL SELECT 'mark', 'a' || CAST(k % 30 AS VARCHAR), type, revision FROM good WHERE type = 'putAddressMark'
               UNION ALL SELECT 'filter', 'f' || CAST(k % 30 AS VARCHAR), type, revision FROM good WHERE type = 'putSavedFilter')
             GROUP BY what, id) WHERE ty LIKE 'put%' GROUP BY what
           UNION ALL SELECT 'named', count(*) FROM (
             SELECT arg_max(k % 9 <> 0, revision) AS given FROM good WHERE type = 'setAllocationName' GROUP BY cr) WHERE given""",
        CHANGES_SQL,
    ),
)
ENTRIES["G2_rejected_changes"] = (
    lambda s, d: checked(s, d)[1].select("revision", "type", "reason"),
    over("events", "SELECT revision, type, reason FROM verdict WHERE reason IS NOT NULL", CHANGES_SQL),
)
ENTRIES["G4_changes_since"] = (
    lambda s, d: changes.since(
        derive.change_log(s, d), derive.change_log(s, d).count() // 2
    ).select("current", "reset", "revision", "type"),
    """SELECT (SELECT max(event_id) + 1 FROM events) AS current, FALSE AS reset, event_id + 1 AS revision,
       CASE WHEN event_id % 12 = 10 AND CAST(json_extract(props,'$.k') AS BIGINT) % 4 <> 0 THEN 'putTag'
       WHEN event_id % 12 = 9 AND CAST(json_extract(props,'$.k') AS BIGINT) = 94 THEN 'putNote' ELSE
       ['putTag','setAllocationName','setAllocationColor','setAllocationTag','setAllocationTag','replaceAllocationTags',
        'replaceTagMembers','putBookmark','putAddressMark','putSavedFilter','deleteTag','deleteBookmark'][event_id % 12 + 1] END AS type
       FROM events WHERE event_id + 1 > (SELECT count(*) // 2 FROM events)""",
)
SAVED = {
    "large and kept": lambda: (alloc.size >= 300) & ~alloc.freed,
    "early site 3": lambda: (malloc.site == "site_3") & (malloc.seq < 5000),
}
ENTRIES["G5_saved_filter"] = (
    lambda s, d: changes.apply_saved(dirty(s, d).allocations, SAVED, "large and kept").select("creator"),
    over("events", "SELECT creator FROM al WHERE size >= 300 AND NOT freed"),
)
ENTRIES["G6_names_and_colors"] = (
    lambda s, d: annotate.with_notes(
        dirty(s, d).allocations, changes.fold(checked(s, d)[0]).notes
    ).filter("name is not null").select("creator", "name", "site"),
    over(
        "events",
        """SELECT a.creator, x.name, a.site FROM al a JOIN (
             SELECT cr, arg_max(CASE WHEN k % 9 <> 0 THEN 'n' || CAST(k AS VARCHAR) ELSE '' END, revision) AS name
             FROM good WHERE type = 'setAllocationName' GROUP BY cr) x ON x.cr = a.creator WHERE x.name <> ''""",
        CHANGES_SQL,
    ),
)
