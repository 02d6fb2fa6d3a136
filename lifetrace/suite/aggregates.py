"""A rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.functions.predicates import alloc, malloc, where
from lifetrace.operators import aggregate, annotate, live, warnings
from lifetrace.suite.construction import WARN_SQL
from lifetrace.suite.sql import over
from lifetrace.suite.tables import MEMBERS_SQL, dirty, members, orders

ENTRIES = {}


def longs(df, *names):
    """Exact sums as BIGINT: the checks run where they fit."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


_OVERVIEW = [
    "trace_id", "title", "unit", "events", "allocations", "frees", "reallocations", "custom_events", "t_min", "t_max",
    "addr_min", "addr_max", "live_count", "live_bytes", "total_bytes", "max_span",
]
_UNITS = {"orders": "s", "events": "us"}
for _n, _t in (("orders", orders), ("events", dirty)):
    ENTRIES[f"A1_overview_{_n}"] = (
        lambda s, d, t=_t: longs(aggregate.overview(t(s, d)), "live_bytes", "total_bytes").select(*_OVERVIEW),
        over(
            _n,
            f"""SELECT '{_n}' AS trace_id, '{_n}' AS title, '{_UNITS[_n]}' AS unit, count(*) AS events,
              count(*) FILTER (op IN ('M','R')) AS allocations, count(*) FILTER (op = 'F') AS frees,
              count(*) FILTER (op = 'R') AS reallocations, count(*) FILTER (op = 'E') AS custom_events,
              (SELECT coalesce(t, 0) FROM mk ORDER BY ord LIMIT 1) AS t_min, (SELECT max(tc) FROM mk) AS t_max,
              (SELECT min(addr) FROM al) AS addr_min, (SELECT max(end_span) FROM al) AS addr_max,
              (SELECT count(*) FROM al WHERE NOT freed) AS live_count,
              (SELECT CAST(coalesce(sum(size),0) AS BIGINT) FROM al WHERE NOT freed) AS live_bytes,
              (SELECT CAST(sum(size) AS BIGINT) FROM al) AS total_bytes, (SELECT max(span) FROM al) AS max_span
              FROM ev""",
        ),
    )
RUN_SQL = """
runs AS (
  SELECT seq, t, CAST(sum(CASE WHEN op IN ('M','R') THEN 1 ELSE 0 END - CASE WHEN target IS NOT NULL THEN 1 ELSE 0 END)
      OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live_count,
    CAST(sum(CASE WHEN op IN ('M','R') THEN size ELSE 0 END - coalesce(target_size,0))
      OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live_bytes FROM ev)"""
for _n, _t in (("orders", orders), ("events", dirty)):
    ENTRIES[f"A2_peak_{_n}"] = (
        lambda s, d, t=_t: longs(live.peak(t(s, d).events), "peak_bytes"),
        over(
            _n,
            f"""SELECT '{_n}' AS trace_id, live_bytes AS peak_bytes, seq + 1 AS events_applied, t AS peak_t
                FROM runs ORDER BY live_bytes DESC, seq LIMIT 1""",
            RUN_SQL,
        ),
    )
_SITES = """
sites AS (
  SELECT site AS key, count(*) FILTER (made) AS allocations, CAST(coalesce(sum(CASE WHEN made THEN size END),0) AS BIGINT) AS requested,
         min(ord) AS first_ord
  FROM (SELECT site, op IN ('M','R') AS made, size, ord FROM ev WHERE op <> 'E'
        UNION ALL SELECT site, FALSE, NULL, ord FROM mk WHERE op IN ('M','R') AND addr IS NULL)
  WHERE site IS NOT NULL GROUP BY site)"""
ENTRIES["A3_top_sites"] = (
    lambda s, d: longs(aggregate.top_sites(dirty(s, d), 9), "requested").select(
        "key", "allocations", "requested", F.col("place").cast("bigint").alias("place"), "omitted"
    ),
    over(
        "events",
        """SELECT key, allocations, requested, row_number() OVER (ORDER BY requested DESC, allocations DESC, key) AS place,
           (SELECT count(*) FROM sites) - 9 AS omitted FROM sites ORDER BY requested DESC, allocations DESC, key LIMIT 9""",
        _SITES,
    ),
)
MEASURES_SQL = """count(*) AS allocations, CAST(coalesce(sum(size),0) AS BIGINT) AS requested,
  CAST(coalesce(sum(usable),0) AS BIGINT) AS usable, count(usable) AS usable_known,
  count(*) FILTER (freed) AS freed, count(*) FILTER (NOT freed) AS live_at_end"""


def summary(df):
    return longs(df, "requested", "usable").drop("trace_id")


def bucket_sql(x):
    low = f"CAST(pow(2, floor(log2({x}))) AS BIGINT)"
    digits = f"(length(bin({x})) - 1)"
    return (
        f"CASE WHEN {x} = 0 THEN '0' ELSE CAST(1::BIGINT << {digits} AS VARCHAR) || '..' || "
        f"CAST(1::BIGINT << ({digits} + 1) AS VARCHAR) END"
    )


_KEYS = {
    "A4_by_site": ("site", "coalesce(site, '(none)')"),
    "A5_by_thread": ("thread", "coalesce(CAST(thr AS VARCHAR), '(none)')"),
    "A6_by_freed": ("freed", "CASE WHEN freed THEN 'freed' ELSE 'live-at-end' END"),
    "A7_by_size_bucket": ("size-bucket", bucket_sql("size")),
    "A8_by_lifetime_bucket": (
        "lifetime-bucket", f"CASE WHEN lifetime IS NULL THEN 'live-at-end' ELSE {bucket_sql('lifetime')} END",
    ),
}
for _key, (_by, _text) in _KEYS.items():
    for _n, _t in (("orders", orders), ("events", dirty)):
        ENTRIES[_key if _n == "orders" else f"{_key}_events"] = (
            lambda s, d, t=_t, by=_by: summary(aggregate.summarize(t(s, d).allocations, by)),
            over(_n, f"SELECT {_text} AS key, {MEASURES_SQL} FROM al GROUP BY ALL"),
        )
ENTRIES["A4_unfreed_by_site"] = (
    lambda s, d: summary(aggregate.summarize(where(orders(s, d).allocations, ~alloc.freed), "site")),
    over("orders", f"SELECT site AS key, {MEASURES_SQL} FROM al WHERE NOT freed GROUP BY ALL"),
)
ENTRIES["A9_by_tag"] = (
    lambda s, d: summary(aggregate.summarize_by_tag(dirty(s, d).allocations, members(dirty(s, d)))),
    over(
        "events",
        f"""SELECT coalesce(tag, '(untagged)') AS key, {MEASURES_SQL}
            FROM al LEFT JOIN mem ON mem.creator = al.creator GROUP BY ALL""",
        MEMBERS_SQL,
    ),
)
ENTRIES["A10_by_custom_field"] = (
    lambda s, d: summary(
        aggregate.summarize(dirty(s, d).allocations, malloc.of(dirty(s, d)).field("lane").col)
    ),
    over(
        "events",
        f"""SELECT json_extract_string('{{' || extras || '}}', '$.lane') AS key, {MEASURES_SQL} FROM al GROUP BY ALL""",
    ),
)
ENTRIES["A11_matched_totals"] = (
    lambda s, d: longs(
        aggregate.matched_totals(where(dirty(s, d).allocations, alloc.size >= 200)), "requested", "usable"
    ),
    over(
        "events",
        """SELECT 'events' AS trace_id, count(*) AS allocations, CAST(sum(size) AS BIGINT) AS requested,
           CAST(sum(usable) AS BIGINT) AS usable, count(usable) AS usable_known FROM al WHERE size >= 200""",
    ),
)
ENTRIES["A12_warning_counts"] = (
    lambda s, d: warnings.counts_by_kind(dirty(s, d)),
    over("events", "SELECT 'events' AS trace_id, kind, count(*) AS warnings FROM warn GROUP BY kind", WARN_SQL),
)
ENTRIES["A13_site_catalog"] = (
    lambda s, d: longs(aggregate.site_catalog(dirty(s, d)), "requested").drop("trace_id"),
    over("events", "SELECT * FROM sites", _SITES),
)
ENTRIES["A13_thread_catalog"] = (
    lambda s, d: aggregate.thread_catalog(dirty(s, d)).drop("trace_id"),
    over(
        "events",
        """SELECT thr AS key, count(*) FILTER (made) AS allocations, min(ord) AS first_ord
           FROM (SELECT thr, op IN ('M','R') AS made, ord FROM ev
                 UNION ALL SELECT thr, FALSE, ord FROM mk WHERE op IN ('M','R') AND addr IS NULL)
           WHERE thr IS NOT NULL GROUP BY thr""",
    ),
)
ENTRIES["A14_tag_counts"] = (
    lambda s, d: annotate.tag_counts(orders(s, d).allocations, members(orders(s, d))).drop("trace_id"),
    over(
        "orders",
        """SELECT tag, count(*) AS allocations FROM mem GROUP BY tag
           UNION ALL SELECT '(untagged)', count(*) FROM alt WHERE len(tags) = 0""",
        MEMBERS_SQL,
    ),
)
ENTRIES["A15_slack"] = (
    lambda s, d: longs(aggregate.slack(orders(s, d).allocations), "requested_known", "usable_known", "slack")
    .withColumn("amplification", F.round("amplification", 6))
    .drop("trace_id"),
    over(
        "orders",
        """SELECT coalesce(site,'(none)') AS key, count(*) AS allocations, count(usable) AS known,
           CAST(sum(size) FILTER (usable IS NOT NULL) AS BIGINT) AS requested_known, CAST(sum(usable) AS BIGINT) AS usable_known,
           CAST(sum(usable) - sum(size) FILTER (usable IS NOT NULL) AS BIGINT) AS slack,
           round(CAST(sum(usable) AS DOUBLE) / CAST(sum(size) FILTER (usable IS NOT NULL) AS DOUBLE), 6) AS amplification
           FROM al GROUP BY ALL""",
    ),
)
ENTRIES["A17_retention"] = (
    lambda s, d: longs(
        aggregate.retention(dirty(s, d).allocations, malloc.of(dirty(s, d)).field("k").col),
        "retained_bytes", "total_bytes",
    ).drop("trace_id"),
    over(
        "events",
        """SELECT *, CAST(sum(retained_bytes) OVER (ORDER BY cycle) AS BIGINT) AS total_bytes FROM (
             SELECT CAST(json_extract('{' || extras || '}', '$.k') AS BIGINT) AS cycle, count(*) AS allocations,
               count(*) FILTER (NOT freed) AS retained,
               CAST(coalesce(sum(size) FILTER (NOT freed),0) AS BIGINT) AS retained_bytes FROM al GROUP BY 1)""",
    ),
)
ENTRIES["A18_leaders"] = (
    lambda s, d: longs(
        aggregate.leaders(aggregate.summarize(dirty(s, d).allocations, "site"), 4),
        "requested", "bytes_rank", "count_rank",
    ).drop("trace_id"),
    over(
        "events",
        """SELECT key, CASE WHEN br <= 4 THEN requested END AS requested, CASE WHEN br <= 4 THEN br END AS bytes_rank,
             CASE WHEN cr <= 4 THEN allocations END AS allocations, CASE WHEN cr <= 4 THEN cr END AS count_rank
           FROM (SELECT *, rank() OVER (ORDER BY requested DESC) AS br, rank() OVER (ORDER BY allocations DESC) AS cr
                 FROM (SELECT coalesce(site,'(none)') AS key, count(*) AS allocations, CAST(sum(size) AS BIGINT) AS requested FROM al GROUP BY 1))
           WHERE br <= 4 OR cr <= 4""",
    ),
)
