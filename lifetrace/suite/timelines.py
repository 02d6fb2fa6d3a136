"""T and M rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.functions.predicates import alloc, where
from lifetrace.operators import address, annotate, timeline
from lifetrace.operators.live import live_at
from lifetrace.suite.aggregates import longs
from lifetrace.suite.sql import HALF, N, T0, T1, over
from lifetrace.suite.tables import MEMBERS_SQL, dirty, half, members, orders, size_of, times

ENTRIES = {}
_T = {"orders": orders, "events": dirty}


def _bins_sql(source, at, lo, hi, bins):
    width = f"({hi} - {lo})"
    return f"""
    SELECT b.bin, {lo} + ({width} * b.bin) // {bins} AS "from", {lo} + ({width} * (b.bin + 1)) // {bins} AS "to",
      count(*) FILTER (op = 'M' AND a) AS allocations, count(*) FILTER (op = 'F' AND f) AS frees,
      count(*) FILTER (op = 'R' AND (a OR f)) AS reallocations, count(*) FILTER (op = 'E') AS custom_events,
      CAST(coalesce(sum(size) FILTER (a),0) AS BIGINT) AS allocated_bytes,
      CAST(coalesce(sum(target_size) FILTER (f),0) AS BIGINT) AS freed_bytes,
      CAST(coalesce(sum(size) FILTER (a),0) - coalesce(sum(target_size) FILTER (f),0) AS BIGINT) AS net_live_bytes
    FROM (SELECT unnest(range({bins})) AS bin) b
    LEFT JOIN (SELECT *, least((CAST({at} - {lo} AS HUGEINT) * {bins}) // {width}, {bins - 1}) AS bin FROM {source}
               WHERE {at} >= {lo} AND {at} < {hi}) x ON x.bin = b.bin GROUP BY b.bin"""


_ALL = "(SELECT seq, t, op, size, target_size, op IN ('M','R') AS a, target IS NOT NULL AS f FROM ev)"
_BIG = "(SELECT seq, t, op, size, target_size, op IN ('M','R') AND size >= 250 AS a, target IS NOT NULL AND target_size >= 250 AS f FROM ev)"
_SUMS = ("allocated_bytes", "freed_bytes", "net_live_bytes")


def _line(name, trace, bins, domain, matched, source):
    at = "t" if domain == "time" else "seq"
    bounds = (T0, T1) if domain == "time" else ("0", N)

    def run(s, d):
        t = _T[trace](s, d)
        lo, hi = times(t) if domain == "time" else (0, size_of(t))
        m = where(t.allocations, alloc.size >= 250) if matched else None
        return longs(timeline.timeline(t, lo, hi, bins, domain, m), *_SUMS).drop("trace_id")

    ENTRIES[name] = (run, over(trace, _bins_sql(source, at, *bounds, bins)))


_line("T1_timeline_sequence", "orders", 48, "sequence", False, _ALL)
_line("T1_timeline_sequence_events", "events", 37, "sequence", False, _ALL)
_line("T2_timeline_time", "orders", 64, "time", False, _ALL)
_line("T3_filtered_timeline", "events", 25, "sequence", True, _BIG)
ENTRIES["T4_density_sequence"] = (
    lambda s, d: timeline.density(dirty(s, d).events, 0.0, size_of(dirty(s, d)), 700, "sequence").drop("trace_id"),
    over(
        "events",
        f"""SELECT c AS "column", count(*) FILTER (op IN ('M','R')) AS births, count(*) FILTER (op IN ('F','R')) AS frees
           FROM (SELECT c, round(CAST({N} AS DOUBLE) * c / 700) AS a, round(CAST({N} AS DOUBLE) * (c+1) / 700) AS b FROM (SELECT unnest(range(700)) AS c))
           JOIN ev ON seq >= a AND seq < b WHERE op <> 'E' GROUP BY c""",
    ),
)
ENTRIES["T4_density_time"] = (
    lambda s, d: timeline.density(orders(s, d).events, *times(orders(s, d)), 333, "time").drop("trace_id"),
    over(
        "orders",
        f"""SELECT c AS "column", count(*) FILTER (op IN ('M','R')) AS births, count(*) FILTER (op IN ('F','R')) AS frees
           FROM (SELECT c, ceil(CAST({T0} AS DOUBLE) + CAST({T1} - {T0} AS DOUBLE) * c / 333) AS a,
                 ceil(CAST({T0} AS DOUBLE) + CAST({T1} - {T0} AS DOUBLE) * (c+1) / 333) AS b FROM (SELECT unnest(range(333)) AS c))
           JOIN ev ON t >= a AND t < b WHERE op <> 'E' GROUP BY c""",
    ),
)
ENTRIES["T7_tag_lanes"] = (
    lambda s, d: timeline.tag_lanes(
        annotate.with_tags(dirty(s, d).allocations, members(dirty(s, d))), 0.0, size_of(dirty(s, d)), 500
    ).drop("trace_id"),
    over(
        "events",
        f"""SELECT lane, c AS "column", min(seq) AS seq, arg_min(tag, seq) AS tag
           FROM (SELECT c, round(CAST({N} AS DOUBLE) * c / 500) AS a, round(CAST({N} AS DOUBLE) * (c+1) / 500) AS b FROM (SELECT unnest(range(500)) AS c))
           JOIN (SELECT 'birth' AS lane, creator AS seq, tags[1] AS tag FROM alt WHERE len(tags) > 0
                 UNION ALL SELECT 'death', death, tags[1] FROM alt WHERE len(tags) > 0 AND death IS NOT NULL) ON seq >= a AND seq < b
           GROUP BY lane, c""",
        MEMBERS_SQL,
    ),
)
ENTRIES["T8_live_bytes_by_bin"] = (
    lambda s, d: longs(
        timeline.cumulated(timeline.timeline(orders(s, d), 0, size_of(orders(s, d)), 48)), "live_bytes"
    ).select("bin", "live_bytes"),
    over(
        "orders",
        f"SELECT bin, CAST(sum(net_live_bytes) OVER (ORDER BY bin) AS BIGINT) AS live_bytes FROM ({_bins_sql(_ALL, 'seq', '0', N, 48)})",
    ),
)

# Rows of 64 KiB (orders) or 256 bytes (events).
_ROWS = {"orders": 65536, "events": 256}


def _rows_sql(n, rb):
    live = f"WHERE creator < {n} AND (death IS NULL OR death >= {n})" if n else ""
    return f"""
base AS (SELECT min(addr) - min(addr) % {rb} AS base FROM al),
pl AS (SELECT al.*, (addr - base) // {rb} AS r0, (end_span - 1 - base) // {rb} AS r1, base FROM al, base {live}),
occ AS (SELECT row, count(*) AS allocations FROM (SELECT unnest(range(r0, r1 + 1)) AS row FROM pl) GROUP BY row)"""


ENTRIES["M1_rows"] = (
    lambda s, d: address.placed(orders(s, d), 65536).select("creator", "row_first", "row_last"),
    over("orders", "SELECT creator, r0 AS row_first, r1 AS row_last FROM pl", _rows_sql(None, 65536)),
)
for _n, _t in _T.items():
    ENTRIES[f"M2_occupancy_{_n}"] = (
        lambda s, d, t=_t, rb=_ROWS[_n]: address.occupancy(t(s, d), rb, half(t(s, d))).drop("trace_id"),
        over(_n, "SELECT * FROM occ", _rows_sql(HALF, _ROWS[_n])),
    )
ENTRIES["M3_rows_ever_touched"] = (
    lambda s, d: address.occupancy(orders(s, d), 65536).select("row"),
    over("orders", "SELECT row FROM occ", _rows_sql(None, 65536)),
)


def _layout_sql(cmin):
    return f"""
lag1 AS (SELECT row, lag(row) OVER (ORDER BY row) AS above FROM occ),
lag2 AS (SELECT *, CAST(sum(CASE WHEN row - above - 1 >= {cmin} THEN 1 ELSE 0 END) OVER (ORDER BY row) AS BIGINT) AS gaps_before FROM lag1),
lay AS (SELECT row, gaps_before, FALSE AS filler FROM lag2
        UNION ALL SELECT unnest(range(above + 1, row)), gaps_before, TRUE FROM lag2 WHERE row - above - 1 BETWEEN 1 AND {cmin} - 1)"""


ENTRIES["M4_layout"] = (
    lambda s, d: address.layout(address.occupancy(orders(s, d), 65536, half(orders(s, d))), 20).select("row", "gaps_before", "filler"),
    over("orders", "SELECT * FROM lay", _rows_sql(HALF, 65536) + "," + _layout_sql(20)),
)
ENTRIES["M5_threshold_in_bytes"] = (
    lambda s, d: address.layout(
        address.occupancy(orders(s, d), 65536, half(orders(s, d))), address.collapse_rows(2_000_000, 65536)
    ).select("row", "gaps_before", "filler"),
    over("orders", "SELECT * FROM lay", _rows_sql(HALF, 65536) + "," + _layout_sql(31)),
)
# Rows of 8 bytes: spans over 65,536 rows leave their middle unmarked.
ENTRIES["M6_gap_inside_allocation"] = (
    lambda s, d: address.covered_gaps(orders(s, d), 8, half(orders(s, d)), 50000).select("above", "below"),
    over(
        "orders",
        "SELECT DISTINCT above, below FROM g JOIN pl ON pl.addr <= base0 + (above+1)*8 AND pl.end_span >= base0 + below*8",
        f"""
base AS (SELECT min(addr) - min(addr) % 8 AS base0 FROM al),
pl AS (SELECT al.*, (addr - base0) // 8 AS r0, (end_span - 1 - base0) // 8 AS r1, base0 FROM al, base
       WHERE creator < {HALF} AND (death IS NULL OR death >= {HALF})),
occ AS (SELECT r0, CASE WHEN r1 - r0 > 65536 THEN r0 ELSE r1 END AS r1 FROM pl UNION ALL SELECT r1, r1 FROM pl),
g AS (SELECT * FROM (SELECT r0 AS below, max(r1) OVER (ORDER BY r0, r1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM occ)
      WHERE below - above - 1 >= 50000)""",
    ),
)
ENTRIES["M7_row_slices"] = (
    lambda s, d: address.slices(
        orders(s, d), 65536, orders(s, d).allocations.filter(live_at(half(orders(s, d))))
    ).drop("trace_id"),
    over(
        "orders",
        """SELECT creator, row, greatest(addr, base + row*65536) - (base + row*65536) AS lo,
           least(end_span, base + row*65536 + 65536) - (base + row*65536) AS hi
           FROM (SELECT *, unnest(range(r0, r1 + 1)) AS row FROM pl)""",
        _rows_sql(HALF, 65536),
    ),
)
for _n, _t in _T.items():
    ENTRIES[f"M8_shared_bytes_{_n}"] = (
        lambda s, d, t=_t: address.shared_bytes(t(s, d).allocations, half(t(s, d))).drop("trace_id"),
        over(
            _n,
            f"""SELECT start, stop, depth FROM (
                 SELECT pos AS start, lead(pos) OVER (ORDER BY pos) AS stop, CAST(sum(step) OVER (ORDER BY pos) AS BIGINT) AS depth
                 FROM (SELECT pos, sum(step) AS step FROM (
                   SELECT addr AS pos, 1 AS step FROM al WHERE creator < {HALF} AND (death IS NULL OR death >= {HALF})
                   UNION ALL SELECT end_span, -1 FROM al WHERE creator < {HALF} AND (death IS NULL OR death >= {HALF})) GROUP BY pos))
               WHERE depth >= 2""",
        ),
    )
