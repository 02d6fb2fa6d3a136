"""R rows: each stream is fed in three parts, restarted from its checkpoint in
between, and must end where the batch computation ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.session import scratch_path
from lifetrace.sources import derive, jsonl
from lifetrace.streaming import decode, feed, lifecycle, runs, totals
from lifetrace.suite.aggregates import longs
from lifetrace.suite.annotations import CHANGES_SQL, checked
from lifetrace.suite.scans import PATTERN, noisy_lines
from lifetrace.suite.sql import over
from lifetrace.suite.tables import dirty

ENTRIES = {}
PARTS = 3


def fed(s, table, by, make, sink, mode="append"):
    """Write the table in parts of its order and run the stream after each."""
    folder, checkpoint = scratch_path(s, "feed"), scratch_path(s, "checkpoint")
    top = table.agg(F.max(by)).first()[0] + 1
    for part in range(PARTS):
        lo, hi = top * part // PARTS, top * (part + 1) // PARTS
        table.filter((F.col(by) >= lo) & (F.col(by) < hi)).write.mode("append").parquet(folder)
        stream = s.readStream.schema(table.schema).parquet(folder)
        runs.run_available(make(stream), checkpoint, sink, mode)


def _decoded(s, d):
    folder, checkpoint, out = (scratch_path(s, n) for n in ("tail", "checkpoint", "decoded"))
    lines = noisy_lines(derive.events_records(s, d), '{"op":"H","v":2,"unit":"us","title":"events"}')
    top = lines.agg(F.max("ord")).first()[0] + 1
    for part in range(PARTS):
        lo, hi = top * part // PARTS, top * (part + 1) // PARTS
        jsonl.write_lines(lines.filter((F.col("ord") >= lo) & (F.col("ord") < hi)), f"{folder}/part={part}")
        runs.run_available(
            decode.stream_lines(s, folder, PATTERN), checkpoint, decode.decode_sink(out)
        )
    return runs.read_batches(s, out).select(
        "op", F.col("id").cast("bigint").alias("id"), F.col("addr").cast("bigint").alias("addr"),
        F.col("size").cast("bigint").alias("size"), F.col("t").cast("bigint").alias("t"), "site", "extras",
    )


ENTRIES["R1_stream_decode"] = (
    _decoded,
    over(
        "events",
        """SELECT op, id, addr, size, t, site, extras FROM rec
           UNION ALL SELECT 'H', NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT 1 FROM rec LIMIT 1)
           UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM rec WHERE ord % 97 = 5
           UNION ALL SELECT 'X', NULL, NULL, NULL, NULL, NULL, '"later":true' FROM rec WHERE ord % 113 = 7""",
    ),
)


def _resolved(s, d):
    t = dirty(s, d)
    known = t.allocations.select("trace_id", F.col("creator").alias("seq"), "registered")
    events = t.events.join(known, ["trace_id", "seq"], "left").select(
        "trace_id", "seq", "op", "t", "id", "kid", "addr", "size", F.coalesce("registered", F.lit(False)).alias("registered")
    )
    out, state = scratch_path(s, "resolved"), scratch_path(s, "resolved-state")
    fed(s, events, "seq", lambda df: df, lifecycle.resolve_sink(out, state))
    return runs.read_batches(s, out).select("seq", "what", "status", "target", "target_size")


ENTRIES["R2_stream_resolution"] = (
    _resolved,
    over(
        "events",
        """SELECT seq, 'kill' AS what, kill_status AS status, target, target_size FROM ev WHERE op IN ('F','R')
           UNION ALL SELECT f.seq, 'create', CASE WHEN f.cand IS NOT NULL AND (x.death IS NULL OR x.death > f.seq) THEN 'reused' ELSE 'new' END, NULL, NULL
           FROM found f LEFT JOIN ended x ON x.creator = f.cand WHERE f.sub = 1""",
    ),
)


def _clamped(s, d):
    out, state = scratch_path(s, "clamped"), scratch_path(s, "clamp-state")
    records = derive.events_records(s, d).select("trace_id", "ord", "t")
    fed(s, records, "ord", lambda df: df, totals.clamp_sink(out, state))
    return runs.read_batches(s, out).select("ord", "t_raw", "t")


ENTRIES["R3_stream_clamp"] = (
    _clamped, over("events", "SELECT ord, t AS t_raw, tc AS t FROM mk"),
)


def _timeline(s, d):
    out = scratch_path(s, "bins")
    fed(
        s, dirty(s, d).events.select("trace_id", "seq", "t", "op", "size", "target", "target_size"), "seq",
        lambda df: totals.timeline_stream(df, 700), lambda df, n: runs.write_batch(df, out, n), "update",
    )
    return longs(totals.latest(runs.read_batches(s, out), ["trace_id", "bin"]), "allocated_bytes", "freed_bytes")


ENTRIES["R4_stream_timeline"] = (
    _timeline,
    over(
        "events",
        """SELECT 'events' AS trace_id, seq // 700 AS bin, count(*) FILTER (op = 'M') AS allocations,
             count(*) FILTER (op = 'F' AND target IS NOT NULL) AS frees, count(*) FILTER (op = 'R') AS reallocations,
             count(*) FILTER (op = 'E') AS custom_events,
             CAST(coalesce(sum(size) FILTER (op IN ('M','R')),0) AS BIGINT) AS allocated_bytes,
             CAST(coalesce(sum(target_size),0) AS BIGINT) AS freed_bytes FROM ev GROUP BY 2""",
    ),
)


def _totals(s, d):
    out = scratch_path(s, "totals")
    fed(
        s, dirty(s, d).events.select("trace_id", "seq", "op", "size", "target", "target_size"), "seq",
        totals.totals_stream, lambda df, n: runs.write_batch(df, out, n), "update",
    )
    return longs(runs.read_batches(s, out), "live_bytes").select("batch", "live_count", "live_bytes", "last_seq")


ENTRIES["R5_stream_live_totals"] = (
    _totals,
    over(
        "events",
        """SELECT b.batch, r.live_count, r.live_bytes, r.seq AS last_seq FROM runs r
           JOIN (SELECT batch, (SELECT max(seq) + 1 FROM ev) * (batch + 1) // 3 - 1 AS last FROM (SELECT unnest(range(3)) AS batch)) b ON r.seq = b.last""",
        """
runs AS (
  SELECT seq, CAST(sum(CASE WHEN op IN ('M','R') THEN 1 ELSE 0 END - CASE WHEN target IS NOT NULL THEN 1 ELSE 0 END)
      OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live_count,
    CAST(sum(CASE WHEN op IN ('M','R') THEN size ELSE 0 END - coalesce(target_size,0))
      OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live_bytes FROM ev)""",
    ),
)


def _feed(s, d):
    state = scratch_path(s, "feed-state")
    fed(s, checked(s, d)[0], "revision", lambda df: df, feed.feed_sink(state))
    return feed.members(feed.state_after(s, state, PARTS)).select("tag", "creator")


ENTRIES["R6_stream_change_feed"] = (
    _feed,
    over("events", "SELECT DISTINCT tag, creator FROM wiped WHERE present AND stands", CHANGES_SQL),
)
