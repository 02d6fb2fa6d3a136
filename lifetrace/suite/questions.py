"""Q rows: end-to-end questions, each a composition of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.functions.predicates import alloc, malloc, where
from lifetrace.operators import aggregate, annotate, lineage, live, warnings
from lifetrace.suite.aggregates import RUN_SQL, longs
from lifetrace.suite.construction import WARN_SQL
from lifetrace.suite.joins import POINTERS_SQL, pointers
from lifetrace.suite.lineage import CHAIN_SQL
from lifetrace.suite.sql import over
from lifetrace.suite.tables import dirty, members

ENTRIES = {}
_LANE = "json_extract_string('{' || extras || '}', '$.lane')"


def _lane(t):
    return malloc.of(t).field("lane").col


# Which sites keep growing cohorts, a few known singletons aside?
ENTRIES["Q1_retained_cohort"] = (
    lambda s, d: longs(
        aggregate.summarize(
            where(dirty(s, d).allocations, ~alloc.freed),
            F.concat_ws("/", F.coalesce("site", F.lit("(none)")), _lane(dirty(s, d))),
        ).filter("allocations > 3"), "requested",
    ).select("key", "allocations", "requested"),
    over(
        "events",
        f"""SELECT coalesce(site,'(none)') || '/' || {_LANE} AS key, count(*) AS allocations, CAST(sum(size) AS BIGINT) AS requested
            FROM al WHERE NOT freed GROUP BY 1 HAVING count(*) > 3""",
    ),
)


def _spike(s, d):
    t = dirty(s, d)
    top = live.peak(t.events)
    at = F.col("events_applied") - 1
    where_ = lineage.phases(t.events).select("trace_id", "seq", "phase_seq", "phase")
    left = t.allocations.filter(~F.col("freed")).groupBy("trace_id").agg(F.sum("size").alias("live_at_end"))
    return longs(
        top.withColumn("seq", at).join(where_, ["trace_id", "seq"]).join(left, "trace_id"), "peak_bytes"
    ).select("peak_bytes", "seq", "phase_seq", "phase", "live_at_end")


# When was the peak, in which phase, and how much of it is left at the end?
ENTRIES["Q2_peak_and_phase"] = (
    _spike,
    over(
        "events",
        """SELECT r.live_bytes AS peak_bytes, r.seq, m.seq AS phase_seq, m.title AS phase,
             (SELECT CAST(sum(size) AS BIGINT) FROM al WHERE NOT freed) AS live_at_end
           FROM (SELECT * FROM runs ORDER BY live_bytes DESC, seq LIMIT 1) r
           ASOF LEFT JOIN (SELECT seq, title FROM ev WHERE op = 'E') m ON m.seq <= r.seq""",
        RUN_SQL,
    ),
)


def _lineages(s, d):
    a = dirty(s, d).allocations
    chain = lineage.chain_summary(a).filter("live and length > 1")
    roots = a.select("trace_id", F.col("creator").alias("root"), _lane(dirty(s, d)).alias("root_lane"), F.col("id").alias("root_id"))
    return chain.join(roots, ["trace_id", "root"]).drop("trace_id", "live")


# Which live buffers came from which chain of resizes?
ENTRIES["Q3_live_buffer_lineage"] = (
    _lineages,
    over(
        "events",
        f"""SELECT w.root, count(*) AS length, arg_max(w.creator, generation) AS tail, arg_min(x.size, generation) AS first_size,
              arg_max(x.size, generation) AS last_size, any_value(r.lane) AS root_lane, any_value(r.id) AS root_id
            FROM walk w JOIN al x ON x.creator = w.creator JOIN (SELECT creator, id, {_LANE} AS lane FROM al) r ON r.creator = w.root
            GROUP BY w.root HAVING count(*) > 1 AND NOT arg_max(x.freed, generation)""",
        CHAIN_SQL,
    ),
)
# Which worker lets which queue fill up?
ENTRIES["Q4_drain_imbalance"] = (
    lambda s, d: dirty(s, d).allocations.groupBy("thr", _lane(dirty(s, d)).alias("lane")).agg(
        F.count(F.lit(1)).alias("allocations"), F.count(F.when(F.col("freed"), 1)).alias("drained"),
        F.sum(F.when(~F.col("freed"), F.col("size"))).alias("pending_bytes"),
    ),
    over(
        "events",
        f"""SELECT thr, {_LANE} AS lane, count(*) AS allocations, count(*) FILTER (freed) AS drained,
            CAST(sum(size) FILTER (NOT freed) AS BIGINT) AS pending_bytes FROM al GROUP BY ALL""",
    ),
)
# What is wrong with the recording itself?
ENTRIES["Q5_integrity_audit"] = (
    lambda s, d: warnings.warnings(dirty(s, d)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("warnings"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    ),
    over("events", "SELECT kind, count(*) AS warnings, min(seq) AS first_seq, max(seq) AS last_seq FROM warn GROUP BY kind", WARN_SQL),
)


def _two_rankings(s, d):
    t = dirty(s, d)
    kept = where(t.allocations, ~alloc.freed)
    lead = aggregate.leaders(aggregate.summarize(kept, "site"), 1).select("trace_id", F.col("key").alias("site"))
    union = kept.filter("site is not null").join(lead, ["trace_id", "site"], "left_semi")
    before = members(t)
    after = annotate.replace(before, union, "hot")
    return annotate.changed(before, after).select("tag", "changed")


# Leaders among the unfreed by bytes and by count; tag both.
ENTRIES["Q6_two_rankings_tagged"] = (
    _two_rankings,
    over(
        "events",
        """SELECT tag, CASE WHEN tag = 'hot' THEN (SELECT count(*) FROM al a LEFT JOIN
             (SELECT site FROM lead1) l ON l.site = a.site WHERE (creator % 7 = 0) <> (NOT freed AND l.site IS NOT NULL)) ELSE 0 END AS changed
           FROM (SELECT unnest(['hot','cold','odd']) AS tag)""",
        """
grp AS (SELECT coalesce(site,'(none)') AS site, count(*) AS n, sum(size) AS b FROM al WHERE NOT freed GROUP BY 1),
lead1 AS (SELECT site FROM grp WHERE n = (SELECT max(n) FROM grp) OR b = (SELECT max(b) FROM grp))""",
    ),
)


def _stale(s, d, stale):
    t = dirty(s, d)
    owners = lineage.pointer_owners(pointers(t), t.allocations)
    chain = live.reuse_chains(t.allocations, t.allocations.count()).select(
        "trace_id", F.col("creator").alias("owner_now"), "generation", "previous"
    )
    pick = F.col("stale") if stale else ~F.col("stale") & F.col("owner_now").isNotNull()
    return owners.filter(pick).join(chain, ["trace_id", "owner_now"], "left").select(
        "seq", "ptr", "owner_then", "owner_now", "generation", "previous"
    )


def _stale_sql(cond):
    return f"""SELECT o.seq, o.ptr, o.owner_then, o.owner_now, c.generation, c.previous FROM own o
      LEFT JOIN (SELECT creator, row_number() OVER w AS generation, lag(creator) OVER w AS previous FROM al
                 WINDOW w AS (PARTITION BY addr ORDER BY creator)) c ON c.creator = o.owner_now WHERE {cond}"""


# Handles whose memory belongs to someone else by now.
ENTRIES["Q7_stale_handles"] = (
    lambda s, d: _stale(s, d, True),
    over("events", _stale_sql("owner_then IS NOT NULL AND owner_now IS DISTINCT FROM owner_then"), POINTERS_SQL),
)


def _interior(s, d):
    t = dirty(s, d)
    moved = t.events.filter("op = 'R' and target is not null").select(
        "trace_id", "seq", "target", (F.col("target_addr") + 16).alias("p_addr"), (F.col("seq") + 1).alias("p_pos")
    )
    from lifetrace.operators.address import pick

    now = pick(moved, t.allocations, ["seq"]).select("trace_id", "seq", "newest")
    return moved.join(now, ["trace_id", "seq"], "left").select(
        "seq", "target", F.col("p_addr").alias("ptr"), F.col("newest").alias("owner")
    )


# Who owns a pointer into a block right after the block was resized away?
ENTRIES["Q8_interior_pointer_after_resize"] = (
    _interior,
    over(
        "events",
        """SELECT e.seq, e.target, e.target_addr + 16 AS ptr, max(a.creator) AS owner FROM ev e LEFT JOIN al a
             ON a.addr <= e.target_addr + 16 AND a.end_span > e.target_addr + 16 AND a.creator < e.seq + 1 AND (a.death IS NULL OR a.death >= e.seq + 1)
           WHERE e.op = 'R' AND e.target IS NOT NULL GROUP BY ALL""",
    ),
)
# Reused addresses whose handle is still the right one.
ENTRIES["Q9_guarded_reuse"] = (
    lambda s, d: _stale(s, d, False),
    over(
        "events",
        _stale_sql("NOT (owner_then IS NOT NULL AND owner_now IS DISTINCT FROM owner_then) AND owner_now IS NOT NULL"),
        POINTERS_SQL,
    ),
)


def _cycles(s, d):
    per = aggregate.retention(dirty(s, d).allocations, malloc.of(dirty(s, d)).field("k").col)
    mean = per.groupBy("trace_id").agg(F.sum("retained_bytes").alias("sum_b"), F.count(F.lit(1)).alias("n"))
    both = per.join(mean, "trace_id")
    return longs(
        both.filter(F.col("retained_bytes") * F.col("n") > F.col("sum_b")), "retained_bytes", "total_bytes"
    ).select("cycle", "retained", "retained_bytes", "total_bytes")


# Cycles that leave more behind than the average one.
ENTRIES["Q10_retention_anomaly"] = (
    _cycles,
    over(
        "events",
        """SELECT cycle, retained, retained_bytes, total_bytes FROM (
             SELECT *, CAST(sum(retained_bytes) OVER (ORDER BY cycle) AS BIGINT) AS total_bytes,
               sum(retained_bytes) OVER () AS s, count(*) OVER () AS n FROM (
               SELECT CAST(json_extract('{' || extras || '}', '$.k') AS BIGINT) AS cycle, count(*) FILTER (NOT freed) AS retained,
                 CAST(coalesce(sum(size) FILTER (NOT freed),0) AS BIGINT) AS retained_bytes FROM al GROUP BY 1))
           WHERE retained_bytes * n > s""",
    ),
)
# Where does the allocator hand out more than was asked, and how much more?
ENTRIES["Q11_slack_regression"] = (
    lambda s, d: longs(aggregate.slack(dirty(s, d).allocations), "requested_known", "usable_known", "slack")
    .filter("slack * 10 > requested_known").select("key", "known", "requested_known", "usable_known", "slack"),
    over(
        "events",
        """SELECT * FROM (SELECT coalesce(site,'(none)') AS key, count(usable) AS known,
             CAST(sum(size) FILTER (usable IS NOT NULL) AS BIGINT) AS requested_known, CAST(sum(usable) AS BIGINT) AS usable_known,
             CAST(sum(usable) - sum(size) FILTER (usable IS NOT NULL) AS BIGINT) AS slack FROM al GROUP BY ALL) WHERE slack * 10 > requested_known""",
    ),
)
