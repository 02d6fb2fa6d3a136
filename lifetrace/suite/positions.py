"""W rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lifetrace.operators import live
from lifetrace.suite.aggregates import RUN_SQL, longs
from lifetrace.suite.sql import HALF, QUARTER, over
from lifetrace.suite.tables import dirty, half, orders, quarter, size_of, times

ENTRIES = {}


PLAYHEADS = 64


def playheads(t):
    """So many positions, evenly over the whole stream."""
    n = size_of(t)
    return t.headers.select("trace_id", F.explode(F.lit([i * n // PLAYHEADS for i in range(PLAYHEADS)]).cast("array<bigint>")).alias("n"))


PLAYHEADS_SQL = f"(SELECT unnest(range({PLAYHEADS})) * (SELECT count(*) FROM ev) // {PLAYHEADS} AS seq)"


for _n, _t in (("orders", orders), ("events", dirty)):
    ENTRIES[f"W1_running_{_n}"] = (
        lambda s, d, t=_t: longs(live.running(t(s, d).events), "live_bytes").drop("trace_id"),
        over(_n, "SELECT * FROM runs", RUN_SQL),
    )
ENTRIES["W2_live_at_position"] = (
    lambda s, d: orders(s, d).allocations.filter(live.live_at(half(orders(s, d)))).select("creator", "addr", "size"),
    over(
        "orders",
        f"SELECT creator, addr, size FROM al WHERE creator < {HALF} AND (death IS NULL OR death >= {HALF})",
    ),
)
ENTRIES["W3_live_at_time"] = (
    lambda s, d: orders(s, d).allocations.filter(live.live_at_time(sum(times(orders(s, d))) // 2)).select("creator", "size"),
    over(
        "orders",
        """SELECT creator, size FROM al, (SELECT count(*) AS n FROM ev WHERE t <= (SELECT (t0 + t1) // 2 FROM pos)) p
           WHERE creator < n AND (death IS NULL OR death >= n)""",
    ),
)
ENTRIES["W4_totals_at_positions"] = (
    lambda s, d: longs(live.totals_at(playheads(orders(s, d)), orders(s, d).events), "live_bytes").drop("trace_id"),
    over(
        "orders",
        f"""SELECT p.seq AS n, coalesce(r.live_count,0) AS live_count, coalesce(r.live_bytes,0) AS live_bytes
           FROM {PLAYHEADS_SQL} p LEFT JOIN runs r ON r.seq = p.seq - 1""",
        RUN_SQL,
    ),
)
ENTRIES["W4_sets_at_positions"] = (
    lambda s, d: live.sets_at(playheads(dirty(s, d)), dirty(s, d).allocations, ["size"])
    .groupBy("n").agg(F.count(F.lit(1)).alias("live"), F.sum("size").alias("bytes")),
    over(
        "events",
        f"""SELECT p.seq AS n, count(*) AS live, CAST(sum(a.size) AS BIGINT) AS bytes FROM {PLAYHEADS_SQL} p JOIN al a
           ON a.creator < p.seq AND (a.death IS NULL OR a.death >= p.seq) GROUP BY 1""",
    ),
)
ENTRIES["W5_diff"] = (
    lambda s, d: live.diff(orders(s, d).allocations, quarter(orders(s, d)), half(orders(s, d))).select("creator", "change"),
    over(
        "orders",
        f"""SELECT creator, CASE WHEN a AND b THEN 'survived' WHEN a THEN 'died' ELSE 'born' END AS change
           FROM (SELECT creator, creator < {QUARTER} AND (death IS NULL OR death >= {QUARTER}) AS a,
                 creator < {HALF} AND (death IS NULL OR death >= {HALF}) AS b FROM al) WHERE a OR b""",
    ),
)
ENTRIES["W6_prefix_counts"] = (
    lambda s, d: live.prefix_counts(dirty(s, d).events).select("seq", "births_before", "frees_before"),
    over(
        "events",
        """SELECT seq, CAST(coalesce(sum(CASE WHEN op IN ('M','R') THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS births_before,
           CAST(coalesce(sum(CASE WHEN op IN ('F','R') THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS frees_before
           FROM ev WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
)
ENTRIES["W7_age_fraction"] = (
    lambda s, d: live.ages(orders(s, d).allocations, orders(s, d).events, half(orders(s, d)))
    .select("creator", "oldest_t", F.round("age_fraction", 6).alias("age_fraction")),
    over(
        "orders",
        f"""SELECT creator, oldest_t, round(ln(1.0::DOUBLE + (now - birth_t)) / ln(1.0::DOUBLE + (now - oldest_t)), 6) AS age_fraction
           FROM (SELECT creator, birth_t, min(birth_t) OVER () AS oldest_t, (SELECT t FROM ev WHERE seq = {HALF} - 1) AS now
                 FROM al WHERE creator < {HALF} AND (death IS NULL OR death >= {HALF}))""",
    ),
)
ENTRIES["W9_widest_live"] = (
    lambda s, d: live.widest(orders(s, d).allocations, half(orders(s, d))),
    over(
        "orders",
        f"SELECT 'orders' AS trace_id, max(span) AS widest FROM al WHERE creator < {HALF} AND (death IS NULL OR death >= {HALF})",
    ),
)
for _n, _t in (("orders", orders), ("events", dirty)):
    ENTRIES[f"W10_reuse_chains_{_n}"] = (
        lambda s, d, t=_t: live.reuse_chains(t(s, d).allocations, t(s, d).allocations.count()).drop("trace_id"),
        over(
            _n,
            """SELECT addr, creator, id, size, site, death, row_number() OVER w AS generation, lag(creator) OVER w AS previous,
               lag(death) OVER w AS previous_death, creator - lag(death) OVER w AS gap
               FROM al WINDOW w AS (PARTITION BY addr ORDER BY creator)""",
        ),
    )
ENTRIES["W11_bursts"] = (
    lambda s, d: live.bursts(orders(s, d).events).drop("trace_id"),
    over(
        "orders",
        "SELECT t, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY t HAVING count(*) > 1",
    ),
)
