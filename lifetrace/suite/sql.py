"""DuckDB text for the derived traces, the common head of every oracle.

Written from the rules, in window functions over a whole trace; it shares no
logic with the Spark side beyond the meaning of the columns.
"""

from __future__ import annotations

ORDERS_RECORDS = """
o_base AS (
  SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS prio,
         CAST(floor(o_totalprice) AS BIGINT) AS price,
         CAST(epoch(o_orderdate) AS BIGINT) AS t0,
         o_custkey*16777216 + (o_orderkey % 4)*2097152 AS base,
         '"status":"' || o_orderstatus || '","cust":' || CAST(o_custkey AS VARCHAR) AS ex
  FROM orders),
o_all AS (
  SELECT 'M' AS op, key+1 AS id, CAST(NULL AS BIGINT) AS kid, base AS addr, price AS size,
         CASE WHEN key % 3 = 0 THEN ((price+65535)//65536)*65536 END AS usable, t0 AS t,
         cust % 8 AS thr, prio AS site, 'order' || chr(10) || prio AS stack, ex AS extras FROM o_base
  UNION ALL
  SELECT 'F', key+1, key+1, NULL, NULL, NULL, t0 + 86400*(1 + key % 60), cust % 8, NULL, NULL,
         '"reason":"r' || CAST(key % 3 AS VARCHAR) || '"' FROM o_base WHERE status = 'F'
  UNION ALL
  SELECT 'R', key+1000000001, key+1, base + 8388608, price*2,
         CASE WHEN key % 3 = 0 THEN ((price*2+65535)//65536)*65536 END, t0 + 864000, cust % 8,
         prio, NULL, ex FROM o_base WHERE status = 'P'),
rec AS (
  SELECT 'orders' AS trace_id, row_number() OVER (ORDER BY t, op, id) - 1 AS ord, *,
         CAST(NULL AS BIGINT) AS dseq, CAST(NULL AS VARCHAR) AS title,
         CAST(NULL AS BIGINT) AS old_addr, CAST(NULL AS BIGINT) AS old_size
  FROM o_all)"""

EVENTS_RECORDS = """
d_base AS (
  SELECT event_id AS e, user_id AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CASE WHEN event_type IN ('view','click') THEN 'M' WHEN event_type = 'purchase' THEN 'F'
              WHEN event_type = 'signup' THEN 'R' ELSE 'E' END AS op,
         epoch_us(ts) AS us, CAST(floor(value*10) AS BIGINT) AS amount FROM events),
rec AS (
  SELECT 'events' AS trace_id, e AS ord, op,
    CASE WHEN op = 'M' AND k <> 13 THEN u WHEN op = 'R' THEN (u+k) % 150 WHEN op = 'F' THEN u END AS id,
    CASE WHEN op IN ('F','R') THEN u END AS kid,
    CASE WHEN op IN ('M','R') AND NOT (k = 7 AND e % 3 = 0) THEN u*4096 + k*32 END AS addr,
    CASE WHEN op IN ('M','R') THEN amount END AS size,
    CASE WHEN op IN ('M','R') AND k % 3 = 0 THEN ((amount+63)//64)*64 END AS usable,
    CASE WHEN e % 40 <> 3 THEN us - CASE WHEN e % 50 = 7 THEN 3600000000 ELSE 0 END END AS t,
    CASE WHEN k <> 21 THEN u % 8 END AS thr,
    CASE WHEN op IN ('M','R') AND k % 10 <> 9 THEN 'site_' || CAST(k % 10 AS VARCHAR)
         WHEN op = 'F' AND k % 2 = 0 THEN 'drain_' || CAST(u % 3 AS VARCHAR) END AS site,
    CASE WHEN op IN ('M','R') AND k % 4 = 0 THEN 'main' || chr(10) || 'step_' || CAST(k % 7 AS VARCHAR) END AS stack,
    CASE WHEN op IN ('M','R') THEN
           '"k":' || CAST(k AS VARCHAR) || ',"lane":"L' || CAST(k % 3 AS VARCHAR) || '"'
           || CASE WHEN k % 5 = 0 THEN ',"hot":true' WHEN k % 5 = 1 THEN ',"hot":false'
                   WHEN k % 5 = 2 THEN ',"hot":null' ELSE '' END
           || ',"load":' || CASE WHEN k % 2 = 0 THEN CAST(k // 4 AS VARCHAR) || '.' || CASE WHEN k % 4 = 0 THEN '0' ELSE '5' END
                            ELSE CAST(k AS VARCHAR) END
           || CASE WHEN k % 11 = 0 THEN ',"dbg":{"a":' || CAST(k AS VARCHAR) || '}' ELSE '' END
         WHEN op = 'F' THEN '"k":' || CAST(k AS VARCHAR) || ',"reason":"r' || CAST(k % 3 AS VARCHAR) || '"'
         ELSE '"k":' || CAST(k AS VARCHAR) || ',"frame":' || CAST(e AS VARCHAR) || ',"ptr":' || CAST(u*4096 + k*32 AS VARCHAR) END AS extras,
    CASE WHEN e % 1000 = 999 THEN e + 5 END AS dseq,
    CASE WHEN op = 'E' AND k % 4 <> 0 THEN 'phase-' || CAST(k % 5 AS VARCHAR) END AS title,
    CASE WHEN op = 'R' THEN u*4096 END AS old_addr,
    CASE WHEN op = 'R' AND k % 2 = 0 THEN amount + 1 END AS old_size
  FROM d_base)"""

# Sequencing, clamping, resolution and intervals over a table ``rec``.
RESOLVED = """
mk AS (
  SELECT r.*,
    coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq,
    max(t) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t_before,
    coalesce(max(t) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING), 0) AS tc
  FROM (SELECT *, coalesce(op IN ('M','F','R','E') AND NOT (op = 'F' AND coalesce(id,-1) = 0)
                  AND NOT (op IN ('M','R') AND addr IS NULL), FALSE) AS ok FROM rec) r),
acc AS (
  SELECT trace_id, CAST(seq AS BIGINT) AS seq, ord, op, id AS rid, coalesce(id,0) AS id, kid, tc AS t, t AS t_raw, t_before, dseq, thr,
    CASE WHEN op IN ('M','R') THEN addr END AS addr,
    CASE WHEN op IN ('M','R') THEN greatest(coalesce(size,0),1) END AS size,
    CASE WHEN op IN ('M','R') AND usable > greatest(coalesce(size,0),1) THEN usable END AS usable,
    op IN ('M','R') AND coalesce(size,0) <= 0 AS bad_size,
    CASE WHEN op <> 'E' THEN site END AS site, CASE WHEN op <> 'E' THEN stack END AS stack,
    CASE WHEN op = 'E' THEN title END AS title,
    old_addr AS rec_old_addr, old_size AS rec_old_size, extras
  FROM mk WHERE ok),
steps AS (
  SELECT kid AS key, seq, 0 AS sub, CAST(NULL AS BIGINT) AS made, FALSE AS obs, ord FROM acc WHERE op IN ('F','R') AND kid IS NOT NULL
  UNION ALL SELECT rid, seq, 1, seq, FALSE, ord FROM acc WHERE op IN ('M','R') AND rid IS NOT NULL
  UNION ALL SELECT kid, seq, 0, NULL, TRUE, ord FROM mk WHERE op = 'R' AND addr IS NULL AND kid IS NOT NULL),
found AS (
  SELECT *, last_value(made IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq, ord, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cand
  FROM steps),
firsts AS (SELECT cand, min(seq) AS seq FROM found WHERE sub = 0 AND NOT obs AND cand IS NOT NULL GROUP BY cand),
ended AS (SELECT cand AS creator, seq AS death FROM firsts),
cre AS (
  SELECT a.trace_id, a.seq AS creator, a.op, a.id, a.rid, a.addr, a.addr + a.size AS end_req,
    a.addr + greatest(a.size, coalesce(a.usable,0)) AS end_span, a.size, a.usable,
    greatest(a.size, coalesce(a.usable,0)) AS span, a.t AS birth_t, a.site, a.thr, a.stack, a.extras, x.death
  FROM acc a LEFT JOIN ended x ON x.creator = a.seq WHERE a.op IN ('M','R')),
tgt AS (SELECT death AS seq, creator AS target FROM ended),
ev AS (
  SELECT a.*, g.target, c.addr AS target_addr, c.size AS target_size, c.usable AS target_usable, c.site AS target_site,
    CASE WHEN a.op NOT IN ('F','R') THEN NULL WHEN g.target IS NOT NULL THEN 'ok'
         WHEN f.cand IS NOT NULL THEN 'double' ELSE 'unknown' END AS kill_status
  FROM acc a LEFT JOIN tgt g ON g.seq = a.seq LEFT JOIN cre c ON c.creator = g.target
  LEFT JOIN found f ON f.seq = a.seq AND f.sub = 0 AND NOT f.obs),
al AS (
  SELECT c.*, d.t AS death_t, d.op AS death_op, d.t - c.birth_t AS lifetime, c.death IS NOT NULL AS freed,
    r.target AS realloc_from, CASE WHEN d.op = 'R' THEN d.seq END AS realloc_to, d.extras AS death_extras
  FROM cre c LEFT JOIN acc d ON d.seq = c.death LEFT JOIN tgt r ON r.seq = c.creator),
ovl AS (
  SELECT DISTINCT a.creator, a.addr, a.end_span FROM cre a JOIN cre b
    ON b.addr < a.end_span AND b.end_span > a.addr AND b.creator < a.creator
   AND (b.death IS NULL OR b.death > a.creator)),
pos AS (SELECT count(*) AS n, count(*) // 2 AS h, count(*) // 4 AS q, min(t) AS t0, max(t) + 1 AS t1 FROM ev)"""

# Parameters of the registered queries that move with the data.
N, HALF, QUARTER = "(SELECT n FROM pos)", "(SELECT h FROM pos)", "(SELECT q FROM pos)"
T0, T1 = "(SELECT t0 FROM pos)", "(SELECT t1 FROM pos)"

_HEAD = {"orders": ORDERS_RECORDS, "events": EVENTS_RECORDS}


def over(trace: str, body: str, extra: str = "") -> str:
    """``body`` over the resolved trace: tables rec, mk, acc, ev, al, ovl."""
    more = f",\n{extra}" if extra else ""
    return f"WITH RECURSIVE {_HEAD[trace].strip()},\n{RESOLVED.strip()}{more}\n{body.strip()}"
