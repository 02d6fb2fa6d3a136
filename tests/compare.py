"""Run registered queries against their SQL and report differences."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r),
    )


def check(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a message."""
    df = fn(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return None if got is not None else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    mine = {n: same.get(t, t) for n, t in df.dtypes}
    theirs = {d[0]: str(d[1]) for d in cur.description}
    if mine != theirs:
        return f"types {[(n, mine.get(n), theirs.get(n)) for n in sorted(set(mine) | set(theirs)) if mine.get(n) != theirs.get(n)]}"
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"row {g} != {w}"
    return None


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from lifetrace.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = "/root/testdata/sf0.01"
    args = argv[1:]
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            problem = check(spark, con, sf_dir, name, fn, sql.get(name))
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        took = time.time() - start
        flag = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{flag} {name:34s} {took:6.2f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv)
