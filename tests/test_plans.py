"""Blocked scans, dense numbering, as-of and range joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lifetrace.operators import address, lineage, live
from lifetrace.plans import asof, expand, prefix, ranges, skew


def test_scan_over_blocks(spark):
    rng = random.Random(1)
    rows = []
    for key in "ab":
        places = sorted(rng.sample(range(500), 120))
        rows += [(key, p, rng.choice([None, rng.randrange(100)])) for p in places]
    df = spark.createDataFrame(rows, "k string, p bigint, v bigint").repartition(5)
    want = {}
    for key in "ab":
        total, top, last = 0, None, None
        for k, p, v in [r for r in rows if r[0] == key]:
            before = (total, top, last)
            total += v or 0
            top = v if top is None else (top if v is None else max(top, v))
            last = last if v is None else v
            want[(k, p)] = (total, top, last, *before)
    runs = []
    for inclusive in (True, False):
        for agg in ("sum", "max", "last"):
            runs.append(prefix.Run(f"{agg}{int(inclusive)}", agg, F.col("v"), inclusive))
    for bits, levels in ((2, 1), (20, 1), (1, 2), (0, 3)):
        got = prefix.scan(df, ["k"], ["p"], prefix.block_of("p", bits), runs, levels=levels)
        found = {
            (r.k, r.p): (r.sum1, r.max1, r.last1, r.sum0, r.max0, r.last0) for r in got.collect()
        }
        assert found == want


def test_dense_index(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), x) for x in rng.sample(range(10000), 1000)]
    df = spark.createDataFrame(rows, "k string, x bigint").repartition(7)
    got = prefix.dense_index(df, ["k"], ["x"], "i").collect()
    for key in "abc":
        ordered = sorted(x for k, x in rows if k == key)
        assert {(r.x, r.i) for r in got if r.k == key} == {(x, i) for i, x in enumerate(ordered)}


def test_hot_keys_are_found_exactly_when_small(spark):
    df = spark.createDataFrame([("t", i % 3 if i < 30 else 9, i) for i in range(90)], "trace_id string, k bigint, s bigint")
    hot = skew.hot_keys(df, ["k"], 90, "s", hot_rows=40)
    assert [r.k for r in hot.collect()] == [9]
    assert skew.hot_keys(df, ["k"], 10, "s", hot_rows=40) is None


def test_latest_at_or_before(spark):
    right = spark.createDataFrame([("t", 10, "a"), ("t", 20, "b"), ("u", 5, "c")], "k string, at bigint, v string")
    left = spark.createDataFrame(
        [("t", 9, 1), ("t", 10, 2), ("t", 19, 3), ("t", 99, 4), ("u", 4, 5), ("w", 1, 6)], "k string, at bigint, n bigint"
    )
    got = {r.n: r.v for r in asof.latest_at_or_before(left, right, ["k"], "at", ["v"]).collect()}
    assert got == {1: None, 2: "a", 3: "a", 4: "b", 5: None, 6: None}


def intervals(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        addr = rng.choice([0, 4096, rng.randrange(1 << 20), rng.randrange(1 << 44)])
        size = rng.choice([1, 16, 300, 70000, 1 << 22])
        death = rng.choice([None, c + 1 + rng.randrange(1, 60), c + 1 + rng.randrange(1, 4000)])
        rows.append(("t", c, addr, addr + size, death))
    return rows


SCHEMA = "trace_id string, creator bigint, addr bigint, end_span bigint, death bigint"


@pytest.mark.parametrize("part_rows", [ranges.PART_ROWS, 5])
def test_births_in_live(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ranges, "PART_ROWS", part_rows)
    rows = intervals(3)
    want = {
        a[1] for a in rows for b in rows
        if b[1] < a[1] and (b[4] is None or b[4] > a[1]) and b[2] < a[3] and b[3] > a[2]
    }
    for form in ("bigint", "decimal(20,0)"):
        df = spark.createDataFrame(rows, SCHEMA).withColumns(
            {c: F.col(c).cast(form) for c in ("addr", "end_span")}
        )
        for limit in (64, 2, 0):
            assert {r.creator for r in ranges.births_in_live(df, limit).collect()} == want


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 20])
def test_allocations_of_one_start_are_settled_by_a_running_maximum(spark, monkeypatch, hot_rows):
    """A few starts used again and again leave next to nothing to pair or to stack up."""
    rng = random.Random(11)
    rows = []
    for c in range(600):
        addr = rng.randrange(6) * 64
        death = rng.choice([None, c + 1 + rng.randrange(1, 60)])
        rows.append(("t", c, addr, addr + rng.choice([1, 40, 64, 100, 300]), death))
    want = {
        a[1] for a in rows for b in rows
        if b[1] < a[1] and (b[4] is None or b[4] > a[1]) and b[2] < a[3] and b[3] > a[2]
    }
    sizes, pairs = [], ranges._paired

    def counted(newborn, living, *more):
        sizes.append((newborn.count(), living.count()))
        return pairs(newborn, living, *more)

    monkeypatch.setattr(ranges, "_paired", counted)
    got = ranges.births_in_live(spark.createDataFrame(rows, SCHEMA), 64, hot_rows, 4)
    assert sorted(r.creator for r in got.collect()) == sorted(want)
    assert len(sizes) == 1 and max(sizes[0]) < 300  # every row at every level would be 1,200 or more


@pytest.mark.parametrize("limit", [64, 2, 0])
def test_best_occupants(spark, limit):
    rows = intervals(4)
    rng = random.Random(4)
    points = [("t", i, rng.choice(rows)[2] + rng.randrange(40), rng.randrange(4500)) for i in range(200)]
    covers = {
        p[1]: [a for a in rows if a[2] <= p[2] < a[3] and a[1] < p[3] and (a[4] is None or a[4] >= p[3])] for p in points
    }
    want = {
        i: (max(a[1] for a in c), max((a[2], a[1]) for a in c)) for i, c in covers.items() if c
    }
    for form in ("bigint", "decimal(20,0)"):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.col(c).cast(form) for c in ("addr", "end_span")})
        pts = spark.createDataFrame(points, "trace_id string, i bigint, p_addr bigint, p_pos bigint").withColumn("p_addr", F.col("p_addr").cast(form))
        got = ranges.best_occupants(pts, df, ["i"], limit).collect()
        assert {r.i: (r.newest, (int(r.near.addr), r.near.creator)) for r in got} == want and len(got) == len(want)


def test_points_are_listed_once_where_few_allocations_lie(spark, monkeypatch):
    """Widths and lifetimes of many levels, a few allocations side by side: no row per pair of levels."""
    rng = random.Random(21)
    rows = []
    for c in range(1200):
        addr = rng.randrange(300) * (1 << 21)
        death = rng.choice([None, c + 1 + rng.randrange(20), c + 1 + rng.randrange(1000)])
        rows.append(("t", c, addr, addr + rng.choice([100, 3000, 60_000, 900_000]), death))
    alloc = spark.createDataFrame(rows, SCHEMA)
    points = alloc.selectExpr("trace_id", "creator AS i", "addr + (end_span - addr) div 2 AS p_addr", "creator + 5 AS p_pos")
    sizes, join = [], type(alloc).join

    def counted(self, other, on=None, how=None):
        if how is None and isinstance(on, list) and "bin" in on and "asks" not in other.columns:
            sizes.append((self.count(), other.count()))
        return join(self, other, on, how)

    monkeypatch.setattr(type(alloc), "join", counted)
    got = ranges.best_occupants(points, alloc, ["i"])
    monkeypatch.undo()
    assert len(sizes) == 1 and sizes[0][0] == 1200 and sizes[0][1] < 2400
    want = {}
    for _, i, a, e, _ in rows:
        x, p = a + (e - a) // 2, i + 5
        over = [r for r in rows if r[2] <= x < r[3] and r[1] < p and (r[4] is None or r[4] >= p)]
        if over:
            want[i] = (max(r[1] for r in over), max((r[2], r[1]) for r in over))
    assert {r.i: (r.newest, tuple(r.near)) for r in got.collect()} == want


@pytest.mark.parametrize("hot", [False, True])
def test_stacks_of_one_start_are_cut_into_slabs(spark, monkeypatch, hot):
    """2,000 on one start, most of them never freed, of any size: no rows per pair of tree nodes."""
    rng = random.Random(22)
    rows = []
    for c in range(2000):
        size = rng.randrange(1, 1 << 20)
        rows.append(("t", c, 4096, 4096 + size, rng.choice([None, None, c + 1 + rng.randrange(30)])))
    if hot:
        needed = ranges._needed
        monkeypatch.setattr(ranges, "_needed", lambda df, cell, count: needed(df, cell, count, 200, 6))
    monkeypatch.setattr(ranges, "_best_by_nodes", lambda *_: pytest.fail("rows per pair of tree nodes"))
    alloc = spark.createDataFrame(rows, SCHEMA)
    points = [("t", i, 4096 + rng.randrange(1 << 20), rng.randrange(2100)) for i in range(2000)]
    asked = spark.createDataFrame(points, "trace_id string, i bigint, p_addr bigint, p_pos bigint")
    want = {}
    for _, i, x, p in points:
        over = [r[1] for r in rows if r[2] <= x < r[3] and r[1] < p and (r[4] is None or r[4] >= p)]
        if over:
            want[i] = (max(over), (4096, max(over)))
    got = ranges.best_occupants(asked, alloc, ["i"]).collect()
    assert {r.i: (r.newest, tuple(r.near)) for r in got} == want and len(got) == len(want)


def test_many_open_allocations_at_one_address_make_no_pairs(spark):
    n = 20_000
    alloc = spark.range(n).select(
        F.lit("t").alias("trace_id"), F.col("id").alias("creator"), F.lit(4096).cast("bigint").alias("addr"),
        (F.lit(4160) + F.col("id") % 3).cast("bigint").alias("end_span"), F.lit(None).cast("bigint").alias("death"),
    )
    points = spark.range(n).select(F.lit("t").alias("trace_id"), F.col("id").alias("i"), F.lit(4159).cast("bigint").alias("p_addr"), F.col("id").alias("p_pos"))
    got = ranges.best_occupants(points, alloc, ["i"])
    assert got.filter("newest = i - 1 AND near.creator = i - 1").count() == got.count() == n - 1


@pytest.mark.parametrize("limit", [64, 0])
@pytest.mark.parametrize("form", ["bigint", "decimal(20,0)"])
def test_innermost_holders(spark, limit, form):
    rows = [r for r in intervals(5, 150) if r[1] % 2] + [("u", *r[1:]) for r in intervals(6, 60)]
    rows += [("t", 9000 + i, 100 - i % 7, 400 + i % 5, None) for i in range(30)]
    children = [(*r[:2], r[2] + 1, max(r[2] + 2, r[3] - r[1] % 3)) for r in intervals(5, 150) if r[1] % 2 == 0]
    children += [("t", 9500 + i, 120 + i, 300 + i * 5) for i in range(30)] + [("u", i, 200, 210) for i in range(0, 3000, 300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.col(c).cast(form) for c in ("addr", "end_span")})
    inner = spark.createDataFrame(children, "trace_id string, child bigint, i_addr bigint, i_end bigint")
    inner = inner.withColumns({c: F.col(c).cast(form) for c in ("i_addr", "i_end")})
    want = {}
    for t, child, lo, hi in children:
        held = [a for a in rows if a[0] == t and a[1] < child and a[2] <= lo and hi <= a[3]]
        if held:
            want[t, child] = max((a[2], -a[3], a[1]) for a in held)[2], len(held)
    got = ranges.innermost(inner, df, limit).collect()
    assert {(r.trace_id, r.child): (r.parent, r.holders) for r in got} == want and len(got) == len(want)
    assert max(n for _, n in want.values()) > 20


def test_many_stacked_holders_make_no_pairs(spark):
    n = 3000
    df = spark.range(n).select(
        F.lit("t").alias("trace_id"), F.col("id").alias("creator"), F.col("id").alias("addr"), (20_000 - F.col("id")).alias("end_span")
    )
    inner = spark.range(n).select(
        F.lit("t").alias("trace_id"), (F.col("id") + 1).alias("child"), F.lit(10_000).cast("bigint").alias("i_addr"), F.lit(10_001).cast("bigint").alias("i_end")
    )
    got = ranges.innermost(inner, df)
    assert got.filter("parent = child - 1 AND holders = child").count() == got.count() == n


def test_covered_spans(spark):
    rows = intervals(5, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    spans = [("t", i, r[2] + i % 4, r[2] + i % 4 + 1 + i % 30) for i, r in enumerate(rows)] + [("u", 999, 0, 10)]
    asked = spark.createDataFrame(spans, "trace_id string, i bigint, i_addr bigint, i_end bigint")
    want = {s[1] for s in spans if any(a[0] == s[0] and a[2] <= s[2] and s[3] <= a[3] for a in rows)}
    got = [r.i for r in ranges.covered(asked, df).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(spans)


def test_segments(spark):
    rows = [(a, a + s) for a, s in ((0, 10), (5, 10), (5, 10), (20, 1), (1 << 40, 4))]
    df = spark.createDataFrame([("t", a, b) for a, b in rows], "trace_id string, a bigint, b bigint")
    got = sorted((r.start, r.stop, r.depth) for r in address.segments(df, "a", "b").collect())
    assert got == [(0, 5, 1), (5, 10, 3), (10, 15, 2), (20, 21, 1), (1 << 40, (1 << 40) + 4, 1)]


def test_rows_listed_per_level_are_never_broadcast(spark):
    """The planner takes them for as small as the table they come from."""
    df = spark.createDataFrame(intervals(4), SCHEMA)
    pts = df.selectExpr("trace_id", "creator AS i", "addr AS p_addr", "creator + 40 AS p_pos")
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    assert plan(ranges.best_occupants(pts, df, ["i"], 0)).count("SortMergeJoin") == 2
    inner = df.selectExpr("trace_id", "creator AS child", "addr AS i_addr", "end_span AS i_end")
    assert plan(ranges.contained(inner, df)).count("SortMergeJoin") == 1


def test_every_holder_of_a_child_is_returned(spark, monkeypatch):
    monkeypatch.setattr(ranges, "PART_ROWS", 5)
    rows = intervals(12, 120)
    children = [("t", c, a, e) for _, c, a, e, _ in intervals(13, 120)]
    inner = spark.createDataFrame(children, "trace_id string, child bigint, i_addr bigint, i_end bigint")
    want = sorted(
        (h[1], c[1]) for h in rows for c in children if h[1] < c[1] and h[2] <= c[2] and c[3] <= h[3]
    )
    got = ranges.contained(inner, spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.creator, r.child) for r in got.collect()) == want and len(want) > len({c for _, c in want})


def test_layout_fills_short_runs_and_pins(spark):
    rows = spark.createDataFrame([("t", r) for r in (0, 1, 4, 20)], "trace_id string, row bigint")
    got = lambda df: sorted((r.row, r.gaps_before, r.filler) for r in df.collect())
    assert got(address.layout(rows, 5)) == [
        (0, 0, False), (1, 0, False), (2, 0, True), (3, 0, True), (4, 0, False), (20, 1, False)
    ]
    pins = spark.createDataFrame([("t", 12), ("t", 4)], "trace_id string, row bigint")
    assert got(address.layout(rows, 1, pins)) == [
        (0, 0, False), (1, 0, False), (4, 1, False), (12, 2, False), (20, 3, False)
    ]
    assert address.collapse_rows(1, 64) == 1 and address.collapse_rows(129, 64) == 3


def test_long_resize_chain(spark):
    n = 70
    rows = [("t", i, i - 1 if i else None, i + 1 if i < n - 1 else None, 10 + i, i < n - 1) for i in range(n)]
    df = spark.createDataFrame(
        rows, "trace_id string, creator bigint, realloc_from bigint, realloc_to bigint, size bigint, freed boolean"
    )
    assert [(r.creator, r.root, r.generation) for r in lineage.chains(df).orderBy("creator").collect()] == [
        (i, 0, i) for i in range(n)
    ]
    r = lineage.chain_summary(df).first()
    assert (r.length, r.tail, r.first_size, r.last_size, r.live) == (n, n - 1, 10, 10 + n - 1, True)


def test_one_wide_interval_over_many_narrow_ones(spark, monkeypatch):
    """Its cell holds all rows; they are paired in parts of bounded size."""
    monkeypatch.setattr(ranges, "PART_ROWS", 500)
    rows = [("t", 0, 0, 1 << 40, None)] + [("t", c, c * 64, c * 64 + 32, None) for c in range(1, 5001)]
    rows.append(("t", 5001, 0, 1 << 41, None))
    got = {r.creator for r in ranges.births_in_live(spark.createDataFrame(rows, SCHEMA), 64).collect()}
    assert got == set(range(1, 5002))


def test_rows_of_a_wide_span_are_all_marked(spark):
    from types import SimpleNamespace

    alloc = spark.createDataFrame(
        [("t", 0, 0, 100_000 * 16, 100_000 * 16, None), ("t", 1, 160, 176, 16, None)],
        "trace_id string, creator bigint, addr bigint, end_span bigint, size bigint, death bigint",
    )
    headers = spark.createDataFrame([("t", 0)], "trace_id string, arena_base bigint")
    trace = SimpleNamespace(allocations=alloc, headers=headers)
    rows = address.occupancy(trace, 16)
    assert rows.count() == 100_000 and rows.filter("allocations = 2").count() == 1
    runs = sorted(tuple(r)[1:] for r in address.occupied_runs(trace, 16).collect())
    assert runs == [(0, 10, 1), (10, 11, 2), (11, 100_000, 1)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lifetrace import session

    conf = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_staged_tables_can_be_deleted(spark, tmp_path):
    import os

    from lifetrace import session

    old = session._RUN
    session._RUN = "test-run"
    try:
        df = session.staged(spark.range(3), "x")
        folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
        assert df.count() == 3 and os.path.isdir(folder)
        session.discard_staged(spark)
        assert not os.path.isdir(folder)
    finally:
        session._RUN = old


def test_live_sets_of_many_positions(spark, monkeypatch):
    """Beyond a broadcast: equal to the intervals, and open allocations are no key."""
    n = 3000
    deaths = {i: None if i % 3 else i + 1 + i % 50 for i in range(0, n, 2)}
    rows = [("t", i, d) for i, d in deaths.items()] + [("u", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "trace_id string, creator bigint, death bigint")
    heads = [("t", p) for p in [0, 1, 1, 7, 500, 501, n + 90]] + [("u", 3), ("v", 1)]
    heads += [("t", p) for p in range(1000, 3000, 25)]
    asked = spark.createDataFrame([(t, p, i) for i, (t, p) in enumerate(heads)], "trace_id string, n bigint, i int")
    want = sorted((i, t, c) for i, (t, p) in enumerate(heads) for tt, c, d in rows if t == tt and c < p and (d is None or d >= p))
    got = {}
    for limit in (live.PLAYHEADS_BROADCAST, 0):
        monkeypatch.setattr(live, "PLAYHEADS_BROADCAST", limit)
        got[limit] = live.sets_at(asked, df, ["death"]).select("i", "trace_id", "creator").collect()
        assert sorted(map(tuple, got[limit])) == want
    heads_of = spark.createDataFrame([(p,) for p in range(1000, 3000)], "n bigint").selectExpr("'t' AS trace_id", "n")
    sizes = sorted(r["count"] for r in live.sets_at(heads_of, df, []).groupBy("n").count().collect())
    assert sizes[-1] <= 4 * sizes[len(sizes) // 2]


def test_expanded_ranges(spark, monkeypatch):
    rows = [("a", 3, 3), ("b", 5, 4), ("c", 0, 70), ("d", 1000, 1300), ("e", (1 << 62) - 2, (1 << 62) + 1)]
    df = spark.createDataFrame(rows, "k string, x bigint, y bigint")
    for bits in (16, 2, 4):
        monkeypatch.setattr(expand, "PIECE_BITS", bits)
        got = sorted((r.k, r.n) for r in expand.expanded(df, "x", "y", "n").collect())
        assert got == sorted((k, n) for k, x, y in rows for n in range(x, y + 1))


def test_a_wide_span_streams_through_its_rows(spark):
    wide = spark.createDataFrame([("t", 1, 1 << 40, (1 << 40) + (1 << 33), 0)], "trace_id string, creator bigint, addr bigint, end_span bigint, base bigint")
    spans = wide.select("trace_id", "creator", F.lit(0).cast("bigint").alias("row_first"), ((F.col("end_span") - F.col("addr")) / 16 - 1).cast("bigint").alias("row_last"))
    got = expand.expanded(spans, "row_first", "row_last", "row").agg(F.count(F.lit(1)), F.max("row"), F.countDistinct(F.expr("row >> 20"))).first()
    assert tuple(got) == (1 << 29, (1 << 29) - 1, 1 << 9)
