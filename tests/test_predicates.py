"""Two-valued predicates, exact numbers, units, references."""

import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lifetrace.functions import exact
from lifetrace.functions.buckets import bucket
from lifetrace.functions.predicates import (
    KiB, MiB, Single, Value, Varied, alloc, duration, free, malloc, where, with_allocation, with_named,
)
from lifetrace.operators import fields, filters
from lifetrace.trace import Trace

ROWS = [
    # creator, id, addr, end_span, size, usable, freed, site, thr, extras, death, death_t, death_extras
    (0, 1, 4096, 4160, 64, None, True, "row_cache", 1, '"hot":true,"load":1,"pool":"arena"', 5, 50, '"reason":"x"'),
    (1, 2, 8192, 8320, 100, 128, False, None, None, '"hot":null,"load":0.5', None, None, None),
    (2, 3, 12288, 12289, 1, None, False, "row", 2, None, None, None, None),
    (3, 0, 0, 10, 10, None, True, "main", 1, '"hot":false,"load":9007199254740993', 9, 90, None),
]
SCHEMA = (
    "creator bigint, id bigint, addr bigint, end_span bigint, size bigint, usable bigint, freed boolean, "
    "site string, thr bigint, extras string, death bigint, death_t bigint, death_extras string"
)


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("trace_id", F.lit("t"))
    return rows.withColumns({"custom": fields.parsed(), "death_custom": fields.parsed("death_extras")})


def hits(frame, test):
    by_filter = sorted(r.creator for r in where(frame, test).collect())
    as_value = sorted(r.creator for r in frame.select("creator", test.column().alias("p")).filter("p").collect())
    assert by_filter == as_value
    return by_filter


def test_missing_is_false_and_not_makes_it_true(frame):
    assert hits(frame, malloc.site == "row") == [2]
    assert hits(frame, malloc.site != "row") == [0, 3]
    assert hits(frame, ~(malloc.site == "row")) == [0, 1, 3]
    assert hits(frame, ~(malloc.site != "row")) == [1, 2]
    assert hits(frame, (malloc.thread > 1) | ~(malloc.thread > 0)) == [1, 2]
    assert hits(frame, malloc.thread.is_none()) == [1]


def test_missing_flag_under_not_is_true(frame):
    hot = malloc.field("hot", "bool")
    assert hits(frame, hot) == [0]
    assert hits(frame, ~hot) == [1, 2, 3]
    assert hits(frame, hot == False) == [3]  # noqa: E712
    assert hits(frame, hot.is_none()) == [1, 2]


def test_custom_fields(frame):
    load = malloc.field("load", "float")
    assert hits(frame, load == 1) == [0]
    assert hits(frame, load == 9007199254740993) == [3]
    assert hits(frame, load == 9007199254740992) == []
    assert hits(frame, load == 9007199254740992.0) == []
    assert hits(frame, load < 1) == [1]
    assert hits(frame, load + 0.5 == 1.5) == [0]
    assert hits(frame, malloc.field("pool", "string") == "arena") == [0]
    assert hits(frame, malloc.field("pool", "int") == 1) == []
    assert hits(frame, free.field("reason", "string").is_not_none()) == [0]


def two_traces(spark):
    """``load`` is a number in one trace and a string in the other."""
    rows = [
        ("a", 0, '"load":1,"pool":"x","big":1,"odd":{"a":1}'), ("a", 1, '"load":2.5,"pool":null,"big":36893488147419103232'),
        ("a", 2, '"load":3.0'), ("b", 0, '"load":"1","pool":"y"'), ("b", 1, '"load":"zig","mixed":1'), ("b", 2, '"mixed":"1"'),
        ("b", 3, None),
    ]
    frame = spark.createDataFrame(rows, "trace_id string, creator bigint, extras string")
    frame = frame.withColumns({"ord": F.col("creator"), "reason": F.lit(""), "custom": fields.parsed()})
    return Trace(frame, frame, frame, frame, frame, fields.catalog_of(frame, frame))


def pairs(t, test):
    return sorted((r.trace_id, r.creator) for r in where(t.allocations, test).collect())


def test_kinds_come_from_the_catalog(spark):
    t = two_traces(spark)
    load = malloc.of(t).field("load")
    assert isinstance(load, Varied)
    assert pairs(t, load == 1) == [("a", 0)]
    assert pairs(t, load == "1") == [("b", 0)]
    assert pairs(t, load > 2) == [("a", 1), ("a", 2)]
    assert pairs(t, load.isin([2.5, "zig", 7])) == [("a", 1), ("b", 1)]
    assert pairs(t, load.startswith("z") | (load + 1 == 4)) == [("a", 2), ("b", 1)]
    assert pairs(t, load.is_none()) == [("b", 2), ("b", 3)]
    assert pairs(t, ~(load == 1)) == [("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("b", 3)]
    assert pairs(t, malloc.of(t).field("pool") == "y") == [("b", 0)]
    assert pairs(t, malloc.of(t).field("big") == 2**65) == [("a", 1)]
    assert pairs(t, malloc.of(t).field("load", "string").contains("i")) == [("b", 1)]


def test_wrong_kinds_are_errors(spark):
    t = two_traces(spark)
    load = malloc.of(t).field("load")
    for wrong in (
        lambda: load == True,  # noqa: E712
        lambda: malloc.of(t).field("pool", "int"),
        lambda: malloc.of(t).field("mixed"),
        lambda: malloc.of(t).field("odd"),
        lambda: malloc.of(t).field("load", "bool"),
        lambda: malloc.of(t).field("pool") > 3,
        lambda: malloc.of(t).field("big").contains("3"),
        lambda: malloc.of(t).field("pool") + 1,
        lambda: malloc.field("pool"),
    ):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(LookupError):
        malloc.of(t).field("absent")


def test_a_known_field_is_read_by_the_scan_alone(spark, tmp_path):
    t = two_traces(spark)
    t.allocations.write.parquet(str(tmp_path / "allocations"))
    stored = spark.read.parquet(str(tmp_path / "allocations"))
    plan = where(stored, malloc.of(t).field("pool") == "y").select("creator")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(custom" in plan and "parse_json" not in plan and "extras" not in plan


def test_strings_sets_ranges(frame):
    assert hits(frame, malloc.site.startswith("row")) == [0, 2]
    assert hits(frame, malloc.site.contains("_ca")) == [0]
    assert hits(frame, malloc.site.isin(["row", "main"])) == [2, 3]
    assert hits(frame, alloc.size.isin([1, 99.5, 100.0])) == [1, 2]
    assert hits(frame, alloc.size.between(10, 100)) == [0, 3]
    assert hits(frame, alloc.span.overlaps(4159, 8192)) == [0]
    assert hits(frame, abs(alloc.size - 64) <= 36) == [0, 1]
    assert hits(frame, alloc.usable - alloc.size >= 28) == [1]


def test_overflow_is_missing(frame):
    huge = Value("int", exact.integer(10**38 - 1))
    assert hits(frame, huge + alloc.size > 0) == []
    assert hits(frame, ~(huge + alloc.size > 0)) == [0, 1, 2, 3]


def test_references(frame, spark):
    notes = spark.createDataFrame([("t", 1, "anchor"), ("t", 2, "twice"), ("t", 3, "twice")], "trace_id string, creator bigint, name string")
    rows, anchor = with_named(frame, notes, "anchor")
    assert hits(rows, alloc.size < anchor.size) == [0, 2, 3]
    both = frame.unionByName(frame.withColumn("trace_id", F.lit("u")).withColumn("size", F.col("size") + 1000))
    two = notes.unionByName(notes.filter("name = 'anchor'").withColumn("trace_id", F.lit("u")).withColumn("creator", F.lit(0).cast("bigint")))
    rows, anchor = with_named(both, two, "anchor")
    got = sorted((r.trace_id, r.creator) for r in where(rows, alloc.size < anchor.size).collect())
    here = {(r.trace_id, r.creator): r["size"] for r in both.collect()}
    base = {"t": here["t", 1], "u": here["u", 0]}
    assert got == sorted(k for k, v in here.items() if v < base[k[0]])
    rows, one = with_allocation(both, 2)
    assert where(rows, malloc.seq == one.seq).count() == 2
    for bad in (lambda: with_named(both, two, "twice"), lambda: with_named(both, two, "none"), lambda: with_allocation(both, 77)):
        with pytest.raises(Single):
            bad()
    rows, one = with_allocation(frame, 2)
    assert hits(rows, one.site.is_none()) == [0, 1, 2, 3]


def test_units():
    assert KiB(4) == 4096 and MiB(1.5) == 1572864.0
    assert duration(3, "ms", "us") == 3000
    assert duration(1500, "us", "ms") == 1.5
    assert duration(2000, "us", "ms") == 2
    with pytest.raises(ValueError):
        duration(1, "s", "tick")


def test_buckets(spark):
    values = [0, 1, 2, 3, 4, 1023, 1024, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = [r[0] for r in df.select(bucket(F.col("v"))).collect()]
    assert got == ["0", "1..2", "2..4", "2..4", "4..8", "512..1024", "1024..2048", f"{1 << 62}..{1 << 63}"]


NUMBERS = st.one_of(
    st.integers(-(2**64), 2**64),
    st.sampled_from([2**53 - 1, 2**53, 2**53 + 1, 2**63, 2**64 - 1, -(2**53) - 1, 0]),
)
FLOATS = st.one_of(
    st.floats(allow_nan=True, allow_infinity=True),
    st.sampled_from([2.0**53, 2.0**63, 0.5, -0.5, 1e300, -1e300, 9007199254740994.0]),
)
OPS = ["==", "!=", "<", "<=", ">", ">="]


def truth(op, a, b):
    if isinstance(b, float) and math.isnan(b) or isinstance(a, float) and math.isnan(a):
        return False
    x = a if isinstance(a, float) and math.isinf(a) else Fraction(a)
    y = b if isinstance(b, float) and math.isinf(b) else Fraction(b)
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


@settings(max_examples=8, deadline=None, derandomize=True)
@given(st.lists(NUMBERS, min_size=5, max_size=10), st.lists(FLOATS, min_size=5, max_size=10))
def test_integers_and_floats_compare_exactly(spark, ints, floats):
    pairs = [(i, f) for i in ints for f in floats]
    df = spark.createDataFrame([(str(i), f) for i, f in pairs], "i string, f double").select(
        F.col("i").cast("decimal(38,0)").alias("i"), "f"
    )
    x, y = Value("int", F.col("i")), Value("float", F.col("f"))
    two = [x._compare(op, y).column() for op in OPS] + [y._compare(op, x).column() for op in OPS]
    rows = df.select(*[c.alias(f"c{k}") for k, c in enumerate(two)]).collect()
    for (i, f), r in zip(pairs, rows):
        assert list(r)[:6] == [truth(op, i, f) for op in OPS], (i, f)
        assert list(r)[6:] == [truth(op, f, i) for op in OPS], (i, f)
    f0, i0 = floats[0], ints[0]
    lits = [x._compare(op, f0).column() for op in OPS] + [y._compare(op, i0).column() for op in OPS]
    rows = df.select(*[c.alias(f"c{k}") for k, c in enumerate(lits)]).collect()
    for (i, f), r in zip(pairs, rows):
        assert list(r)[:6] == [truth(op, i, f0) for op in OPS], (i, f0)
        assert list(r)[6:] == [truth(op, f, i0) for op in OPS], (f, i0)


def test_filters_reach_the_scan(spark, frame, tmp_path):
    path = str(tmp_path / "a")
    frame.write.parquet(path)
    df = spark.read.parquet(path)
    test = (alloc.size >= 64) & (malloc.site == "row_cache") & ~alloc.freed
    plan = where(df, test).select("creator")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(size,64)" in plan and "EqualTo(site,row_cache)" in plan
    read = plan.split("ReadSchema:")[1]
    assert "extras" not in read and "addr" not in read


def test_facets(frame):
    tagged = frame.withColumn("tags", F.when(F.col("creator") == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    ids = lambda c: sorted(r.creator for r in tagged.filter(c).collect())
    assert ids(filters.facets(sites=[])) == [1]
    assert ids(filters.facets(sites=None)) == [0, 1, 2, 3]
    assert ids(filters.facets(threads=[2])) == [1, 2]
    assert ids(filters.facets(tags=["a"])) == [0]
    assert ids(filters.facets(tags=[filters.UNTAGGED])) == [1, 2, 3]
    assert ids(filters.facets(size_min=10, size_max=64)) == [0, 3]
    assert ids(filters.facets(address_ranges=[(5, 6), (9, 3)])) == [3]


def test_sets_compare_by_content(frame):
    tags = Value("set", F.array(F.lit("b"), F.lit("a"), F.lit("b")))
    assert hits(frame, tags == ["a", "b"]) == [0, 1, 2, 3] and hits(frame, tags != ["a", "b"]) == []
    assert hits(frame, tags != ["a"]) == [0, 1, 2, 3]
    with pytest.raises(TypeError):
        tags < ["a"]  # noqa: B015
