"""Reading JSON Lines: tolerance, order, headers, malformed lines."""

from lifetrace.operators import aggregate, fields, warnings
from lifetrace.sources import jsonl


def write(tmp_path, text, name="t.jsonl"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def load(spark, tmp_path, text, **kw):
    return jsonl.load(spark, write(tmp_path, text), **kw)


BASIC = """# a queue that grows twice, beside a short-lived scratch buffer
{"op":"H","v":1,"unit":"ms","title":"queue","arena_base":"0x7f00","meta":{"host":"n7"}}
{"op":"M","id":41,"t":7,"size":24,"addr":"0x7f40","thr":3,"site":"queue","stack":["push","run","main"]}

{"op":"R","id":42,"old_id":41,"t":9,"size":48,"addr":"0x7fa0"}
{"op":"M","id":50,"t":9,"size":10,"addr":"0x7f40","site":"scratch"}
{"op":"E","title":"drained","t":12}
{"op":"R","id":43,"old_id":42,"t":15,"size":96,"addr":"0x8000"}
{"op":"F","id":50,"t":15}
"""


def test_basic(spark, tmp_path):
    t = load(spark, tmp_path, BASIC)
    rows = t.events.orderBy("seq").collect()
    assert [(r.op, r.t, r.target) for r in rows] == [
        ("M", 7, None), ("R", 9, 0), ("M", 9, None), ("E", 12, None), ("R", 15, 1), ("F", 15, 2)
    ]
    assert [(r.old_addr, r.old_size) for r in rows if r.op == "R"] == [(0x7F40, 24), (0x7FA0, 48)]
    assert rows[0].stack == "push\nrun\nmain"
    assert [(r.creator, r.death) for r in t.allocations.orderBy("creator").collect()] == [(0, 1), (1, 4), (2, 5), (4, None)]
    h = t.headers.first()
    assert (h.unit, h.title, h.version, int(h.arena_base), h.meta) == ("ms", "queue", 1, 0x7F00, '{"host":"n7"}')
    assert warnings.warnings(t).count() == 0


FAULTY = """{"op":"H","v":7,"unit":"us"}
{"op":"M","id":300,"t":50,"addr":"0x9a00","size":32,"site":"cache"}
{"op":"R","id":301,"old_id":299,"t":44,"addr":"0x9a10","size":48}
oops {
{"op":"M","id":300,"t":60,"addr":"0xb000","size":0,"seq":9}
{"op":"F","id":301,"t":61}
{"op":"R","id":302,"old_id":301,"t":62,"addr":"0xd000","size":5}
"""


def test_warning_kinds(spark, tmp_path):
    """A cache whose resize names nothing, whose id comes twice, and a resize after the end."""
    t = load(spark, tmp_path, FAULTY)
    found = {}
    for r in warnings.warnings(t).collect():
        found.setdefault(r.seq, set()).add((r.kind, int(r.detail)))
    assert found == {
        0: {("unknown_version", 7)},
        1: {("decreasing_time", 44), ("unknown_id", 299), ("overlap", 0x9A10), ("malformed_line", 0)},
        2: {("sequence_mismatch", 9), ("invalid_size", 300), ("duplicate_id", 300)},
        4: {("double_free", 301)},
    }
    ordered = [r.kind for r in warnings.warnings(t).orderBy("ord", "emit_rank").collect()]
    assert ordered[0] == "unknown_version" and ordered[-1] == "double_free"
    assert ordered.index("malformed_line") == 4
    assert [(r.creator, r.death) for r in t.allocations.orderBy("creator").collect()] == [(0, None), (1, 3), (2, None), (4, None)]


TOLERATED = [
    ('{"op":"M","id":1.9,"addr":"0x10","size":2.5}', (1, 16, 2)),
    ('{"op":"M","id":-4,"addr":"16","size":3}', (0, 16, 3)),
    ('{"op":"M","id":99999999999999999999999,"addr":"ff","size":3}', (18446744073709551615, 255, 3)),
    ('{"op":"M","id":18446744073709551615,"addr":"0xFFFFFFFFFFFFFFFF","size":3}', (18446744073709551615, 18446744073709551615, 3)),
    ('{"op":"M","id":3,"addr":"' + "7" * 61 + '","size":3}', (3, int("7" * 61) % 2**64, 3)),
    ('{"op":"M","id":1e19,"addr":"0x10","size":1}', (10000000000000000000, 16, 1)),
    ('{"op":"M","id":1,"addr":"0x10","size":3} trailing', (1, 16, 3)),
    ('{"op":"M","id":1,"id":2,"addr":"0x10","size":3}', (2, 16, 3)),
    ('{"size":3,"addr":"0x10","id":7,"op":"M","later":[1,{"a":2}]}', (7, 16, 3)),
    ('{"op":"M","id":1,"addr":"0x10","size":3,"stack":7,"meta":null}', (1, 16, 3)),
]
MALFORMED = [
    '{"op":"M","id":"7","addr":"0x10","size":3}',
    '{"op":"M","id":null,"addr":"0x10","size":3}',
    '{"op":"M","id":1,"addr":16,"size":3}',
    '{"op":"M","id":1,"addr":null,"size":3}',
    '{"op":"M","id":1,"addr":"0x10","size":3,"site":null}',
    '{"op":"","id":1,"addr":"0x10"}',
    '{"op":"MM","id":1,"addr":"0x10"}',
    '{"id":1,"addr":"0x10"}',
    "{}",
    "[1]",
    '{"op":"M"',
]


def test_tolerated_and_malformed(spark, tmp_path):
    """Every case is a trace of its own; all are read in one go."""
    for i, (text, _) in enumerate(TOLERATED):
        write(tmp_path, text, f"t{i}.jsonl")
    for i, text in enumerate(MALFORMED):
        write(tmp_path, text + '\n{"op":"E","title":"end"}', f"m{i}.jsonl")
    t = jsonl.load(spark, str(tmp_path), r"/([^/]+)\.jsonl$")
    got = {r.trace_id: (int(r.id), int(r.addr), int(r["size"])) for r in t.allocations.collect()}
    assert got == {f"t{i}": want for i, (_, want) in enumerate(TOLERATED)}
    kinds = {}
    for r in warnings.warnings(t).collect():
        kinds.setdefault(r.trace_id, []).append(r.kind)
    assert kinds == {f"m{i}": ["malformed_line"] for i in range(len(MALFORMED))}


def test_bad_address_drops_the_creator(spark, tmp_path):
    t = load(spark, tmp_path, '{"op":"M","id":5,"addr":"0x12345678901234567","size":3,"site":"lost"}\n{"op":"M","id":6,"addr":"zz","size":1}')
    assert t.events.count() == 0
    assert [(r.seq, r.kind, int(r.detail)) for r in warnings.warnings(t).orderBy("ord").collect()] == [
        (0, "malformed_line", 5), (0, "malformed_line", 6)
    ]
    assert [(r.key, r.allocations) for r in aggregate.site_catalog(t).collect()] == [("lost", 0)]


def test_unknown_op_is_skipped_but_moves_the_clock(spark, tmp_path):
    t = load(spark, tmp_path, '{"op":"Z","t":50}\n{"op":"M","id":8,"addr":"0xc8","size":6,"t":20}')
    assert [(r.seq, int(r.t)) for r in t.events.collect()] == [(0, 50)]
    o = aggregate.overview(t).first()
    assert (int(o.t_min), int(o.t_max)) == (50, 50)


def test_custom_fields_and_catalog(spark, tmp_path):
    t = load(spark, tmp_path, """{"op":"M","id":71,"addr":"0x5a0","size":9,"pool":"arena","n":1,"f":0.5,"o":{"a":[1]},"x-y":"q\\"t"}
{"op":"M","id":72,"addr":"0x6c0","size":9,"pool":null,"n":2,"f":3,"b":true,"n":9}
{"op":"F","id":71,"reason":"done","mix":1}
{"op":"E","mix":"one"}
""")
    cat = {r["name"]: (r["type"], r["optional"], r["events"]) for r in fields.catalog(t).collect()}
    assert cat == {
        "pool": ("string", True, 2), "n": ("int", False, 2), "f": ("float", False, 2),
        "o": (None, False, 1), "x-y": ("string", False, 1), "b": ("bool", False, 1),
        "reason": ("string", False, 1), "mix": (None, False, 2),
    }
    values = {(r.seq, r["name"]): r.raw for r in fields.field_values(t.events).collect()}
    assert values[(0, "x-y")] == '"q\\"t"'
    assert values[(0, "o")] == '{"a":[1]}'
    assert values[(1, "n")] == "2"  # the first of a repeated custom key
    assert values[(1, "pool")] == "null"


def test_numbers_above_63_bits_stay_exact(spark, tmp_path):
    t = load(spark, tmp_path, """{"op":"M","id":18446744073709551615,"addr":"0xfffffffffffffff0","size":64,"t":18446744073709551610}
{"op":"M","id":18446744073709551614,"addr":"0xfffffffffffffff8","size":1,"t":1}
{"op":"F","id":18446744073709551615}
""")
    rows = t.allocations.orderBy("creator").collect()
    assert int(rows[0].end_span) == 18446744073709551615
    assert int(rows[0].death) == 2 and rows[1].death is None
    assert [(r.seq, r.kind) for r in warnings.warnings(t).orderBy("ord", "emit_rank").collect()] == [
        (1, "decreasing_time"), (1, "overlap")
    ]


def test_order_survives_splits(spark, tmp_path):
    lines = "".join(f'{{"op":"M","id":{i + 1},"addr":"0x{i * 16:x}","size":8,"t":{i}}}\n' for i in range(20000))
    path = write(tmp_path, lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        t = jsonl.load(spark, path)
        assert t.events.filter("seq = t").count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_several_traces_and_header_override(spark, tmp_path):
    write(tmp_path, BASIC, "a.jsonl")
    write(tmp_path, '{"op":"H","unit":"ms","title":"x"}\n{"op":"H","unit":"s"}\n{"op":"E"}', "b.jsonl")
    write(tmp_path, '{"op":"E"}', "c.jsonl")
    t = jsonl.load(spark, str(tmp_path), r"/([^/]+)\.jsonl$")
    h = {r.trace_id: (r.has_header, r.unit, r.title) for r in t.headers.collect()}
    assert h == {"a": (True, "ms", "queue"), "b": (True, "s", "x"), "c": (False, "ns", "")}
    n = {r.trace_id: r["count"] for r in t.events.groupBy("trace_id").count().collect()}
    assert n == {"a": 6, "b": 1, "c": 1}


def test_content_ids_and_round_trip(spark, tmp_path):
    import hashlib

    path = write(tmp_path, BASIC, "a.jsonl")
    ids = [r.trace_id for r in jsonl.content_ids(spark, path).collect()]
    assert ids == ["sha256:" + hashlib.sha256(BASIC.encode()).hexdigest()]
    first = jsonl.load(spark, path, r"/([^/]+)\.jsonl$")
    again = first.save(str(tmp_path / "saved"))
    assert sorted(map(tuple, again.allocations.collect())) == sorted(map(tuple, first.allocations.collect()))
    plan = again.events.filter("seq >= 3").select("op")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq,3)" in plan
