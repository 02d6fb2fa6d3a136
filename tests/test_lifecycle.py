"""The resolved tables against a sequential reading, on random dirty traces.

Limits are set so low that every way of cutting work is taken: blocks of a few
rows, hot ids split over blocks, crowded address bins sorted instead of paired.
"""

import random

import pytest
from simulate import simulate

from lifetrace.operators import lifecycle, live, warnings
from lifetrace.sources.derive import RECORD_TYPES, header_row

SCHEMA = ", ".join(f"{n} {t}" for n, t in RECORD_TYPES.items())


def random_trace(seed, n=400, ids=12, addresses=40, hot=0.0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        op = rng.choices(["M", "F", "R", "E", "X", None], [45, 30, 15, 6, 2, 2])[0]
        r = {"op": op}
        if op is None:
            out.append(r)
            continue
        if rng.random() < 0.9:
            r["t"] = len(out) * 3 - (50 if rng.random() < 0.1 else 0)
            r["t"] = max(r["t"], 0)
        if rng.random() < 0.02:
            r["dseq"] = rng.randrange(n)
        pick = lambda: 1 if rng.random() < hot else rng.randrange(ids)
        if op in ("M", "F", "R"):
            r["id"] = pick() if rng.random() < 0.95 else None
        if op == "F":
            r["kid"] = r["id"]
        if op == "R":
            r["kid"] = pick() if rng.random() < 0.95 else None
        if op in ("M", "R"):
            if rng.random() < 0.95:
                r["addr"] = 4096 if rng.random() < hot else rng.randrange(addresses) * 24
            r["size"] = rng.choice([0, 8, 16, 24, 100, 3000])
            if rng.random() < 0.3:
                r["usable"] = rng.choice([8, 32, 128])
        out.append(r)
    return out


def frame(spark, traces):
    rows = [
        tuple({**r, "trace_id": name, "ord": i}.get(c) for c in RECORD_TYPES)
        for name, records in traces.items()
        for i, r in enumerate(records)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def check(trace, traces):
    want = {name: simulate(records) for name, records in traces.items()}
    events = {}
    for r in trace.events.select("trace_id", "seq", "op", "t", "target").collect():
        events.setdefault(r.trace_id, {})[r.seq] = (r.op, r.t, r.target)
    allocs = {}
    for r in trace.allocations.select("trace_id", "creator", "addr", "end_span", "death", "realloc_from").collect():
        allocs.setdefault(r.trace_id, {})[r.creator] = (r.addr, r.end_span, r.death, r.realloc_from)
    overlaps = {}
    for r in trace.overlaps.collect():
        overlaps.setdefault(r.trace_id, set()).add(r.creator)
    found = {}
    for r in warnings.warnings(trace).orderBy("ord", "emit_rank").collect():
        found.setdefault(r.trace_id, []).append((r.seq, r.kind, int(r.detail)))
    for name, w in want.items():
        assert events.get(name, {}) == {e["seq"]: (e["op"], e["t"], e["target"]) for e in w["events"]}
        assert allocs.get(name, {}) == {
            c: (v["addr"], v["end"], v["death"], v["from"]) for c, v in w["creators"].items()
        }
        assert overlaps.get(name, set()) == w["overlaps"]
        assert found.get(name, []) == w["warnings"]
    return want


def header(spark, traces):
    out = None
    for name in traces:
        row = header_row(spark, name, "ns")
        out = row if out is None else out.unionByName(row)
    return out


def test_random_traces_default_limits(spark):
    traces = {f"s{i}": random_trace(i) for i in range(4)}
    check(lifecycle.build(frame(spark, traces), header(spark, traces)), traces)


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_random_traces_with_every_cut_taken(spark, hot):
    traces = {f"h{i}": random_trace(50 + i, n=300, hot=hot) for i in range(3)}
    built = lifecycle.build(
        frame(spark, traces), header(spark, traces), hot_rows=6, block_bits=3, pair_limit=0
    )
    want = check(built, traces)
    running = {}
    for r in live.running(built.events, block_bits=3).collect():
        running.setdefault(r.trace_id, {})[r.seq] = int(r.live_bytes)
    peaks = {r.trace_id: (int(r.peak_bytes), r.events_applied) for r in live.peak(built.events, 3).collect()}
    for name, w in want.items():
        assert running[name] == {e["seq"]: e["live"] for e in w["events"]}
        assert peaks[name] == w["peak"]


def test_same_address_reused_without_pairs(spark):
    """One address holds every allocation; half of them stay alive."""
    records = []
    for i in range(600):
        records.append({"op": "M", "id": i + 1, "addr": 4096, "size": 16 + i % 7, "t": i})
        if i % 2:
            records.append({"op": "F", "id": i + 1, "kid": i + 1, "t": i})
    traces = {"one": records}
    built = lifecycle.build(frame(spark, traces), header(spark, traces))
    check(built, traces)
    chain = live.reuse_chains(built.allocations, 600, hot_rows=8, block_bits=4).orderBy("creator").collect()
    assert [r.generation for r in chain] == list(range(1, 601))
    assert [r.previous for r in chain][1:] == [r.creator for r in chain][:-1]


def test_wide_allocation_over_many_small_ones(spark):
    records = [{"op": "M", "id": 1, "addr": 0, "size": 1 << 40, "t": 0}]
    records += [
        {"op": "M", "id": i + 2, "addr": i * 4096, "size": 64, "t": i} for i in range(300)
    ]
    traces = {"wide": records}
    built = lifecycle.build(frame(spark, traces), header(spark, traces))
    check(built, traces)
    assert built.overlaps.count() == 300
