"""Sinks called batch by batch, against a sequential reading."""

import random

import pytest
from pyspark.sql import functions as F

from lifetrace.operators import changes
from lifetrace.streaming import feed, lifecycle, runs, totals

EVENTS = "trace_id string, seq bigint, op string, t {n}, id {n}, kid {n}, addr {n}, size {n}, registered boolean"


def events(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        op = rng.choice("MMFFRE")
        some = lambda: rng.randrange(12)
        rows.append((
            "t", seq, op, seq * 10, some() if op in "MR" else None,
            (some() if rng.random() < 0.9 else None) if op in "FR" else None, seq * 64, 8, op in "MR" and rng.random() < 0.95,
        ))
    return rows


def replayed(rows):
    out, seen = [], {}
    for _, seq, op, t, id_, kid, addr, size, registered in rows:
        if op in "FR":
            if kid is None or kid not in seen:
                out.append((seq, "kill", "unknown", None, None))
            else:
                creator, dead = seen[kid]
                out.append((seq, "kill", "double", None, None) if dead else (seq, "kill", "ok", creator, creator * 64))
                seen[kid] = (creator, True)
        if op in "MR" and registered:
            live = id_ in seen and not seen[id_][1]
            out.append((seq, "create", "reused" if live else "new", None, None))
            seen[id_] = (seq, False)
    return sorted(out, key=str)


@pytest.mark.parametrize("number, lift", [("bigint", 0), ("decimal(20,0)", 1 << 63)])
def test_resolution_in_batches(spark, tmp_path, monkeypatch, number, lift):
    from decimal import Decimal

    monkeypatch.setattr(runs, "COMPACT", 2)
    rows = events(3)
    up = (lambda v: None if v is None else Decimal(v + lift)) if lift else (lambda v: v)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sink = lifecycle.resolve_sink(out, state)
    cuts = [0, 40, 41, 100, 160, 200, len(rows)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = [(*r[:3], *map(up, r[3:8]), r[8]) for r in rows[a:b]]
        sink(spark.createDataFrame(part, EVENTS.format(n=number)), n)
    got = runs.read_batches(spark, out).collect()
    down = lambda v: None if v is None else int(v) - lift
    assert sorted(((r.seq, r.what, r.status, r.target, down(r.target_addr)) for r in got), key=str) == replayed(rows)
    assert dict(runs.read_batches(spark, out).dtypes)["target_addr"] == number


def test_a_batch_reads_the_buckets_of_its_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT", 4)
    monkeypatch.setattr(runs, "BUCKETS", 8)
    path, key = str(tmp_path / "state"), ["k"]
    schema = "k bigint, at bigint"
    latest = lambda df: df.groupBy("k").agg({"at": "max"}).withColumnRenamed("max(at)", "at")
    want = {}
    for n in range(11):
        rows = [(k, n) for k in range(200) if k % (n + 2) == 0]
        want |= dict(rows)
        runs.write_changes(spark.createDataFrame(rows, schema), path, n, schema, latest, key)
    state = lambda touched=None: runs.merged_state(spark, path, 11, schema, latest, key, touched)
    assert dict(map(tuple, state().collect())) == want
    one = spark.createDataFrame([(6,)], "k bigint")
    bucket = one.select(runs.bucket_of(key)).first()[0]
    few = state(one)
    assert dict(map(tuple, few.collect()))[6] == want[6]
    names = lambda df: df.select(F.input_file_name().alias("f")).distinct()
    files = lambda touched: [r.f for r in runs.merged_state(spark, path, 11, schema, names, key, touched).collect()]
    read = files(one)
    assert {f.split("_bucket=")[1].split("/")[0] for f in read} == {str(bucket)} and 1 <= len(read) <= 4
    assert len(files(None)) > 8
    plan = state([bucket])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert state([]).count() == 0


def test_feed_state_is_the_same_however_it_is_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT", 2)
    rng = random.Random(5)
    fields = [c.split(" ")[0] for c in changes.SCHEMA.split(", ")]
    rows = []
    for i in range(60):
        kind = rng.choice(["setAllocationTag", "replaceAllocationTags", "replaceTagMembers", "deleteTag"])
        tag, creator = f"t{rng.randrange(4)}", rng.randrange(5)
        full = {"trace_id": "t", "revision": i + 1, "type": kind, "id": tag, "creator": creator, "present": rng.random() < 0.7,
                "tag_ids": [tag], "creators": [creator, 4]}
        rows.append(tuple(full.get(f) for f in fields))
    states = []
    for cuts in ([0, 60], [0, 7, 20, 21, 40, 60]):
        path = str(tmp_path / str(len(cuts)))
        sink = feed.feed_sink(path)
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            sink(spark.createDataFrame(rows[a:b], changes.SCHEMA), n)
        states.append({tuple(r) for r in feed.members(feed.state_after(spark, path, len(cuts) - 1)).collect()})
    assert states[0] == states[1] and states[0]


def test_clamp_keeps_wide_times(spark, tmp_path):
    from decimal import Decimal

    out = str(tmp_path / "out")
    sink = totals.clamp_sink(out, str(tmp_path / "state"))
    high = Decimal((1 << 64) - 5)
    for n, ts in enumerate([[(0, high)], [(1, Decimal(3)), (2, None)]]):
        sink(spark.createDataFrame([("t", o, t) for o, t in ts], "trace_id string, ord bigint, t decimal(20,0)"), n)
    assert [r.t for r in runs.read_batches(spark, out).orderBy("ord").collect()] == [high] * 3
