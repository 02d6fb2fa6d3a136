"""The change log: checks, folding, deltas."""

from pyspark.sql import functions as F

from lifetrace.operators import changes
from lifetrace.streaming import feed

FIELDS = [c.split(" ")[0] for c in changes.SCHEMA.split(", ")]


def log(spark, rows):
    data = []
    for i, r in enumerate(rows):
        full = {"trace_id": "t", "revision": i + 1, **r}
        data.append(tuple(full.get(f) for f in FIELDS))
    return spark.createDataFrame(data, changes.SCHEMA)


def context(spark, creators=(2,), events=10):
    a = spark.createDataFrame([("t", c) for c in creators], "trace_id string, creator bigint")
    e = spark.createDataFrame([("t", s) for s in range(events)], "trace_id string, seq bigint")
    return a, e


def test_every_kind_of_change(spark):
    """Every object is put, put again and, one of each, deleted."""
    put = lambda kind, **kw: {"type": kind, **kw}
    rows = [
        put("putTag", id="slow-path", name="Slow path", color="#0F0F0F"), put("putTag", id="\u00a0io\u3000", name="\u2003I/O\u2003", color="#00ff7F"),
        put("putTag", id="slow-path", name="slower", color="#101010"), put("putTag", id="gone", name="x", color="#222222"),
        put("deleteTag", id="gone"),
        put("setAllocationName", creator=6, name="first"), put("setAllocationName", creator=6, name="\tring buffer"),
        put("setAllocationName", creator=4, name="short"), put("setAllocationName", creator=4, name=None),
        put("setAllocationColor", creator=4, color="#9A8B7C"),
        put("setAllocationTag", creator=6, id="io", present=True), put("setAllocationTag", creator=4, id="io", present=False),
        put("replaceAllocationTags", creator=4, tag_ids=["slow-path", " io"]),
        put("putBookmark", id="warm", name="warm-up", seq=3, t=0.25), put("putBookmark", id="warm", name="warmed up", seq=5, t=1.5),
        put("putBookmark", id="later", name="x", seq=1, t=0.0), put("deleteBookmark", id="later"),
        put("putAddressMark", id="heap", name="heap", addr="0x00F0"), put("putAddressMark", id="heap", name="heap end", addr="0XFF00"),
        put("putAddressMark", id="old", name="x", addr="0x1"), put("deleteAddressMark", id="old"),
        put("putSavedFilter", id="kept", name="kept", source="not alloc.freed"), put("putSavedFilter", id="kept", name="still kept", source="alloc.freed == False"),
        put("putSavedFilter", id="tmp", name="x", source=""), put("deleteSavedFilter", id="tmp"),
    ]
    good, bad = changes.validated(log(spark, rows), *context(spark, (4, 6), 8))
    assert bad.count() == 0
    s = changes.fold(good)
    rows_of = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert rows_of(s.tags) == [("io", "I/O", "#00ff7f"), ("slow-path", "slower", "#101010")]
    assert rows_of(s.members) == [("io", 4), ("io", 6), ("slow-path", 4)]
    assert {r.creator: (r.name, r.color) for r in s.notes.collect()} == {4: (None, "#9a8b7c"), 6: ("ring buffer", None)}
    assert rows_of(s.bookmarks) == [("warm", "warmed up", 5, 1.5)]
    assert rows_of(s.marks) == [("heap", "heap end", "0xff00")]
    assert rows_of(s.filters) == [("kept", "still kept", "alloc.freed == False")]
    assert {r.what: r.n for r in changes.counts(s).collect()} == {
        "named": 1, "tags": 2, "bookmarks": 1, "marks": 1, "filters": 1
    }


def test_incomplete_changes_are_refused(spark):
    rows = [
        {"type": "putBookmark", "id": "b", "name": "x", "t": 1.0},
        {"type": "putBookmark", "id": "b", "name": "x", "seq": 1},
        {"type": "nonsense", "id": "b"},
        {"type": None, "id": "b"},
        {"type": "putSavedFilter", "id": "f", "name": "x"},
        {"type": "putTag", "id": "a", "name": "x", "color": "#112233"},
        {"type": "setAllocationTag", "creator": 2, "id": "a"},
        {"type": "setAllocationName", "name": "x"},
        {"type": "replaceAllocationTags", "creator": 2},
        {"type": "replaceTagMembers", "id": "a", "creators": [2, None]},
        {"type": "putAddressMark", "id": "m", "name": "x"},
        {"type": "deleteTag"},
    ]
    good, bad = changes.validated(log(spark, rows), *context(spark))
    assert [r.revision for r in good.collect()] == [6]
    reasons = {r.revision: r.reason for r in bad.collect()}
    assert reasons.pop(3) == reasons.pop(4) == changes.NO_TYPE
    assert set(reasons.values()) == {changes.NO_FIELD} and len(reasons) == 9


def test_rejections(spark):
    rows = [
        {"type": "setAllocationName", "creator": 9, "name": "x"},
        {"type": "setAllocationTag", "creator": 2, "id": "none", "present": True},
        {"type": "putTag", "id": "no good", "name": "x", "color": "#112233"},
        {"type": "putTag", "id": "a" * 65, "name": "x", "color": "#112233"},
        {"type": "putTag", "id": "a", "name": "   ", "color": "#112233"},
        {"type": "putTag", "id": "a", "name": "x", "color": "red"},
        {"type": "putBookmark", "id": "b", "name": "x", "seq": 11, "t": 0.0},
        {"type": "putBookmark", "id": "b", "name": "x", "seq": 1, "t": float("inf")},
        {"type": "putAddressMark", "id": "m", "name": "x", "addr": "12"},
        {"type": "putSavedFilter", "id": "f", "name": "x", "source": "y" * (16 * 1024 + 1)},
        {"type": "putTag", "id": "a", "name": "x", "color": "#112233"},
        {"type": "replaceTagMembers", "id": "a", "creators": [2, 5]},
        {"type": "deleteTag", "id": "a"},
        {"type": "setAllocationTag", "creator": 2, "id": "a", "present": True},
    ]
    good, bad = changes.validated(log(spark, rows), *context(spark))
    assert {r.revision: r.reason for r in bad.collect()} == {
        1: "allocation not found", 2: "unknown tag", 3: "invalid persistent id",
        4: "invalid persistent id", 5: "invalid name", 6: "invalid color", 7: "invalid bookmark",
        8: "invalid time", 9: "invalid address", 10: "filter is too large",
        12: "allocation not found", 14: "unknown tag",
    }
    assert sorted(r.revision for r in good.collect()) == [11, 13]


def test_tag_limit_is_exact(spark):
    rows = [{"type": "putTag", "id": f"t{i}", "name": "x", "color": "#112233"} for i in range(258)]
    rows += [
        {"type": "deleteTag", "id": "t257"},  # was refused: frees nothing
        {"type": "putTag", "id": "t300", "name": "x", "color": "#112233"},
        {"type": "deleteTag", "id": "t0"},
        {"type": "putTag", "id": "t301", "name": "x", "color": "#112233"},
        {"type": "putTag", "id": "t1", "name": "again", "color": "#112233"},
        {"type": "setAllocationTag", "creator": 2, "id": "t256", "present": True},
    ]
    good, bad = changes.validated(log(spark, rows), *context(spark))
    assert {r.revision: r.reason for r in bad.collect()} == {
        256: "too many tags", 257: "too many tags", 258: "too many tags", 260: "too many tags",
        264: "unknown tag",
    }
    assert changes.fold(good).tags.count() == 255


def test_membership_folds_like_a_replay(spark):
    import random

    rng = random.Random(5)
    rows, tags, held = [], set(), {}
    for i in range(250):
        kind = rng.choice(["putTag", "setAllocationTag", "replaceAllocationTags", "replaceTagMembers", "deleteTag", "setAllocationTag"])
        tag, creator = f"t{rng.randrange(4)}", rng.randrange(5)
        r = {"type": kind}
        if kind == "putTag":
            r.update(id=tag, name="n", color="#000000")
            tags.add(tag)
        elif kind == "deleteTag":
            r.update(id=tag)
            tags.discard(tag)
            held = {k: v - {tag} for k, v in held.items()}
        elif tag not in tags:
            continue
        elif kind == "setAllocationTag":
            on = rng.random() < 0.6
            r.update(id=tag, creator=creator, present=on)
            held.setdefault(creator, set())
            held[creator] = held[creator] | {tag} if on else held[creator] - {tag}
        elif kind == "replaceAllocationTags":
            r.update(creator=creator, tag_ids=[tag])
            held[creator] = {tag}
        else:
            some = rng.sample(range(5), 2)
            r.update(id=tag, creators=some)
            held = {k: v - {tag} for k, v in held.items()}
            for c in some:
                held.setdefault(c, set()).add(tag)
        rows.append(r)
    want = {(t, c) for c, v in held.items() for t in v}
    good, bad = changes.validated(log(spark, rows), *context(spark, range(5)))
    assert bad.count() == 0
    assert {(r.tag, r.creator) for r in changes.fold(good).members.collect()} == want
    merged = feed._facts(good).groupBy("trace_id", "what", "tag", "creator").agg(
        F.max("at").alias("at"), F.max_by("present", "at").alias("present")
    )
    assert {(r.tag, r.creator) for r in feed.members(merged).collect()} == want


def test_since(spark):
    rows = [{"type": "deleteTag", "id": f"t{i}"} for i in range(5)]
    rows[1] = {"type": None}
    full = log(spark, rows)
    one = lambda df: [(r.reset, r.revision) for r in df.orderBy("revision").collect()]
    assert one(changes.since(full, 2)) == [(False, 3), (False, 4), (False, 5)]
    paged = changes.since(full, 2, page=2).orderBy("revision").collect()
    assert [(r.revision, r.next) for r in paged] == [(3, None), (4, 4)]
    assert [(r.revision, r.next) for r in changes.since(full, 4, page=2).collect()] == [(5, None)]
    assert one(changes.since(full, 5)) == [(False, None)]
    assert one(changes.since(full, 6)) == [(True, None)]
    assert one(changes.since(full, 0)) == [(True, None)]  # a change without payload
    assert one(changes.since(full.filter("revision > 3"), 2)) == [(True, None)]


def test_a_log_is_read_and_checked_once(spark, tmp_path):
    """What comes of a log reads the checked table, not the log again."""
    path = str(tmp_path / "log")
    rows = [{"type": "putTag", "id": "a", "name": "A", "color": "#000000"}, {"type": "setAllocationTag", "creator": 9, "id": "a", "present": True}]
    log(spark, rows).write.parquet(path)
    good, bad = changes.validated(spark.read.parquet(path), *context(spark))
    state = changes.fold(good)
    for result in (good, bad, state.tags, state.members, state.notes):
        assert not [f for f in result.inputFiles() if path in f]
    assert [r.reason for r in bad.collect()] == ["allocation not found"]
