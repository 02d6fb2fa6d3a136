"""The classifier, chat turns and URL lists."""

import random

from llm_fixtures import documents, odd_texts, prose
from pyspark.sql import functions as F

from lifetrace.llm import chat, classifier, urls
from lifetrace.llm.common import read

SF = "/root/testdata/sf0.01"


def test_classifier_on_the_held_out_fold(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = classifier.scores(docs, labels)
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    held = rows.filter("held_out").join(labels, "doc_id").collect()
    good = [r.score for r in held if r.quality]
    bad = [r.score for r in held if not r.quality]
    assert sum(a > b for a in good for b in bad) > 0.97 * len(good) * len(bad)
    assert sum(r.predicted == r.quality for r in held) > 0.95 * len(held)


def test_classifier_learns_nothing_from_the_held_out_fold(spark):
    rng = random.Random(28)
    texts = [prose(rng, 40) for _ in range(60)]
    docs = documents(spark, texts)
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    turned = known.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in classifier.scores(docs, x).collect()} for x in (known, turned))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_classifier_on_odd_tables(spark):
    texts = odd_texts(random.Random(29))
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = classifier.scores(documents(spark, texts), none).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == len(texts)
    dirty = spark.createDataFrame([(0, 1), (0, None), (None, 1), (1, 0), (1, 0), (3, 1), (77, 0)], "doc_id bigint, quality int")
    rows = classifier.scores(documents(spark, texts, [None, *range(len(texts) - 1)]), dirty).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert classifier.scores(documents(spark, []), dirty).count() == 0


def test_chat_roles_of_held_out_conversations(spark, monkeypatch):
    talks = read(spark, SF, "conversations")
    rows = chat.recovered(talks)
    both = rows.alias("r").join(talks.alias("t"), ["conv_id", "turn"]).filter(chat.held_out(F.col("conv_id")))
    right, n = both.agg(F.sum((F.col("r.role") == F.col("t.role")).cast("int")), F.count(F.lit(1))).first()
    assert n > 50 and right > 0.97 * n
    whole = sorted(rows.collect())
    monkeypatch.setattr(chat, "CHUNK", 2)
    assert sorted(chat.recovered(talks).collect()) == whole


def plain_path(model, scores):
    """Viterbi over one sequence."""
    state, back = model.start + scores[0], []
    for row in scores[1:]:
        ways = state[:, None] + model.moves
        back.append(ways.argmax(axis=0))
        state = ways.max(axis=0) + row
    path = [int(state.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def test_chat_path_is_the_best_one(spark):
    import numpy as np

    rng = np.random.default_rng(30)
    s = chat.STATES
    model = chat.Chat(rng.random(s) * 9, rng.random((s, s)) * 9, rng.random((s, chat.N_FEATURES)) * 9)
    lengths = np.array([5, 1, 9, 3])
    scores = np.log(rng.random((int(lengths.sum()), s)))
    free = np.full(len(lengths), -1)
    got, at = chat.paths(model, scores, lengths, free, free), 0
    for n in lengths:
        assert got[at : at + n].tolist() == plain_path(model, scores[at : at + n])
        at += n


def test_chat_on_odd_rows(spark):
    rows = [
        (1, 0, "user", "User: hello?"), (1, 1, "assistant", "Bot: hi\nAnd more"), (1, 1, "assistant", None), (None, None, None, "x"),
        (None, 2, "tool", ""), (2, 5, "user", "a\n\nAssistant: b"), (2, -3, "system", "[System] be kind"),
    ]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "text AS rendered", "turn AS chunk")
    model = chat.fitted(talks)
    out = chat.turns_of(talks, model).collect()
    assert len(out) == len(rows)
    hello = next(r for r in out if r.conv_id == 1 and r.turn == 0)
    assert hello.rendered.endswith("hello?\n") and "User:" not in hello.rendered
    none = talks.limit(0)
    assert chat.turns_of(none, chat.fitted(none)).count() == 0


def plain_decision(row, entries):
    url, day = row
    import re

    host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = host[1].lower() if host else ""
    domain = ".".join(host.split(".")[-2:])
    for kind, key in (("url", (url or "").split("#")[0]), ("host", host), ("domain", domain)):
        active = [(d, a == "block") for k, x, d, a in entries if k == kind and x and x == key and d is not None and day is not None and d <= day]
        if active:
            since = max(d for d, _ in active)
            return any(b for d, b in active if d == since), kind, since
    return False, None, None


def test_url_decisions_as_of_the_fetch(spark):
    rng = random.Random(31)
    hosts = ["a.x.org", "b.x.org", "x.org", "y.net", "", "localhost"]
    pages = [(rng.choice([None, *range(50)]), rng.choice([None, f"http://{rng.choice(hosts)}/{rng.randint(0, 2)}#f", "no url", "https://U:p@B.x.org:80/q"]), rng.choice([None, *range(-20, 60)])) for _ in range(400)]
    keys = {"url": ["http://a.x.org/1", "no url", ""], "host": ["a.x.org", "b.x.org", "", None], "domain": ["x.org", "y.net", "localhost"]}
    entries = []
    for _ in range(60):
        kind = rng.choice(list(keys))
        entries.append((kind, rng.choice(keys[kind]), rng.choice([None, *range(-20, 60)]), rng.choice(["block", "allow"])))
    captures = spark.createDataFrame(pages, "page_id bigint, url string, day bigint")
    listed = spark.createDataFrame(entries, "kind string, key string, day bigint, action string")
    got = [(r.page_id, r.url, r.day, r.blocked, r.by, r.since) for r in urls.decide(captures, listed).collect()]
    want = [(p, u, d, *plain_decision((u, d), entries)) for p, u, d in pages]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    plan = urls.decide(captures, listed)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert urls.decide(captures.limit(0), listed).count() == 0
    assert urls.decide(captures, listed.limit(0)).filter("blocked").count() == 0


def test_every_word_has_a_vector_of_its_own(spark):
    import numpy as np

    rng = random.Random(31)
    texts = odd_texts(rng) + [" ".join(f"x{rng.randint(0, 30_000)}" for _ in range(2000)) for _ in range(20)]
    docs = documents(spark, texts).repartition(3)
    words = {w for t in texts for w in (t or "").encode().split()}
    table = classifier.context_vectors(docs).filter(F.col("key") >= classifier.OUTLINES).collect()
    assert len(table) == len({r.key for r in table}) == len(words) > 1 << 14
    assert sum(r.n for r in table) == sum(len((t or "").encode().split()) for t in texts)
    # looked up or joined, the features are the same
    a, b = ({r.doc_id: np.frombuffer(r.x, np.float32) for r in classifier.features(docs, kept).collect()} for kept in (None, 5))
    assert len(a) == len(texts) and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)


def test_domains_of_any_depth_and_case(spark):
    hosts = ["m.casino-win.example.com", "casino-win.example.com", "other.example.com", "a.b.co.uk", "c.co.uk", "X.ORG", "y.x.org", "z.shop", "a." * 300 + "x.org"]
    captures = spark.createDataFrame([(i, f"http://{h}/", 5) for i, h in enumerate(hosts)] * 2 + [(99, None, 5), (98, "http://x.org/", None)], "page_id bigint, url string, day bigint")
    entries = [
        ("domain", "Casino-Win.example.com", 1, "block"), ("domain", "example.com", 3, "allow"), ("domain", "b.co.uk", 6, "block"),
        ("domain", "co.uk", 2, "block"), ("host", "X.Org", 4, "block"), ("domain", "X.ORG", 1, "allow"), ("domain", "shop", 0, "block"),
    ]
    listed = spark.createDataFrame(entries, "kind string, key string, day bigint, action string")
    got = sorted((r.page_id, r.blocked, r.by, r.since) for r in urls.decide(captures, listed).collect())
    one = [
        (0, True, "domain", 1), (1, True, "domain", 1), (2, False, "domain", 3), (3, True, "domain", 2), (4, True, "domain", 2),
        (5, True, "host", 4), (6, False, "domain", 1), (7, True, "domain", 0), (8, False, "domain", 1),
    ]
    assert got == sorted(one * 2 + [(98, False, None, None), (99, False, None, None)], key=lambda r: r[0])


def test_chunks_hold_so_many_rows_whatever_the_turns(spark, monkeypatch):
    talks = read(spark, SF, "conversations")
    model = chat.fitted(chat.transcripts_of(talks))
    rng = random.Random(33)
    rows = [(c, rng.choice([None, None, 7, 7, -3, 5000]), f"{rng.choice(['User: ', 'Bot: ', ''])}line {i % 40}") for c in (None, 1, 2) for i in range(60)]
    rows += [(3, i, "User: short") for i in range(2)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").repartition(3)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    whole = sorted(map(tuple, chat.turns_of(turns, model).collect()), key=key)
    assert len(whole) == len(rows)
    monkeypatch.setattr(chat, "CHUNK", 8)
    sizes = {(r.conv_id, r.chunk): r["count"] for r in chat._chunked(turns)[0].groupBy("conv_id", "chunk").count().collect()}
    assert max(sizes.values()) <= 8 and len(sizes) == 3 * 8 + 1
    assert sorted(map(tuple, chat.turns_of(turns, model).collect()), key=key) == whole
