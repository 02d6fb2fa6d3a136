import random

import numpy as np
import pytest
from llm_fixtures import documents, odd_texts, prose

from lifetrace.llm import jaccard


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    words = [w for w in low.split(" ") if w]
    if len(words) < 4:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + 4]) for i in range(len(words) - 3)}


def plain_components(texts, ids):
    """Least id reachable, by flooding over all pairs."""
    sets = [plain_set(t) for t in texts]
    todo, low = set(range(len(texts))), {}
    while todo:
        group, edge = set(), {todo.pop()}
        while edge:
            group |= edge
            near = {
                j for j in todo for i in edge
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
            }
            todo -= near
            edge = near
        for i in group:
            low[i] = min((ids[j] for j in group if ids[j] is not None), default=None)
    return sets, low


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i] = rng.choice(["", "extra " + words[i], "w" + str(rng.randrange(10**6))])
    return " ".join(words)


def corpus(rng):
    passage = prose(rng, 30)
    out = odd_texts(rng) + [None, "one", "a b c", "A B  c", "a b", "c b a"]
    for size in (9, 25, 60, 200):
        base = prose(rng, size).split()
        out += [edited(rng, base, rng.randrange(0, max(2, size // 20))) for _ in range(25)]
    out += [passage + " " + prose(rng, 5) for _ in range(20)]  # alike, most of them too little
    drift = prose(rng, 100).split()
    for _ in range(15):  # each close to the one before it, the first and last far apart
        drift = edited(rng, drift, 2).split()
        out.append(" ".join(drift))
    return out


@pytest.mark.parametrize(("pivots", "rounds", "crowded", "counters"), [(4, 3, 64, 22), (1, 1, 0, 12), (2, 0, 5, 12)])
def test_classes_match_all_pairs(spark, pivots, rounds, crowded, counters, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(jaccard, "COUNTER_BITS", counters)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 10)
    texts = corpus(random.Random(pivots))
    ids = list(range(len(texts)))
    ids[3] = ids[5] = None
    sets, low = plain_components(texts, [i if i is not None else None for i in ids])
    got = jaccard.joined(documents(spark, texts, ids=ids)).collect()
    want = sorted((str(ids[i]), len(sets[i]), str(ids[i] if not sets[i] else low[i])) for i in range(len(texts)))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want


def test_boundary_is_a_link(spark):
    base = [f"w{i}" for i in range(203)]  # 200 shingles
    inside = base[:173]  # 170 of them: 170 / 200 = 0.85
    outside = base[:172]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(documents(spark, [" ".join(x) for x in (base, inside)])).collect()}
    assert got == {0: 0, 1: 0}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(documents(spark, [" ".join(x) for x in (base, outside)])).collect()}
    assert got == {0: 0, 1: 1}


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = prose(random.Random(4), 5000).replace(" ", "\n", 700).encode()
    whole = jaccard.shingle_set(text)
    monkeypatch.setattr(jaccard, "_PIECE", 100)
    assert np.array_equal(whole, jaccard.shingle_set(text))
    assert len(whole) == len(plain_set(text.decode()))


def test_empty_table_and_repeated_rows(spark):
    assert jaccard.joined(documents(spark, ["x"]).limit(0)).count() == 0
    rows = jaccard.joined(documents(spark, ["a b c d e"] * 5 + ["", ""], ids=[9, 9, 9, 4, None, 8, 8])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows) == [
        ("4", 2, 4), ("8", 0, 8), ("8", 0, 8), ("9", 2, 4), ("9", 2, 4), ("9", 2, 4), ("None", 2, 4),
    ]


def test_hooking_joins_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 8)], "a bigint, b bigint")
    labels = None
    for _ in range(2):
        labels = jaccard._hooked(labels, links)
    assert {r.sid: r.label for r in labels.collect()} == {**{i: 0 for i in range(7)}, 8: 8, 9: 8}


def test_only_asked_sets_and_shared_tokens_are_moved(spark, monkeypatch):
    rng = random.Random(6)
    docs = documents(spark, [prose(rng, 50) for _ in range(12)])
    signed = jaccard._signed(docs)
    sets = signed.selectExpr("doc_id AS sid", "n", "s1", "s2", "text_hash")
    verify = jaccard._Verifier(docs, sets)
    assert verify(spark.createDataFrame([(i, i + 1) for i in range(11)], "a bigint, b bigint")).count() == 0
    few = spark.createDataFrame([(2,), (5,)], "sid bigint")
    assert sorted(r.sid for r in verify._known(few).collect()) == [2, 5]
    monkeypatch.setattr(jaccard, "MOVED", 1)
    assert verify._known(few).count() == 12

    groups = spark.createDataFrame([(0, 9, [5, -7, 1 << 62]), (1, 8, []), (2, 7, [-7, 6])], "gid bigint, n bigint, prefix array<bigint>")
    shared = spark.createDataFrame([(-7,), (1 << 62,)], "key bigint")
    assert sorted(map(tuple, jaccard._posted(groups, shared).select("gid", "n", "pos", "key").collect())) == [(0, 9, 1, -7), (0, 9, 2, 1 << 62), (2, 7, 0, -7)]
