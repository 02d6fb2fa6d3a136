import hashlib
import random
import re

import pytest
from llm_fixtures import documents

from lifetrace.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    w, hit, named = words(text), set(), set()
    for name, item in items:
        terms = words(item)
        for i in range(max(1, len(terms) - 12) if terms else 0):
            window = terms[i : i + 13]
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    named.add(str(name))
    names = ",".join(sorted(named))
    return len(w), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def tables(rng):
    some = [f"t{i}" for i in range(6)]
    line = lambda n: " ".join(rng.choice(some) for _ in range(n))
    items = [(i, line(rng.randint(1, 30))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "Ünï Tést phrase"), (103, items[3][1]), (3, line(5)), (104, " ".join(some * 4))]
    texts = [None, "", "!!! ...", "only other words"]
    for _ in range(30):
        parts = [line(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1] or "", line(rng.randint(0, 30))]
        texts.append(rng.choice([" ", ", ", "-"]).join(parts))
    texts += ["so ÜNÏ tést PHRASE it is", "so Ünï Tést Phrase it is", " ".join(some * 40), texts[6], texts[6]]
    return texts, items


@pytest.mark.parametrize("segment, round_bytes", [(1 << 20, 32 << 20), (50, 32 << 20), (50, 60)])
def test_phrases_match_a_plain_search(spark, monkeypatch, segment, round_bytes):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", segment)
    monkeypatch.setattr(decontam, "ROUND_BYTES", round_bytes)
    texts, items = tables(random.Random(8))
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "text AS words", "item_id AS key")
    found = decontam.report(decontam.matches(documents(spark, texts), bench)).collect()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    assert got == sorted((i, *plain(t, items)) for i, t in enumerate(texts))


def test_clean_drops_the_contaminated_rows_only(spark):
    texts, items = tables(random.Random(9))
    ids = [i if i % 5 else None for i in range(len(texts))]
    docs = documents(spark, texts, ids)
    kept = decontam.clean(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == docs.columns
    want = sorted((i or -1, t or "") for i, t in zip(ids, texts) if not plain(t, items)[4])
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == want


def test_proximity_finds_scattered_terms(spark):
    texts = ["x gamma y beta z alpha", "alpha " + "x " * 60 + "beta gamma", "alpha beta"]
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    got = {r.doc_id: r.near_items for r in decontam.matches(documents(spark, texts), bench).collect()}
    assert got == {0: ["1"], 1: [], 2: []}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(None, "a b c")], "item_id bigint, text string")
    assert decontam.matches(documents(spark, []), one).count() == 0
    assert decontam.clean(documents(spark, []), none).count() == 0
    rows = decontam.report(decontam.matches(documents(spark, ["x a b c", None]), none)).collect()
    assert [(r.doc_id, r.n_words, r.n_hit) for r in sorted(rows)] == [(0, 4, 0), (1, 0, 0)]
    named = decontam.matches(documents(spark, ["x a b c"]), one).first()
    assert named["items"] == ["null"]


def test_proximity_passes_over_terms_that_no_document_has(spark):
    texts = ["x gamma y beta z alpha", "alpha beta", "gamma " + "x " * 60 + "beta alpha", "only"]
    items = [(1, "alpha beta gamma replaced"), (2, "only here and there"), (3, "nowhere"), (4, "only")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: sorted(r.near_items) for r in decontam.matches(documents(spark, texts), bench).collect()}
    assert got == {0: ["1"], 1: [], 2: [], 3: ["4"]}
