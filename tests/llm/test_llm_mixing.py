import heapq
import random
import re

from llm_fixtures import documents, odd_texts, prose
from pyspark.sql import functions as F

from lifetrace.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Share all words by weight; cap at three times, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            for s in free:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def table(spark, seed, n=300):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([0, 3, 20, 60, 200])) for _ in range(n)] + odd_texts(rng)
    sources = [rng.choice(["big"] * 6 + ["a", "B", "é", "zz", "", None]) for _ in texts]
    return documents(spark, texts, sources=sources), texts, sources


def test_targets_and_taken(spark):
    docs, texts, sources = table(spark, 10)
    rows = mixing.quotas(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    total = {s: sum(size[i] for i, x in enumerate(sources) if x == s) for s in set(sources)}
    want = plain_targets(total)
    taken = dict.fromkeys(total, 0)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.size, r.source, r.source_size) == (size[r.doc_id], sources[r.doc_id], total[r.source])
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 2), (s, taken[s], t)


def test_reruns_agree_and_shards_do_not_matter_for_targets(spark, monkeypatch):
    docs, _, _ = table(spark, 11)
    first = sorted(mixing.quotas(docs).collect())
    assert first == sorted(mixing.quotas(docs.repartition(7)).collect())
    monkeypatch.setattr(mixing, "SHARD_ROWS", 8)
    many = mixing.quotas(docs)
    sums = {r.source: (r.t, r.k) for r in many.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()}
    for t, k in sums.values():
        assert abs(k - t) <= max(0.05 * t, 8)


def test_quotas_are_those_of_highest_quotients(spark):
    rng = random.Random(12)
    for targets, seats in (
        ([rng.random() * 100 for _ in range(40)], 333), ([5.0] * 7, 10), ([3.0, 1.0, 1.0, 0.0], 4), ([1.0, 2.0, 3.0, 6.0], 1000), ([9.0], 5),
    ):
        df = spark.createDataFrame([(i, 0, float(t)) for i, t in enumerate(targets)], "number bigint, shard bigint, target double")
        got = {r.number: r.q for r in df.select("number", mixing._quotas(df, seats).alias("q")).collect()}
        heap = [(-t, i, 0) for i, t in enumerate(targets) if t > 0]
        heapq.heapify(heap)
        want = dict.fromkeys(range(len(targets)), 0)
        for _ in range(seats):
            _, i, k = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (-targets[i] / (2 * k + 3), i, k + 1))
        assert got == want


def test_mixed_documents_hold_the_words_taken(spark):
    docs, texts, _ = table(spark, 13)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        own = WORD.findall(r.text)
        assert r.n_chars == len(r.text)
        assert set(own) <= set(WORD.findall(texts[r.doc_id]))
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
    want = {r.doc_id: r.taken for r in mixing.quotas(docs).collect() if r.taken}
    assert words == want


def test_empty_null_and_repeated(spark):
    assert mixing.quotas(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [])).count() == 0
    rows = mixing.quotas(documents(spark, [None, "", None], sources=[None, None, "a"])).collect()
    assert {(r.size, r.target, r.taken) for r in rows} == {(0, 0.0, 0)}
    same = documents(spark, ["a b c d"] * 4, ids=[1, 1, None, None], sources=["x"] * 4)
    assert sum(r.taken for r in mixing.quotas(same).collect()) == 16
