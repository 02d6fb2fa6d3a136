import random

import pytest
from llm_fixtures import documents, odd_texts, prose
from xxhash import xxh64_intdigest

from lifetrace.llm import graph, simhash


def plain_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id reachable over prints within two bits, by flooding."""
    low, todo = {}, set(range(len(prints)))
    while todo:
        group, edge = set(), {todo.pop()}
        while edge:
            group |= edge
            near = {j for j in todo for i in edge if (prints[i] ^ prints[j]).bit_count() <= 2}
            todo -= near
            edge = near
        for i in group:
            low[i] = group
    return low


def near_copies(rng):
    base = prose(rng, 40).split()
    out = []
    for k in range(40):
        words = list(base)
        if k % 4:
            words.append(rng.choice(base))
        out.append(" ".join(words))
    return out


def test_fingerprint_is_the_majority_of_shingle_hashes():
    rng = random.Random(1)
    for text in [t for t in odd_texts(rng)] + near_copies(rng):
        assert simhash.fingerprint((text or "").encode()) == plain_print(text)


@pytest.mark.parametrize("crowded", [1, 32])
def test_components_match_all_pairs(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(2)
    texts = odd_texts(rng) + near_copies(rng) + [None, ""]
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    prints = [plain_print(t) for t in texts]
    groups = plain_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{prints[i]:016x}", min(groups[i])) for i in range(len(texts))
    }
    assert len(got) == len(texts)


@pytest.mark.parametrize("crowded", [1, 32])
def test_links_of_prints_at_every_distance(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for bits in (0, 1, 2, 3, 4):
            for _ in range(4):
                q = p
                for b in rng.sample(range(64), bits):
                    q ^= 1 << b
                prints.add(q)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    roots = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    groups = plain_components(prints)
    for i, s in enumerate(signed):
        assert roots.get(s, s) == min(signed[j] for j in groups[i])


def test_one_of_each_keeps_the_least_id(spark):
    texts = ["a b c d", "a b c d", None, "", "other words here now", "a b c d"]
    ids = [7, 3, None, 9, None, 3]
    docs = documents(spark, texts, ids)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (False, 3, "a b c d"), (False, 9, ""), (True, 0, "other words here now"),
    ]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_graph_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5100)] + [(8, 8)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(find(n) == r for n, r in got.items())
    assert {n for e in edges if e[0] != e[1] for n in e} <= set(got)
