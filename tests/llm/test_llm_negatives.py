import math
import random

import numpy as np
import pytest

from lifetrace.llm import negatives


def plain(rows):
    """All scores, sorted in Python integers."""
    used = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for i, (anchor, label, a) in enumerate(used):
        if anchor % 100:
            continue
        met = [(-sum(x * y for x, y in zip(a, b)), v, lb) for j, (v, lb, b) in enumerate(used) if j != i]
        for score, positive, _ in sorted(m for m in met if m[2] == label)[:5]:
            fit = sorted(m for m in met if m[2] != label and 30 * -score <= 100 * -m[0] <= 90 * -score)[:10]
            out += [(anchor, positive, k, v, -score, -s) for k, (s, v, _) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    return df.selectExpr("*", "vec_id AS row", "label AS block", "vec_id AS parts", "vec_id AS score")


def dirty(rng, n):
    rows = []
    for i in range(n):
        vector = [rng.gauss(0.2, 0.4) for _ in range(rng.choice([6, 6, 6, 4, 0]))]
        rows.append((i * rng.choice([1, 1, 1, 100, 7]), rng.randrange(4), vector))
    rows += [rows[5], rows[5], (100, None, [1.0]), (200, 1, None), (None, 1, [1.0]), (300, 2, [1.0, None]), (400, 2, [math.nan]), (500, 3, [math.inf])]
    rows += [(10_000 + i, i % 2, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # ties
    return rows


@pytest.mark.parametrize(("block", "least", "tile"), [(1 << 17, 32, 1 << 22), (40, 1, 64), (1 << 17, 1, 1)])
def test_matches_all_scores(spark, block, least, tile, monkeypatch):
    for name, value in (("BLOCK_ROWS", block), ("LEAST_BLOCKS", least), ("_TILE", tile)):
        monkeypatch.setattr(negatives, name, value)
    rows = dirty(random.Random(block), 300)
    got = sorted(tuple(r) for r in negatives.mined(table(spark, rows)).collect())
    assert got == plain(rows)
    assert len(got) > 50


def test_residues_give_exact_scores():
    rng = np.random.default_rng(1)
    for high, width in ((10, 3), (300, 64), (40_000, 200), (1 << 26, 64)):
        a, b = (rng.integers(-high, high + 1, (9, width)) for _ in range(2))
        a[0], b[0], b[1] = high, high, -high
        primes = negatives.primes_for(high * high * width)
        got = negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert got.tolist() == want


def test_best_takes_the_first_of_equal_ones():
    values = np.array([3, 5, 5, 1, 5, 9])
    assert sorted(negatives._best(values, 3).tolist()) == [1, 2, 5]
    assert sorted(negatives._best(values, 9).tolist()) == [0, 1, 2, 3, 4, 5]


def test_huge_vectors_and_empty_table(spark):
    assert negatives.mined(table(spark, [(0, 1, [1.0])]).limit(0)).count() == 0
    assert negatives.mined(table(spark, [(100, 1, [1.0])])).count() == 0
    rows = [(100, 1, [1.0, 2.0]), (101, 1, [2.0, 2.0]), (102, 2, [0.5, 1.0]), (103, 2, [1e30, 1.0])]
    assert [r["negative_id"] for r in negatives.mined(table(spark, rows)).collect()] == [102]
