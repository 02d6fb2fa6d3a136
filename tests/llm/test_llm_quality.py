import random
import re
from collections import Counter

from llm_fixtures import documents, odd_texts, prose

from lifetrace.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def cases():
    rng = random.Random(5)
    line = prose(rng, 11)
    out = odd_texts(rng)
    out += ["\n".join([line] * 5), line + "\n\n" + line + "\n \n" + line, "a b c d e f g h " * 4, "x y " * 30]
    out += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(20)]
    out += [prose(rng, rng.randint(15, 25)) for _ in range(10)]
    return out


def junk(rng):
    words = prose(rng, 80).split()
    return [
        " ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in words), " | ".join(words),
        "!! ".join(w.upper() for w in words), " ".join(w for w in words[:10] for _ in range(9)),
    ]


def test_counts_match_a_plain_reading(spark):
    texts = cases()
    got = {r.doc_id: r for r in quality.scores(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = plain_counts(text)
        row = got[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.base_failed and row.kept)


def plain_em(patterns, names):
    """The same estimate over single rows."""
    import math

    share = quality.PRIOR_GOOD
    good = dict.fromkeys(names, quality.RIGHT_ON_GOOD)
    bad = dict.fromkeys(names, quality.RIGHT_ON_BAD)

    def p(votes):
        a, b = share, 1 - share
        for n, v in zip(names, votes):
            if v:
                a *= good[n] if v == 1 else 1 - good[n]
                b *= bad[n] if v == -1 else 1 - bad[n]
        return a / (a + b)

    for _ in range(quality.STEPS):
        ps = [p(v) for v in patterns]
        before = [share, *good.values(), *bad.values()]
        w = quality.PRIOR_SEEN
        new_good, new_bad = {}, {}
        for k, n in enumerate(names):
            plus = [(q, v[k]) for q, v in zip(ps, patterns)]
            g1, g0 = sum(q for q, v in plus if v == 1), sum(q for q, v in plus if v == -1)
            b1, b0 = sum(1 - q for q, v in plus if v == -1), sum(1 - q for q, v in plus if v == 1)
            new_good[n] = max(quality.RIGHT_ON_GOOD, (g1 + quality.RIGHT_ON_GOOD * w) / (g1 + g0 + w))
            new_bad[n] = (b1 + quality.RIGHT_ON_BAD * w) / (b1 + b0 + w)
        share = (sum(ps) + quality.PRIOR_GOOD * w) / (len(ps) + w)
        good, bad = new_good, new_bad
        if max(abs(x - y) for x, y in zip(before, [share, *good.values(), *bad.values()])) < quality.SETTLED:
            break
    assert all(math.isfinite(x) for x in (share, *good.values(), *bad.values()))
    return p


def test_em_matches_a_plain_reading(spark):
    rng = random.Random(6)
    names = ["a", "b", "c"]
    rows = [tuple(rng.choice([1, 1, 1, 0, -1]) for _ in names) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    model = quality.fit(df, names)
    from pyspark.sql import functions as F

    got = df.select("*", model.probability({n: F.col(n) for n in names}).alias("p")).collect()
    p = plain_em(rows, names)
    for r in got:
        assert abs(r.p - p((r.a, r.b, r.c))) < 1e-6


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(7)
    clean = [prose(rng, rng.randint(40, 300)) for _ in range(120)]
    bad = [t for _ in range(5) for t in junk(rng)]
    docs = documents(spark, clean + bad)
    kept = quality.good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(clean)))


def test_empty_and_single(spark):
    assert quality.scores(documents(spark, [])).count() == 0
    assert quality.good(documents(spark, [])).count() == 0
    assert quality.good(documents(spark, [None, ""])).count() == 0


def test_main_path_has_no_python(spark):
    plan = quality.scores(documents(spark, ["a b"], extra=False))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
