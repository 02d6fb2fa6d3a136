"""Small dirty tables: nulls, empty texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the and of to in is that for it as with on are this be".split()


def documents(spark, texts, ids=None, sources=None, extra=True):
    """``documents`` with further columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if not extra:
        return df
    names = ["fp", "size", "key", "_key", "_row", "_doc", "doc", "words", "number", "target", "m", "q", "extra", "_text"]
    return df.selectExpr("*", *[f"doc_id AS `{n}`" for n in names])


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    """Sentences of invented words."""
    out = []
    for i in range(n):
        w = rng.choice(WORDS) if rng.random() < 0.4 else "w" + "".join(rng.choice("aeioulrnst") for _ in range(rng.randint(2, 7)))
        out.append(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w)
    return " ".join(out)


def odd_texts(rng: random.Random) -> list:
    a, b = prose(rng, 60), prose(rng, 90)
    return [None, "", "   \n\t ", "one", "one two", "Ünïcode wörds ünd mehr " * 3, a, a, b, b + " tail", a.upper(), b[:200], "x" * 5000, prose(rng, 4000)]
