"""Quality rules as weak supervision, in DataFrame functions only.

Every rule looks at counts of a text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the vote patterns estimates how often each rule is
right about good and about bad documents, and with that the probability that a
document is good. Patterns are at most 3^rules, however many documents there are;
they are counted with a partial aggregate and each EM step is one small job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifetrace.llm.common import WORD, free_names, let, whole_text
from lifetrace.session import staged

WINDOW = 8  # words that must come again to count as repeated
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
KEEP = 0.5  # least probability of a document that stays

STEPS = 40
SETTLED = 1e-4
#: Start and prior of the estimates, worth PRIOR_SEEN documents. A rule knows one kind of
#: defect: it speaks against some bad documents only, and against hardly a good one. That
#: it errs on no more good documents is held all through; else the largest kind of defect
#: would count as bad and the others as errors of their rules.
PRIOR_SEEN, PRIOR_GOOD, RIGHT_ON_GOOD, RIGHT_ON_BAD = 20.0, 0.8, 0.998, 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words covered by windows that occur more than once."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashes,
        lambda h: F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        again = let(
            ordered,
            lambda p: F.filter(
                p,
                lambda x, i: F.coalesce(x["g"] == F.get(p, i - 1)["g"], F.lit(False))
                | F.coalesce(x["g"] == F.get(p, i + 1)["g"], F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        widths = let(
            starts,
            lambda s: F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))),
        )
        return F.aggregate(widths, F.lit(0).cast("bigint"), lambda n, x: n + x)

    return let(
        windows,
        lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("bigint")),
    )


def _measures(text: Column) -> Column:
    """A struct of everything the rules look at; the text is split once."""
    long = lambda c: c.cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.struct(
            F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
            lines.alias("lines"),
        ),
        lambda t: F.struct(
            long(F.size(t["words"])).alias("n_words"),
            long(F.length(F.array_join(t["words"], ""))).alias("word_chars"),
            long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
            long(F.size(t["lines"]) - F.size(F.array_distinct(t["lines"]))).alias("n_dup_lines"),
            _repeated(t["words"]).alias("n_repeat_words"),
            long(F.size(t["lines"])).alias("n_lines"),
            long(F.size(F.array_distinct(t["words"]))).alias("n_distinct"),
            long(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
            long(F.regexp_count(text, F.lit(r"[.!?](?=\s|$)"))).alias("n_ends"),
        ),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(m: Column) -> dict[str, Column]:
    """The votes, from the measures; shares are compared in integers."""
    n, chars = m["n_words"], m["word_chars"]
    return {
        "length": _vote(n < MIN_WORDS, n >= 2 * MIN_WORDS),
        "word_length": _vote((chars < 2 * n) | (chars > 12 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "symbols": _vote(10 * m["n_symbols"] > n, 50 * m["n_symbols"] <= n),
        "lines": _vote(3 * m["n_dup_lines"] > m["n_lines"], (m["n_dup_lines"] == 0) & (m["n_lines"] >= 3)),
        "repeats": _vote(100 * m["n_repeat_words"] > MAX_REPEATED * n, 10 * m["n_repeat_words"] <= n),
        "variety": _vote((n >= 30) & (4 * m["n_distinct"] < n), 3 * m["n_distinct"] >= n),
        "capitals": _vote(4 * m["n_upper"] > chars, 10 * m["n_upper"] <= chars),
        "sentences": _vote((n >= 50) & (100 * m["n_ends"] < n), 40 * m["n_ends"] >= n),
    }


@dataclass(frozen=True)
class Rules:
    """Log odds of a good document: a start, and what a good or bad vote adds."""

    start: float
    good: dict[str, float]
    bad: dict[str, float]

    def probability(self, votes: dict[str, Column]) -> Column:
        odds = F.lit(self.start)
        for name, vote in votes.items():
            odds = odds + F.when(vote == 1, F.lit(self.good[name])).when(vote == -1, F.lit(self.bad[name])).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def _log_odds(share: float, right_good: dict, right_bad: dict) -> Rules:
    return Rules(
        math.log(share / (1 - share)),
        {r: math.log(right_good[r] / (1 - right_bad[r])) for r in right_good},
        {r: math.log((1 - right_good[r]) / right_bad[r]) for r in right_good},
    )


def fit(voted: DataFrame, names: list[str]) -> Rules:
    """EM over the counted patterns of the vote columns ``names``.

    An empty table leaves the start values. Estimates are smoothed by the prior, so
    a rule that never votes, or always alike, keeps a finite weight.
    """
    patterns = staged(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "patterns").coalesce(1)
    share = PRIOR_GOOD
    right_good = dict.fromkeys(names, RIGHT_ON_GOOD)
    right_bad = dict.fromkeys(names, RIGHT_ON_BAD)
    votes = {r: F.col(r) for r in names}
    for _ in range(STEPS):
        model = _log_odds(share, right_good, right_bad)
        weighed = patterns.select("*", model.probability(votes).alias("p"))
        good, bad = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum("n").alias("all"), F.sum(good).alias("good")]
        for r in names:
            for vote in (1, -1):
                of = F.col(r) == vote
                sums += [
                    F.sum(F.when(of, good).otherwise(0.0)).alias(f"{r}_good_{vote}"),
                    F.sum(F.when(of, bad).otherwise(0.0)).alias(f"{r}_bad_{vote}"),
                ]
        row = weighed.agg(*sums).first()
        if not row["all"]:
            break
        before = [share, *right_good.values(), *right_bad.values()]
        share = (row["good"] + PRIOR_GOOD * PRIOR_SEEN) / (row["all"] + PRIOR_SEEN)
        for r in names:
            g, b = row[f"{r}_good_1"], row[f"{r}_bad_-1"]
            seen = (g + RIGHT_ON_GOOD * PRIOR_SEEN) / (g + row[f"{r}_good_-1"] + PRIOR_SEEN)
            right_good[r] = max(RIGHT_ON_GOOD, seen)
            right_bad[r] = (b + RIGHT_ON_BAD * PRIOR_SEEN) / (b + row[f"{r}_bad_1"] + PRIOR_SEEN)
        after = [share, *right_good.values(), *right_bad.values()]
        if max(abs(x - y) for x, y in zip(before, after)) < SETTLED:
            break
    return _log_odds(share, right_good, right_bad)


def judged(rows: DataFrame, text: Column, kept: list[Column]) -> DataFrame:
    """``kept`` columns of ``rows`` with ``q``: counts, probability, base_failed, kept.

    Null and empty texts have no words and fail. An empty table gives no rows.
    """
    measured = rows.select(*kept, _measures(text).alias("m"))
    votes = rules(F.col("m"))
    names = list(votes)
    column = {r: f"_vote_{r}" for r in names}
    table = staged(measured.select("*", *[v.alias(column[r]) for r, v in votes.items()]), "votes")
    model = fit(table.select(*[F.col(column[r]).alias(r) for r in names]), names)
    m = F.col("m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
    probability = model.probability({r: F.col(column[r]) for r in names})
    verdict = F.struct(
        *[m[c].alias(c) for c in COUNTS],
        probability.alias("probability"),
        failed.alias("base_failed"),
        (~failed & (probability >= KEEP)).alias("kept"),
    )
    others = [c for c in table.columns if c != "m" and c not in column.values()]
    return table.select(*others, verdict.alias("q"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and probability of every row."""
    return judged(docs, whole_text(), [F.col("doc_id")]).select("doc_id", "q.*")


def good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    (doc,) = free_names(docs, "_doc")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return judged(docs, whole_text(), [whole.alias(doc)]).filter("q.kept").select(f"{doc}.*")
