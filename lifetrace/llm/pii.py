"""Personal data: patterns, and a conditional random field over word shapes.

The patterns find what is written as expected. The field is trained from a small
labelled table, made here by rule from templates, and finds what looks like it: cards
with other separators or a wrong digit, phone numbers without a country, addresses in
brackets. Words without a digit or an @ are never part of personal data; they cut the
chain exactly, so only the short runs between them are decoded.

Spans are code points, end exclusive. Patterns are searched around what they cannot
do without (an @, a digit, a plus), in time linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lifetrace.llm import crf
from lifetrace.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
BLANKS = " \t\n\x0b\x0c\r"
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: A word with a digit or an @; the start is only tried behind a blank.
_MARKED = re.compile(r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
            end = domain.end()
        elif local == 0 or not domain:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, chain = run.start(), []
        for piece in run.group().split("."):
            if piece:
                chain.append((at, at + len(piece), piece))
            else:
                chain = []
            if len(chain) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, _, p in chain):
                    yield chain[0][0], chain[3][1]
                chain = []
            at += len(piece) + 1


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start; leftmost, not overlapping per kind."""
    if not _ANY.search(text):
        return []
    found = [(0, *s) for s in (_emails(text) if "@" in text else ())]
    found += [(1, *s) for s in _ips(text)]
    found += [(2, *s) for s in _cards(text)]
    found += [(3, *s) for s in (_phones(text) if "+" in text else ())]
    return found


# --- the field -----------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)  # outside; then first and further words of each kind
_SHAPES, _WORDS = 1024, 512
_SIZE = 3 * _SHAPES + 2 * _WORDS + 64 + 32
_EDGE = ".,;:!?\"'|*$%&#<>=[]{}()"
_LOOK = 40  # characters of the words before and behind that count


def _shape(word: str) -> str:
    """Runs of one class as one sign, with the number of digits of short runs."""
    out, last, n = [], "", 0
    for c in word[:_LOOK]:
        kind = "d" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c
        if kind == last:
            n += 1
            continue
        if last == "d":
            out.append(str(min(n, 5)))
        out.append(kind)
        last, n = kind, 1
    if last == "d":
        out.append(str(min(n, 5)))
    return "".join(out)


def _slot(kind: int, value: str, size: int) -> int:
    return (zlib.crc32(value.encode("utf-8", "replace")) * 2654435761 >> 7) % size + kind


def _features(before: str, word: str, after: str) -> list[int]:
    core = word.strip(_EDGE)
    digits = len(_digits(word))
    return [
        _slot(0, _shape(core), _SHAPES),
        _slot(_SHAPES, _shape(before), _SHAPES),
        _slot(2 * _SHAPES, _shape(after), _SHAPES),
        _slot(3 * _SHAPES, before.strip(_EDGE).lower(), _WORDS),
        _slot(3 * _SHAPES + _WORDS, re.sub("[0-9]+", "0", core.lower()), _WORDS),
        3 * _SHAPES + 2 * _WORDS + min(digits, 31),
        3 * _SHAPES + 2 * _WORDS + 64 + min(len(word), 31),
    ]


def runs(text: str) -> tuple[list[tuple[int, int]], list[int], list[list[int]]]:
    """Marked words, the lengths of their runs, and the features of each word."""
    words = [m.span() for m in _MARKED.finditer(text)]
    lengths: list[int] = []
    rows = []
    for i, (a, b) in enumerate(words):
        joined = i and not text[words[i - 1][1] : a].strip(BLANKS)
        if joined:
            lengths[-1] += 1
        else:
            lengths.append(1)
        before = text[max(0, a - _LOOK) : a].split()
        after = text[b : b + _LOOK].split(None, 1)
        rows.append(_features(before[-1] if before else "", text[a:b], after[0] if after else ""))
    return words, lengths, rows


def labelled_table(seed: int = 11, rows: int = 900) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with labelled spans, by rule: templates around values in many spellings,
    and as many numbers that are no personal data."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def email():
        return f"{name()}{r.choice(['', '.', '_', '-'])}{r.choice([name(), digits(2)])}@{name()}.{r.choice(['com', 'org', 'net', 'co.uk'])}"

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        gap = r.choice(["", "", " ", "-", "."])
        return gap.join(digits(4) for _ in range(4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b}{c}", f"{a}.{b}.{c}"])

    def other():
        return r.choice(
            [
                lambda: str(r.randint(0, 99999)), lambda: f"{r.randint(1, 99)}.{digits(2)}", lambda: f"${digits(3)}",
                lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{digits(2)}", lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}",
                lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 99)}%",
                lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 32, 40]))),
                lambda: f'"{"".join(r.choice("0123456789abcdef") for _ in range(40))}"',
                lambda: f"@{name()}", lambda: f"{name()}{digits(2)}", lambda: f"#{digits(4)}", lambda: f"http://{name()}.com/{digits(3)}",
                lambda: f"2.{r.randint(0, 9)},", lambda: digits(r.choice([1, 2, 3, 5, 6, 7])), lambda: f"{digits(1)},{digits(3)},{digits(3)}",
            ]
        )()

    makers, table = (email, ip, card, phone), []
    for _ in range(rows):
        parts, spans, at = [], [], 0
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 4)):
                parts.append(r.choice([name(), name().upper(), name().capitalize() + r.choice(["", ".", ",", "!!", "%%%", "***"]), "|"]))
                at += len(parts[-1]) + 1
            if r.random() < 0.5:
                parts.append(other())
                at += len(parts[-1]) + 1
                continue
            kind = r.randrange(len(KINDS))
            lead, value, tail = r.choice(["", "", "("]), makers[kind](), r.choice(["", "", ".", ",", ")"])
            spans.append((kind, at + len(lead), at + len(lead) + len(value)))
            parts.append(lead + value + tail)
            at += len(parts[-1]) + 1
        parts.append(name())
        table.append((" ".join(parts), spans))
    return table


def _labels(words, spans) -> list[int]:
    out = []
    for a, b in words:
        label = 0
        for kind, lo, hi in spans:
            if a < hi and lo < b:
                label = 1 + 2 * kind + (a > lo)
        out.append(label)
    return out


def trained(table=None) -> crf.Field:
    lengths, rows, labels = [], [], []
    for text, spans in table or labelled_table():
        words, own, features = runs(text)
        lengths += own
        rows += features
        labels += _labels(words, spans)
    return crf.train(np.array(rows), np.array(lengths), np.array(labels), _SIZE, LABELS)


def _entities(text: str, words, labels) -> list[tuple[int, int, int]]:
    out, last = [], None
    for (a, b), label in zip(words, labels):
        if label == 0:
            last = None
            continue
        kind, further = divmod(label - 1, 2)
        if further and last is not None and out[-1][0] == kind and not text[last:a].strip(BLANKS):
            out[-1][2] = b
        else:
            out.append([kind, a, b])
        last = b
    trimmed = []
    for kind, a, b in out:
        a += len(text[a:b]) - len(text[a:b].lstrip(_EDGE.replace("(", "")))
        b -= len(text[a:b]) - len(text[a:b].rstrip(_EDGE))
        while text[a:b].startswith("(") and text.count("(", a, b) > text.count(")", a, b):
            a += 1
        if a < b:
            trimmed.append((kind, a, b))
    return trimmed


def find(texts: list[str], field: crf.Field) -> list[tuple[list, list]]:
    """Per text the base spans and the further ones of the field, which touch no base span."""
    base = [base_spans(t) for t in texts]
    marked, lengths, rows, owners = [], [], [], []
    for i, t in enumerate(texts):
        if _ANY.search(t):
            words, own, features = runs(t)
            owners.append((i, words))
            lengths += own
            rows += features
    more: list[list] = [[] for _ in texts]
    if rows:
        labels = crf.viterbi(field, np.array(rows), np.array(lengths)).tolist()
        at = 0
        for i, words in owners:
            found = _entities(texts[i], words, labels[at : at + len(words)])
            at += len(words)
            taken = sorted((a, b) for _, a, b in base[i])
            more[i] = [s for s in found if not _touches(taken, s[1], s[2])]
    return list(zip(base, more))


def _touches(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    from bisect import bisect_left

    # base spans of different kinds may overlap each other, so look a little back
    i = bisect_left(taken, (b, -1))
    return any(lo < b and a < hi for lo, hi in taken[max(0, i - 8) : i])


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans of every row of ``docs``.

    A null text is an empty one; repeated rows stay repeated; an empty table gives no rows.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained())
    names = [f"n_{k}" for k in KINDS]

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = find(texts, field.value)
            counts = [[sum(k == i for k, _, _ in base) for base, _ in found] for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    pa.array([_written(b + m) for b, m in found], pa.string()),
                    pa.array([len(m) for _, m in found], pa.int64()),
                ],
                ["doc_id", *names, "base_sha256", "spans", "n_added"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_sha256 string, spans string, n_added bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
