import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents, odd_texts, prose
from tokenizers import Tokenizer

from lifetrace.llm import alignment
from lifetrace.llm.tokenids import tokenizer_path


def plain_tokens():
    """Both libraries on whole texts, with the bytes of every token."""
    import sentencepiece

    a = Tokenizer.from_file(tokenizer_path(alignment.BYTE_LEVEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECES))
    of_a = alignment.byte_level_bytes(a)

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        out = [(i, of_a[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, of_b(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return out if all(b"".join(x for _, x in side) == whole for side in out) else ([], [])

    return tokens


def plain_groups(a, b):
    """Groups by merging the two lists of ends."""
    out, ga, gb, at_a, at_b = [], [], [], 0, 0
    a, b = list(a), list(b)
    while a or b:
        if at_a <= at_b:
            i, x = a.pop(0)
            ga.append(i)
            at_a += len(x)
        else:
            i, x = b.pop(0)
            gb.append(i)
            at_b += len(x)
        if at_a == at_b and ga and gb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def plain_report(texts):
    tokens = plain_tokens()
    found = [plain_groups(*tokens(t)) for t in texts]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in found]
    held = Counter(p for c in links for p in c)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    for g, c in zip(found, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        yield (
            sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(c.values()),
            sum(n for p, n in c.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in c.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        )


def texts_of(rng):
    return odd_texts(rng) + [
        "a  b\n\n c\t", " lead", "trail ", "▁x", "a▁ b", "<|endoftext|> <s> </s> <unk>", "日本語 テキスト 한국어 😀😀 naïve", "\x00\x01 z",
        "1234567890 " * 30, "=" * 700, "aaaa" * 500 + " " * 90 + "b", "don't we'll I'M", " x　y  z", prose(rng, 3000) + "\n" + prose(rng, 9),
    ]


@pytest.mark.parametrize(("kept", "wide"), [(1 << 21, 1 << 16), (200, 3), (0, 0)])
def test_report_matches_a_plain_reading(spark, kept, wide, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", kept)
    monkeypatch.setattr(alignment, "WIDE", wide)
    texts = texts_of(random.Random(5))
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.report(documents(spark, texts)).collect()}
    for i, want in enumerate(plain_report(texts)):
        assert got[i] == want, texts[i]


def test_groups_are_kept(spark):
    texts = texts_of(random.Random(6))
    tokens = plain_tokens()
    got = {}
    for r in alignment.groups(alignment.aligned(documents(spark, texts))).collect():
        got.setdefault(r["doc_id"], {})[r["number"]] = (r["a_ids"], r["b_ids"])
    for i, t in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == plain_groups(*tokens(t)), t


@pytest.mark.parametrize("density", [0.0, 0.02, 0.5, 1.0])
def test_cuts_are_the_common_ends(density):
    rng = np.random.default_rng(3)
    a_all, b_all, a_doc, b_doc, base = [], [], [0], [0], 0
    for size in (1, 2, 3, 50, 400, 0, 2000):
        inner = np.arange(1, size)
        side = rng.integers(0, 2, len(inner))
        both = rng.random(len(inner)) < density
        a, b = inner[both | (side == 0)], inner[both | (side == 1)]
        for end, ends, doc in ((a, a_all, a_doc), (b, b_all, b_doc)):
            ends += (base + np.append(end, size)).tolist() if size else []
            doc.append(len(ends))
        base += size
    cut_a, cut_b = alignment.common_ends(*(np.array(x, np.int64) for x in (a_all, b_all, a_doc, b_doc)))
    common = sorted(set(a_all) & set(b_all))
    assert np.array(a_all)[cut_a].tolist() == common
    assert np.array(b_all)[cut_b].tolist() == common


def test_empty_table_and_repeated_rows(spark):
    assert alignment.report(documents(spark, ["x"]).limit(0)).count() == 0
    rows = alignment.report(documents(spark, ["the cat sat"] * 4 + [None], ids=[7] * 4 + [None])).collect()
    assert [r["n_best"] == r["n_links"] > 0 for r in rows if r["doc_id"] == 7] == [True] * 4
    assert [(r["n_a"], r["groups_sha256"]) for r in rows if r["doc_id"] is None] == [(0, "")]
    assert {r["count_sum"] for r in rows if r["doc_id"] == 7} == {4 * rows[0]["n_links"] if rows[0]["doc_id"] == 7 else 4 * rows[1]["n_links"]}


def test_work_on_a_large_batch_is_bounded(spark):
    """What a task holds does not grow with the batches it is given, and Arrow keeps nothing unused."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows, n = 400, 10_000  # 16 MB of ids
    ids = [rng.integers(0, 2000, n, "<u4").tobytes() for _ in range(2 * rows)]
    ends = [np.packbits(np.ones(n, bool)).tobytes()] * rows
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (ids[:rows], ids[rows:], ends, ends)], ["a_ids", "b_ids", "a_cuts", "b_cuts"])
    tracemalloc.start()
    links = 0
    for piece in alignment._pieces([batch], "a_ids", alignment._IDS):
        assert piece.num_rows <= 27
        links += int(alignment._distinct(alignment._Groups(piece))[2].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == rows * n
    assert peak < 64 << 20
