import random
import zlib

import numpy as np
import pytest
from llm_fixtures import documents, odd_texts, prose

from lifetrace.llm import coder, tokenids


def streams():
    rng = np.random.default_rng(14)
    yield np.zeros(0, np.uint32)
    yield np.array([65535], np.uint32)
    yield rng.integers(0, 65536, 3 * coder.BLOCK + 1).astype(np.uint32)
    yield np.full(2 * coder.BLOCK, 2, np.uint32)
    yield rng.zipf(1.3, 5000).clip(0, 50000).astype(np.uint32)
    yield np.tile(rng.integers(0, 50000, 97), 60).astype(np.uint32)
    yield np.tile(np.array([0, 255, 256, 65280], np.uint32), 700)


def test_round_trip():
    for ids in streams():
        out = coder.decode(coder.encode(ids))
        assert out.dtype == np.uint32 and (out == ids).all()


def test_repetition_is_predicted():
    ids = np.tile(np.random.default_rng(15).integers(0, 50000, 60), 100).astype(np.uint32)
    assert len(coder.encode(ids)) < len(ids) * 0.5


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(16).integers(0, 500, 2 * coder.BLOCK).astype(np.uint32)
    stream = bytearray(coder.encode(ids))
    first, second = coder.encode(ids[: coder.BLOCK]), coder.encode(ids[coder.BLOCK :])
    assert bytes(stream[12 + 32 :]) == first[12 + 16 :] + second[12 + 16 :]
    stream[-5] ^= 1
    with pytest.raises(ValueError, match="block 1"):
        coder.decode(bytes(stream))
    with pytest.raises(ValueError):
        coder.decode(b"something else")
    with pytest.raises(ValueError):
        coder.encode(np.array([1 << 16], np.uint32))


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenids.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_whole_text(plain):
    rng = random.Random(17)
    encode = tokenids.Pieces(tokenids.tokenizer_path())
    bits = [" ", "  ", "\n", "\t", "a", "don't", "é", "1", "!", " ", "　", "\x1c", "\x85", "\r\n", "<|endoftext|>", "word", "'s", "中文", "\U0001f600"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [prose(rng, 200), ""]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        ids, sizes = encode(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(t) for t in part]


@pytest.mark.parametrize("segment", [coder.BLOCK * coder.LANES, 400])
def test_files_hold_every_text_in_order(spark, plain, monkeypatch, segment):
    monkeypatch.setattr(tokenids, "SEGMENT_IDS", segment)
    texts = odd_texts(random.Random(18))
    ids = list(range(len(texts)))
    random.Random(19).shuffle(ids)
    rows = {r.doc_id: r for r in tokenids.encoded(documents(spark, texts, ids).repartition(4)).collect()}
    start = 0
    for doc_id, text in sorted(zip(ids, texts)):
        want = np.array([*plain(text), tokenids.END_ID], "<u4")
        row = rows[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len(rows) == len(texts)


def test_null_and_repeated_ids(spark, plain):
    texts = ["b", "a", "c", "a", None]
    rows = tokenids.encoded(documents(spark, texts, [5, 5, None, 5, 1])).collect()
    assert sorted(r.start for r in rows) == [0, 2, 3, 5, 7]
    assert min(rows, key=lambda r: r.start).doc_id is None
    assert tokenids.encoded(documents(spark, [])).count() == 0


def test_strings_of_special_tokens_are_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenids.tokenizer_path())
    plain = lambda text: library.encode(text, add_special_tokens=False).ids
    assert len(plain("<|endoftext|>")) == 1
    rng = random.Random(20)
    bits = [" ", "  ", "\n", "\t", "a", "don't", "1", "!", "<|endoftext|>", "<|endoftext|>", "word", "中文", "<|", "|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    encode = tokenids.Pieces(tokenids.tokenizer_path(), special=True)
    for lo in range(0, len(texts), 500):
        ids, sizes = encode(texts[lo : lo + 500])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(t) for t in texts[lo : lo + 500]]
    start = 0
    for row in sorted(tokenids.encoded(documents(spark, texts[:50])).collect(), key=lambda r: r.doc_id):
        want = np.array([*plain(texts[row.doc_id]), tokenids.END_ID], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
