"""Adaptive context-mixing range coder for token ids.

A block of ids is coded on its own, from an empty model. For every id the order-2 and
the order-1 context (the last two ids, the last id) each predict one id, the one that
followed last, with a confidence; adaptive hit rates per confidence turn them into
probabilities, mixed by confidence where both name the same id. What neither predicts
is coded by order-0 counts of the block: of the id's high byte, and of its low byte
given the high one. Everything is integer arithmetic, so any machine decodes what
another has written.

A range coder is sequential; here the blocks of a segment advance together, one id of
every block at a time, as numpy vectors with a lane per block. Encoder and decoder are
the same loop over the same model.

A stream is ``MAGIC``, the number of blocks, and per block its header (ids, 16-bit
words, CRC-32 of the ids, CRC-32 of the words), then the words of all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDCM0001"
BLOCK = 2048
LANES = 1024  # blocks that are coded together
IDS = 1 << 16

_BITS = 12
_ONE = 1 << _BITS
_TOP = np.uint64(1 << 48)
_LEAST = np.uint64(1 << 40)
_SLOTS2, _SLOTS1 = 2048, 1024
_SURE = 7  # highest confidence
_LOW_TABLES = 9  # low bytes are counted by high byte, those from 8 on together
_U64 = np.uint64
_FEWEST, _MOST = np.int32(16), np.int32(4000)  # bounds of a hit rate

_KNOWN = np.arange(_SURE + 1)
#: Confidence after a miss and after a hit; a prediction without any is replaced.
_AFTER = np.concatenate([_KNOWN >> 1, np.where(_KNOWN > 0, np.minimum(_KNOWN + 1, _SURE), 0)])
_REPLACED = _AFTER == 0
_SURER = np.maximum(_AFTER, 1).astype(np.uint8)
#: Weight (of 256) of order 2 where both orders predict the same id, by both confidences.
_MIX = np.where(
    _KNOWN[:, None] == 0, 0, np.where(_KNOWN == 0, 256, 256 * (_KNOWN[:, None] + 1) // (_KNOWN[:, None] + _KNOWN + 2))
).astype(np.int32).reshape(-1)


class _Model:
    """Predictions of all lanes; ``see`` makes them follow what was coded."""

    def __init__(self, lanes: int):
        at = np.arange(lanes, dtype=np.int64)
        self.lane = at
        self.base2, self.base1, self.base_rate = at * _SLOTS2, at * _SLOTS1, at * (_SURE + 1)
        self.id2, self.sure2 = np.zeros(lanes * _SLOTS2, np.uint16), np.zeros(lanes * _SLOTS2, np.uint8)
        self.id1, self.sure1 = np.zeros(lanes * _SLOTS1, np.uint16), np.zeros(lanes * _SLOTS1, np.uint8)
        start = np.arange(_SURE + 1, dtype=np.int32) * 400 + 200
        start[0] = 0  # no prediction yet
        self.rate2, self.rate1 = np.tile(start, lanes), np.tile(start, lanes)
        self.before, self.last = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.high = np.zeros((lanes, 256), np.int32)
        self.low = np.zeros((lanes * _LOW_TABLES, 256), np.int32)
        self.high_from = _cumulated(self.high)
        self.low_from = _cumulated(self.low)
        self.step = 0

    def predict(self, n: int):
        """(order-2 id, share), (order-1 id, share) for the first ``n`` lanes."""
        a, b = self.before[:n], self.last[:n]
        mixed = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)
        self.at2 = self.base2[:n] + ((mixed ^ (mixed >> np.uint32(15))) >> np.uint32(21)).astype(np.int64)
        self.at1 = self.base1[:n] + ((b * np.uint32(0x9E3779B1)) >> np.uint32(22)).astype(np.int64)
        self.c2, self.k2 = self.id2.take(self.at2), self.sure2.take(self.at2)
        self.c1, self.k1 = self.id1.take(self.at1), self.sure1.take(self.at1)
        self.r2, self.r1 = self.base_rate[:n] + self.k2, self.base_rate[:n] + self.k1
        self.p2, self.p1 = self.rate2.take(self.r2), self.rate1.take(self.r1)
        agree = self.c1 == self.c2
        weight = _MIX.take(self.k2.astype(np.int64) * (_SURE + 1) + self.k1)
        f2 = np.where(agree, self.p1 + ((self.p2 - self.p1) * weight >> 8), self.p2)
        f1 = np.where(agree, 0, (self.p1 * (_ONE - f2)) >> _BITS)
        return f2, f1

    def see(self, ids: np.ndarray, n: int) -> None:
        for table, sure, at, c, k, rate, r, p in (
            (self.id2, self.sure2, self.at2, self.c2, self.k2, self.rate2, self.r2, self.p2),
            (self.id1, self.sure1, self.at1, self.c1, self.k1, self.rate1, self.r1, self.p1),
        ):
            hit = c == ids
            rate[r] = p + ((np.where(hit, _MOST, _FEWEST) - p) >> 4)
            rate[:: _SURE + 1] = 0  # without a prediction there is no rate
            then = k + hit * np.uint8(_SURE + 1)
            table[at] = np.where(_REPLACED.take(then), ids, c)
            sure[at] = _SURER.take(then)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.step += 1
        if self.step & 63 == 0 or self.step in (8, 16, 32):
            self.high_from = _cumulated(self.high)
        if self.step & (self.step - 1) == 0 and self.step >= 64:
            self.low_from = _cumulated(self.low)

    def low_row(self, lanes: np.ndarray, high: np.ndarray) -> np.ndarray:
        return lanes * _LOW_TABLES + np.minimum(high, _LOW_TABLES - 1)

    def count(self, lanes: np.ndarray, high: np.ndarray, row: np.ndarray, low: np.ndarray) -> None:
        for table, at in ((self.high, lanes * 256 + high), (self.low, row * 256 + low)):
            flat = table.reshape(-1)
            flat[at] = flat.take(at) + 1


def _cumulated(counts: np.ndarray) -> np.ndarray:
    """Flat rows of 257 bounds from 0 to _ONE; every byte keeps a share of at least 1."""
    out = np.zeros((len(counts), 257), np.int16)
    for lo in range(0, len(counts), 256):  # a part at a time stays in the cache
        sums = np.cumsum(counts[lo : lo + 256], axis=1, dtype=np.int32)
        total = np.maximum(sums[:, -1:], 1)
        part = out[lo : lo + 256]
        part[:, 1:] = sums * (_ONE - 256) // total + np.arange(1, 257, dtype=np.int32)
        part[sums[:, -1] == 0] = np.arange(257, dtype=np.int16) * (_ONE // 256)
    return out.reshape(-1)


def encode(ids: np.ndarray) -> bytes:
    """The stream of up to LANES * BLOCK ids below IDS."""
    n_blocks = -(-len(ids) // BLOCK)
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError("ids must be below 65536")
    grid = np.zeros((n_blocks, BLOCK), np.uint16)
    grid.reshape(-1)[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    sizes = np.full(n_blocks, BLOCK, np.int64)
    if n_blocks:
        sizes[-1] = len(ids) - BLOCK * (n_blocks - 1)
    room = 3 * BLOCK + 16
    words, pos = np.zeros((n_blocks, room), np.uint16), np.zeros(n_blocks, np.int64)
    low, width = np.zeros(n_blocks, _U64), np.full(n_blocks, ~_U64(0))
    model = _Model(n_blocks)

    def narrow(at, first, share):
        part = width[at] >> _U64(_BITS)
        low[at] += first.astype(_U64) * part
        width[at] = share.astype(_U64) * part

    for t in range(BLOCK if n_blocks > 1 else int(sizes.sum())):
        n = n_blocks if t < sizes[-1] else n_blocks - 1
        now = grid[t, :n]
        f2, f1 = model.predict(n)
        is2 = (now == model.c2) & (f2 > 0)
        is1 = ~is2 & (now == model.c1) & (f1 > 0)
        first = np.where(is2, 0, np.where(is1, f2, f2 + f1))
        share = np.where(is2, f2, np.where(is1, f1, _ONE - f2 - f1))
        narrow(slice(0, n), first, share)
        rest = np.flatnonzero(~(is2 | is1))
        if len(rest):
            value = now[rest].astype(np.int64)
            high, byte = value >> 8, value & 255
            row = model.low_row(rest, high)
            for table, at, symbol in ((model.high_from, rest, high), (model.low_from, row, byte)):
                place = at * 257 + symbol
                begin = table.take(place)
                narrow(rest, begin, table.take(place + 1) - begin)
            model.count(rest, high, row, byte)
        model.see(now, n)
        at = _unsettled(low, width, slice(0, n))
        while len(at):
            words[at, pos[at]] = (low[at] >> _U64(48)).astype(np.uint16)
            pos[at] += 1
            low[at] <<= _U64(16)
            width[at] <<= _U64(16)
            at = _unsettled(low, width, at)
    for shift in (48, 32, 16, 0):
        words[np.arange(n_blocks), pos] = ((low >> _U64(shift)) & _U64(0xFFFF)).astype(np.uint16)
        pos += 1
    heads, bodies = [MAGIC, struct.pack("<I", n_blocks)], []
    for b in range(n_blocks):
        body = words[b, : pos[b]].astype("<u2").tobytes()
        own = ids[b * BLOCK : b * BLOCK + sizes[b]].astype("<u4").tobytes()
        heads.append(struct.pack("<4I", sizes[b], pos[b], zlib.crc32(own), zlib.crc32(body)))
        bodies.append(body)
    return b"".join(heads + bodies)


def _unsettled(low: np.ndarray, width: np.ndarray, at) -> np.ndarray:
    """Lanes of ``at`` whose top word is fixed or whose width is too small; the latter
    is cut so that the word gets fixed."""
    here, wide = low[at], width[at]
    fixed = (here ^ (here + wide)) < _TOP
    small = ~fixed & (wide < _LEAST)
    index = np.arange(at.stop) if isinstance(at, slice) else at
    if small.any():
        cut = index[small]
        width[cut] = (~low[cut] + _U64(1)) & (_LEAST - _U64(1))
    return index[fixed | small]


def decode(stream: bytes) -> np.ndarray:
    """The ids of ``encode``; ValueError where a checksum does not hold."""
    if stream[:8] != MAGIC:
        raise ValueError("not a stream of token ids")
    (n_blocks,) = struct.unpack_from("<I", stream, 8)
    heads = np.frombuffer(stream, "<u4", 4 * n_blocks, 12).reshape(n_blocks, 4).astype(np.int64)
    if not n_blocks:
        return np.zeros(0, np.uint32)
    sizes, counts = heads[:, 0], heads[:, 1]
    words = np.zeros((n_blocks, int(counts.max()) + 8), np.uint16)
    start = 12 + 16 * n_blocks
    for b in range(n_blocks):
        body = stream[start : start + 2 * counts[b]]
        if zlib.crc32(body) != heads[b, 3]:
            raise ValueError(f"block {b} is damaged")
        words[b, : counts[b]] = np.frombuffer(body, "<u2")
        start += 2 * int(counts[b])
    code, pos = np.zeros(n_blocks, _U64), np.full(n_blocks, 4, np.int64)
    for k in range(4):
        code = (code << _U64(16)) | words[:, k]
    low, width = np.zeros(n_blocks, _U64), np.full(n_blocks, ~_U64(0))
    model = _Model(n_blocks)
    grid = np.zeros((BLOCK, n_blocks), np.uint16)

    def wanted(at):
        part = width[at] >> _U64(_BITS)
        return np.minimum((code[at] - low[at]) // part, _U64(_ONE - 1)).astype(np.int32), part

    def narrow(at, first, share, part):
        low[at] += first.astype(_U64) * part
        width[at] = share.astype(_U64) * part

    for t in range(int(sizes.max())):
        n = n_blocks if t < sizes[-1] else n_blocks - 1
        f2, f1 = model.predict(n)
        here = slice(0, n)
        value, part = wanted(here)
        is2 = value < f2
        is1 = ~is2 & (value < f2 + f1)
        first = np.where(is2, 0, np.where(is1, f2, f2 + f1))
        share = np.where(is2, f2, np.where(is1, f1, _ONE - f2 - f1))
        narrow(here, first, share, part)
        now = np.where(is2, model.c2, model.c1)
        rest = np.flatnonzero(~(is2 | is1))
        if len(rest):
            high = _coded(model.high_from, rest, wanted, narrow, rest)
            row = model.low_row(rest, high)
            byte = _coded(model.low_from, row, wanted, narrow, rest)
            now[rest] = (high << 8 | byte).astype(np.uint16)
            model.count(rest, high, row, byte)
        grid[t, :n] = now
        model.see(now, n)
        at = _unsettled(low, width, here)
        while len(at):
            code[at] = (code[at] << _U64(16)) | words[at, pos[at]]
            pos[at] += 1
            low[at] <<= _U64(16)
            width[at] <<= _U64(16)
            at = _unsettled(low, width, at)
    ids = np.concatenate([np.ascontiguousarray(grid.T).reshape(-1)[: int(sizes.sum())]]).astype(np.uint32)
    for b in range(n_blocks):
        if zlib.crc32(ids[b * BLOCK : b * BLOCK + sizes[b]].astype("<u4").tobytes()) != heads[b, 2]:
            raise ValueError(f"block {b} is damaged")
    return ids


def _coded(table: np.ndarray, row: np.ndarray, wanted, narrow, lanes: np.ndarray) -> np.ndarray:
    """The byte whose bounds in the rows of ``table`` hold the coded value."""
    value, part = wanted(lanes)
    base = row * 257
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        base += step * (table.take(base + step) <= value)
    begin = table.take(base)
    narrow(lanes, begin, table.take(base + 1) - begin, part)
    return base - row * 257
