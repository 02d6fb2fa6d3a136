"""Secrets in texts and in what is encoded inside them.

A worklist per text: the text itself, then every layer found inside a layer. Paragraphs
with percent escapes or Unicode escapes become decoded layers, runs of base64, also over
several lines, become text or bytes, compressed bytes are unpacked up to their end or
their damage. Every layer is scanned again and looked through again until nothing new
comes out; a layer that was seen before at its place is not entered again. A span found in a layer is mapped to the text: sign by sign through
escapes, to the whole run through base64 and compression.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import io
import lzma
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from lifetrace.llm.common import slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PARAGRAPH_END = re.compile(r"\n[ \t\r]*\n")
_PERCENT_PART = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE_PART = re.compile(r"\\u\{?([0-9A-Fa-f]{4})\}?|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_SIGN = "[A-Za-z0-9+/_-]"
_BASE64 = re.compile(rf"(?<!{_SIGN}){_SIGN}{{16,}}={{0,2}}")
#: Base64 that goes on over single line breaks.
_WRAPPED = re.compile(rf"(?<!{_SIGN}){_SIGN}{{16,}}+(?:[ \t]*+\r?\n[ \t]*+{_SIGN}++)++={{0,2}}")
_LINE = re.compile(rf"{_SIGN}+")
#: What a secret, or a layer with one, has at least in it.
_LEGIBLE = re.compile(r"[\x20-\x7e\t-\r]{16}")
#: Unpacked layers are looked through in windows of about this size that overlap, so that
#: a layer that unpacks to very much is whole but never held at once. A run of base64 or
#: of escapes is not cut where a window ends: the next window holds it from its beginning.
WINDOW, OVERLAP = 4 << 20, 64 << 10
_CODED = r"[A-Za-z0-9+/_=%\\&#;{}-]"
_TAIL = re.compile(rf"{_CODED}*+(?:[ \t]*+\n\r?[ \t]*+{_CODED}{{16,}}+)*+")  # of the text backwards
#: Bytes unpacked in one step.
STEP = 64 << 10


def direct(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns, leftmost and not overlapping per kind."""
    found = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _direct_inside(text: str) -> list[tuple[int, int, int]]:
    """As ``direct``, for layers: a value that is too short hides no key inside or at its
    end, as a whole line is looked through where once a single word was decoded."""
    found = [x for x in direct(text) if x[1]]
    low = text.lower() if ":" in text or "=" in text else ""
    if any(k in low for k in _KEYWORDS):
        last, m = -1, _ASSIGN.search(text)
        while m:
            if m.end(1) - m.start(1) >= 12 and m.end() > last:
                found.append((m.start(), 0, m.end()))
                last = m.end()
            m = _ASSIGN.search(text, max(m.start(1), m.end(1) - len("password")))
    return sorted(found)


class Layer:
    """Where the signs of a decoded text come from in the layer above: pieces from ``at``
    on begin at ``begins``, and go on by ``steps`` signs each, or are a whole (step 0)
    up to ``ends``."""

    def __init__(self):
        self.size, self.at, self.begins, self.ends, self.steps = 0, [], [], [], []

    def add(self, size: int, begin: int, end: int, step: int) -> None:
        if size:
            self.at.append(self.size), self.begins.append(begin), self.ends.append(end), self.steps.append(step)
            self.size += size

    def outer(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        end = self.begins[j] + (b - self.at[j]) * self.steps[j] if self.steps[j] else self.ends[j]
        return self.begins[i] + (a - self.at[i]) * self.steps[i], end


class _Whole:
    """The map of a run that is decoded as one."""

    def __init__(self, a: int, b: int):
        self.place = a, b

    def outer(self, _a: int, _b: int) -> tuple[int, int]:
        return self.place


def _outer(maps, a: int, b: int) -> tuple[int, int]:
    """The place in the text; ``maps`` is (map, those of the layers above) or None."""
    while maps:
        own, maps = maps
        a, b = own.outer(a, b)
    return a, b


def _rewritten(text: str, at: int, part: re.Pattern, decode) -> tuple[str, Layer] | None:
    out, layer, last = [], Layer(), 0
    for m in part.finditer(text):
        new = decode(m)
        if new is None:
            continue
        out += [text[last : m.start()], new]
        layer.add(m.start() - last, at + last, at + m.start(), 1)
        single = len(new) * 3 == m.end() - m.start()  # one escape %XX per sign
        layer.add(len(new), at + m.start(), at + m.end(), 3 if single else 0)
        last = m.end()
    if not out:
        return None
    layer.add(len(text) - last, at + last, at + len(text), 1)
    return "".join([*out, text[last:]]), layer


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace")


def _escape(m: re.Match) -> str | None:
    code = int(m[1] or m[2] or m[3] or "0", 16) if not m[4] else int(m[4])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _is_zlib(head: bytes) -> bool:
    return len(head) > 1 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0


def _unpacker(head: bytes):
    """How to decode what begins with ``head``: a function of (chunks, sizes of the steps)."""
    for magic, make in (
        (b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor),
        (b"\xfd7zXZ\x00", lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)),
    ):
        if head.startswith(magic):
            return lambda chunks, steps: _members(make, magic, chunks, steps)
    if head.startswith(b"\x28\xb5\x2f\xfd"):
        return _zstandard
    if _is_zlib(head):
        return lambda chunks, steps: _members(zlib.decompressobj, None, chunks, steps)
    return None


def _members(make, magic: bytes | None, chunks, steps):
    """The members of a stream, one behind another with zeros between; anything else ends it."""
    rest, chunks = b"", iter(chunks)
    while True:
        coder = make()
        while not coder.eof:
            n = next(steps)
            out = coder.decompress(rest, n)
            rest = getattr(coder, "unconsumed_tail", b"")
            if out:
                yield out
            if not coder.eof and not rest and getattr(coder, "needs_input", len(out) < n):
                rest = next(chunks, None)
                if rest is None:
                    return
        rest = coder.unused_data.lstrip(b"\0")
        while magic and len(rest) < len(magic):
            more = next(chunks, None)
            if more is None:
                return
            rest = (rest + more).lstrip(b"\0")
        if not magic or not rest.startswith(magic):
            return


class _Source(io.RawIOBase):
    def __init__(self, chunks):
        self.chunks, self.rest = iter(chunks), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            self.rest = next(self.chunks, None)
            if self.rest is None:
                self.rest = b""
                return 0
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _zstandard(chunks, steps):
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(io.BufferedReader(_Source(chunks), STEP), read_across_frames=True)
    while out := stream.read(next(steps)):
        yield out


class _Steps:
    """Sizes of the steps: STEP up to ``after`` bytes, then single bytes."""

    def __init__(self, after: int | None = None):
        self.done, self.after = 0, after

    def __iter__(self):
        return self

    def __next__(self) -> int:
        return STEP if self.after is None else min(STEP, self.after - self.done) if self.done < self.after else 1


def _unpacked(unpack, source):
    """The unpacked bytes of ``source()``, in chunks. What is damaged ends at the very byte
    of the damage: a step that fails is taken again byte by byte."""
    after = None
    for _ in range(2):
        steps = _Steps(after)
        try:
            for out in unpack(source(), steps):
                if after is None or steps.done >= after:
                    yield out
                steps.done += len(out)
            return
        except Exception as problem:  # noqa: BLE001
            if not isinstance(problem, (OSError, EOFError, ValueError)) and "rror" not in type(problem).__name__:
                raise
        after = steps.done


def _bytes_of(run: str) -> bytes:
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:  # no sign of its own
        plain = plain[:-1]
    return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)


def _escapes(text: str):
    """(begin, end, decoded text, map) of every paragraph with escapes. No pattern goes
    over a line break, and base64 goes over single ones only."""
    kinds = [(p, d) for p, d, on in ((_PERCENT_PART, _percent, "%" in text), (_ESCAPE_PART, _escape, "\\" in text or "&#" in text)) if on]
    if not kinds:
        return
    at = 0
    for end in [*(m.end() for m in _PARAGRAPH_END.finditer(text)), len(text)]:
        for part, decode in kinds:
            new = _rewritten(text[at:end], at, part, decode)
            if new:
                yield at, end, *new
        at = end


def _runs(text: str):
    """(begin, end, bytes) of base64: every run of a line, and runs over several lines."""
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), _bytes_of(m.group())
    for m in _WRAPPED.finditer(text):
        # a line may stand before the encoded ones: a run for each way to count in fours,
        # and one from every line that begins like something compressed
        lines, offset, phases = [x.span() for x in _LINE.finditer(text, m.start(), m.end())], 0, set()
        run = "".join([text[a:b] for a, b in lines])
        for a, b in lines:
            if offset % 4 not in phases or _unpacker(_bytes_of(run[offset : offset + 12])):
                phases.add(offset % 4)
                yield a, m.end(), _bytes_of(run[offset:])
            offset += b - a


def spans(text: str) -> tuple[list, list]:
    """The direct spans of a text, and those of its layers that are not among them."""
    base = direct(text)
    seen: set[tuple] = set()
    found = set()
    # The last is done first: what is inside a window before the next window is read.
    work = [(iter(()), None)]
    _enter(text, None, work, seen)
    while work:
        texts, maps = work[-1]
        layer = next(texts, None)
        if layer is None:
            work.pop()
            continue
        if isinstance(texts, _Once):
            work.pop()
        mark = (_outer(maps, 0, len(layer)), hashlib.blake2b(layer.encode("utf-8", "replace"), digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        for x, kind, y in _direct_inside(layer):
            lo, hi = _outer(maps, x, y)
            found.add((lo, kind, hi))
        _enter(layer, maps, work, seen)
    return base, sorted(found - set(base))


class _Once:
    """A single text, to be dropped when it is taken."""

    def __init__(self, text: str):
        self.text = text

    def __next__(self) -> str:
        return self.text


def _enter(text: str, maps, work: list, seen: set) -> None:
    """Put the layers directly inside ``text`` on the list."""
    for _, _, content, layer in _escapes(text):
        if content:
            work.append((_Once(content), (layer, maps)))
    for a, b, data in _runs(text):
        where = _outer(maps, a, b)
        work.append((_texts(data, seen, where), (_Whole(*where), None)))


def _texts(data: bytes, seen: set, where: tuple):
    """Texts in bytes, window by window, through as many compressed layers as there are."""
    source = lambda: iter((data,))
    while True:
        head, digest = bytearray(), hashlib.blake2b(digest_size=16)

        def watched(chunks, head=head, digest=digest):
            for chunk in chunks:
                if len(head) < 8:
                    head += chunk[:8]
                digest.update(chunk)
                yield chunk

        for window in _windows(watched(source())):
            if _LEGIBLE.search(window):
                yield window
        mark = (where, b"raw" + digest.digest())
        unpack = _unpacker(bytes(head))
        if mark in seen or unpack is None:
            return
        seen.add(mark)
        source = lambda unpack=unpack, inner=source: _unpacked(unpack, inner)


def _windows(chunks):
    """The text of a stream of bytes; what is no UTF-8 is a sign of its own."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    kept, new, size, enough = "", [], 0, WINDOW
    for chunk in chunks:
        new.append(decode(chunk))
        size += len(new[-1])
        if size >= enough:
            window = kept + "".join(new)
            yield window
            kept = window[-max(OVERLAP, _TAIL.match(window[::-1]).end()) :]
            new, size, enough = [], 0, max(WINDOW, len(kept))
    new.append(decode(b"", True))
    if any(new):
        yield kept + "".join(new)


def _written(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the direct spans, and all spans of every row.

    A null text is an empty one; repeated rows stay repeated; an empty table gives no rows.
    """
    names = [f"n_{k}" for k in KINDS]

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            found = [spans(t or "") for t in batch.column("text").to_pylist()]
            counts = [[sum(k == i for _, k, _ in base) for base, _ in found] for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    pa.array([_written(sorted(b + m)) for b, m in found], pa.string()),
                    pa.array([len(m) for _, m in found], pa.int64()),
                ],
                ["doc_id", *names, "base_sha256", "spans", "n_inside"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_sha256 string, spans string, n_inside bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
